"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are split into parts, and every part keeps its own list of scores per query. Phase one gathers the best entries of each
list; the k-th best whole score among them is a safe cutoff. Phase two sends the cutoff back and collects every entry that is at
least its even share, since a vector that reaches the cutoff must reach the share in some part. Phase three bounds the
collected vectors by what is known of them and resolves the rest exactly. Equal vectors are searched as one, with their
smallest ids, and lists are made block by block of queries and vectors.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: parts of a vector, and queries and vectors of one block
PARTS, QUERY_BLOCK, VECTOR_BLOCK = 2, 1024, 8192


def whole_numbers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def vectors_of(frame: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id, v``: one vector of whole numbers per id (the smallest, where an id has several)."""
    own = frame.where(usable(col(vector_col))).select(col(id_col).cast("long").alias("vec_id"), whole_numbers(col(vector_col), scale).alias("v"))
    return own.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))


def parts_of(frame: DataFrame, width: int, *keep: str) -> DataFrame:
    """One row per part of each vector; missing components count as 0."""
    size = -(-max(width, 1) // PARTS)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size * PARTS) - F.size("v")))
    return frame.select(*keep, padded.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")).withColumn(
        "v", F.slice("v", F.col("part") * size + 1, size))


def products(left: pd.Series, right: pd.Series) -> np.ndarray:
    """All inner products of two lists of vectors of whole numbers, exactly."""
    a, b = (np.stack([np.asarray(x, dtype=np.int64) for x in s]) for s in (left, right))
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def in_blocks(queries: DataFrame, vectors: DataFrame, f, schema: str) -> DataFrame:
    """``f(queries, vectors, scores)`` for each block of queries, block of vectors and part."""
    counts = [max(1, -(-x.select("class").distinct().count() // n)) for x, n in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK))]
    block = [F.pmod(F.xxhash64("class"), F.lit(n)).cast("int") for n in counts]
    # new columns, as both sides come from one table
    queries, vectors = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (queries, vectors))
    left = queries.withColumn("qb", block[0]).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))))
    right = vectors.withColumn("vb", block[1]).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))))

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return f(q, v, np.zeros((len(q), len(v)), dtype=np.int64))
        return f(q, v, products(q["v"], v["v"]))

    keys = ["part", "qb", "vb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def best_entries(count: int):
    def run(q: pd.DataFrame, v: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        n = min(count, len(v))
        if not scores.size:
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "class": pd.Series(dtype="int64"), "part": pd.Series(dtype="int32"), "score": pd.Series(dtype="int64")})
        at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        return pd.DataFrame({"query": np.repeat(q["class"].to_numpy(), n), "class": v["class"].to_numpy()[at.ravel()],
                             "part": q["part"].iloc[0], "score": np.take_along_axis(scores, at, axis=1).ravel()})

    return run


def entries_above_share(q: pd.DataFrame, v: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
    if not scores.size:
        return best_entries(1)(q, v, scores)
    cutoff = q["cutoff"].fillna(np.iinfo(np.int64).min).to_numpy()
    # a whole number times PARTS reaches the cutoff only if it reaches the even share rounded up
    share = np.where(cutoff == np.iinfo(np.int64).min, cutoff, -((-cutoff) // PARTS))
    i, j = np.nonzero(scores >= share[:, None])
    return pd.DataFrame({"query": q["class"].to_numpy()[i], "class": v["class"].to_numpy()[j], "part": q["part"].iloc[0] if len(q) else 0, "score": scores[i, j]})


def resolved(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``query, class, score``: whole scores of pairs of classes."""
    left = classes.select(F.col("class").alias("query"), F.col("v").alias("qv"))
    both = pairs.join(left, "query").join(classes.select("class", "v"), "class")
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    return both.select("query", "class", dot.alias("score"))


def top_inner_products(frame: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                       scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each query by inner product, ties to the smaller id.

    ``queries`` (over ``vec_id``) tells which rows are queries. Components become ``floor(scale * x)``. Null ids, null vectors and vectors
    with null or non-finite components take no part; an id that occurs on several rows counts once, with its smallest
    vector; shorter vectors count as ending in zeros; a score that does not fit a long is an error; fewer than ``k`` other rows are all returned; an empty table gives no rows;
    other columns are ignored.
    """
    vectors = cut(vectors_of(frame, id_col, vector_col, scale))
    # of equal vectors the k + 1 smallest ids suffice: one of them may be the query's own
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = cut(few.groupBy("v").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = cut(vectors.where(queries).join(classes.select("v", "class"), "v").select(F.col("vec_id").alias("query_id"), "class"))
    width = classes.agg(F.max(F.size("v"))).first()[0] or 0
    searched = classes.join(asked.select("class").distinct(), "class", "left_semi")
    lists, wanted = parts_of(classes, width, "class"), parts_of(searched, width, "class")
    # phase one: each part's best entries, and the whole scores of the vectors among them
    schema, order = "query long, class long, part int, score long", [F.col("score").desc(), F.col("class")]
    local = in_blocks(wanted, lists, best_entries(k + 1), schema)
    listed = local.withColumn("nth", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("nth") <= k + 1)
    seen = resolved(listed.select("query", "class").distinct(), classes)
    cutoff = (seen.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("nth") == k + 1)
              .select(F.col("query").alias("class"), F.col("score").alias("cutoff")))
    # phase two: everything that reaches the cutoff's even share in some part
    cutoffs = cut(searched.select("class").join(cutoff, "class", "left"))
    entries = in_blocks(wanted.join(cutoffs, "class"), lists, entries_above_share, schema)
    known = entries.groupBy("query", "class").agg(F.sum("score").alias("known"), F.count(F.lit(1)).alias("parts"))
    limits = known.join(cutoffs.withColumnRenamed("class", "query"), "query")
    # a part that was not sent lies below the share: PARTS times the score stays below this bound
    bound = F.col("known") * PARTS + (PARTS - F.col("parts")) * (F.col("cutoff") - 1)
    viable = limits.where(F.col("cutoff").isNull() | (bound >= F.col("cutoff") * PARTS))
    # phase three: resolve, rank classes, and give every query its own rows
    best = (resolved(viable.select("query", "class"), classes)
            .withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("nth") <= k + 1)
            .join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id")))
    found = asked.join(best, asked["class"] == best["query"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
