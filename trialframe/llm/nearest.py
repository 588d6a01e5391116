"""Approximate nearest neighbours by cosine over few stable projections, a kd-tree and a chi-square stopping test.

Vectors of length one are projected onto ``DIMS`` Gaussian directions. The squared projected distance over the squared true one then
follows a chi-square law with ``DIMS`` degrees of freedom, so a neighbour nearer than the k-th best found so far lies, with
probability ``SURE``, within a known projected radius. A search takes rows in the order of their kd-tree leaves' projected distance,
verifies each against the whole vectors, and stops when the next leaf lies beyond that radius.

The tree's top is fitted on a bounded sample and cuts the rows into cells; cells are dealt to groups of bounded size, each
with a kd-tree of its own. Queries first search the cell they lie in; the distance found there tells which other cells they
still have to visit.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: projected dimensions (an even number), probability of the stopping test, and seed of the directions
DIMS, SURE, SEED = 12, 0.97, 42
#: rows that the top of the tree is fitted on, rows and queries of one group, rows of a leaf
SAMPLE_ROWS, GROUP_ROWS, GROUP_QUERIES, LEAF_ROWS = 20_000, 16_384, 2_048, 128
#: entries kept beyond k, as sums in other orders may differ in their last bits
SPARE = 4
FOUND = "query long, class long, near double"


def chi_square_bound(sure: float, dims: int) -> float:
    """The value that a chi-square variable of ``dims`` (even) degrees of freedom stays below with probability ``sure``."""
    below = lambda x: 1.0 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1.0
    while below(high) < sure:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < sure else (low, middle)
    return high


def directions(width: int, dims: int = DIMS) -> np.ndarray:
    """Gaussian directions; a component's row does not depend on how many follow."""
    return np.random.default_rng(SEED).standard_normal((max(width, 1), dims))


# ---------------------------------------------------------------- vectors

def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    value = lambda x: x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: value(x) != 0.0)


def vectors_of(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: vectors of doubles, one row per id; very large or small ones over a power of two, which changes no cosine."""
    own = frame.where(usable(col(vector_col))).select(
        col(id_col).cast("long").alias("vec_id"), F.transform(col(vector_col), lambda x: x.cast("double")).alias("w")).where("vec_id is not null")
    size = F.aggregate("w", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    e = F.when(size.between(1e-100, 1e100), F.lit(0)).otherwise(F.floor(F.log2(size)))
    # in two steps, as one whole power may lie outside the doubles
    half = F.floor(e / 2)
    own = own.withColumns({"p": F.pow(F.lit(2.0), -half.cast("double")), "q": F.pow(F.lit(2.0), (half - e).cast("double"))})
    scaled = own.select("vec_id", F.transform("w", lambda x: x * F.col("p") * F.col("q")).alias("v"))
    return scaled.groupBy("vec_id").agg(F.min("v").alias("v"))


def stacked(vectors, width: int) -> np.ndarray:
    """Vectors as rows of length one; missing components count as 0."""
    out = np.zeros((len(vectors), max(width, 1)))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True)) if len(out) else out


# ---------------------------------------------------------------- trees

def top_tree(points: np.ndarray, levels: int) -> list[tuple[int, float]]:
    """Splits of a complete kd-tree in heap order: the widest dimension at its median."""
    splits: list[tuple[int, float]] = []
    parts = [points]
    for _ in range(levels):
        below = []
        for p in parts:
            d = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            at = float(np.median(p[:, d])) if len(p) else 0.0
            splits.append((d, at))
            below += [p[p[:, d] <= at], p[p[:, d] > at]]
        parts = below
    return splits


def cells_of(points: np.ndarray, splits: list[tuple[int, float]], levels: int) -> np.ndarray:
    """The cell of each point: its path from the root."""
    node = np.zeros(len(points), dtype=np.int64)
    if levels:
        dim, at = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        rows = np.arange(len(points))
        for _ in range(levels):
            node = 2 * node + 1 + (points[rows, dim[node]] > at[node])
    return node - (2**levels - 1)


def leaves_of(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree of at most ``most`` rows each."""
    open_, done = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        d = int(np.argmax(np.ptp(points[rows], axis=0)))
        order = np.argpartition(points[rows, d], len(rows) // 2)
        open_ += [rows[order[len(rows) // 2:]], rows[order[:len(rows) // 2]]]
    return done


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        x = q[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0.0)
        out += gap * gap
    return out


def search(q: np.ndarray, asked: np.ndarray, v: np.ndarray, points: np.ndarray, known: np.ndarray, k: int, spare: int, factor: float,
           leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cosines of the ``k + spare`` best of ``v`` for each query, as far as the stopping test for the k-th asks for them.

    ``q`` are the projected queries, ``asked`` the whole ones, ``known`` the squared distance of their k-th best elsewhere (or infinity),
    ``factor`` the bound of the chi-square law.
    """
    leaves = leaves_of(points, leaf_rows)
    low, high = (np.stack([f(points[r], axis=0) for r in leaves]) for f in (np.min, np.max))
    far = box_distances(q, low, high)
    order = np.argsort(far, axis=1, kind="stable")
    kept = k + spare
    best, row = np.full((len(q), kept), -np.inf), np.full((len(q), kept), -1)
    active = np.arange(len(q))
    for step in range(len(leaves)):
        leaf = order[active, step]
        # the k-th best so far, here or elsewhere, bounds the projected radius; leaves come nearest first
        radius = np.minimum(known[active], np.maximum(2.0 - 2.0 * best[active, k - 1], 0.0)) * factor
        going = far[active, leaf] <= radius
        active, leaf, radius = active[going], leaf[going], radius[going]
        if not len(active):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
        for who in np.split(by_leaf, edges):
            rows, mine = leaves[leaf[who[0]]], active[who]
            near = asked[mine] @ v[rows].T
            gap = ((q[mine] ** 2).sum(axis=1)[:, None] + (points[rows] ** 2).sum(axis=1)[None] - 2.0 * (q[mine] @ points[rows].T))
            near[gap > radius[who][:, None] + 1e-9] = -np.inf
            both = np.concatenate([best[mine], near], axis=1)
            names = np.concatenate([row[mine], np.broadcast_to(rows, near.shape)], axis=1)
            at = np.argpartition(-both, kept - 1, axis=1)[:, :kept]
            both, names = np.take_along_axis(both, at, axis=1), np.take_along_axis(names, at, axis=1)
            at = np.argsort(-both, axis=1, kind="stable")
            best[mine], row[mine] = np.take_along_axis(both, at, axis=1), np.take_along_axis(names, at, axis=1)
    row[~np.isfinite(best)] = -1
    return row, best


# ---------------------------------------------------------------- the search as a job

def projected(frame: DataFrame, width: int, keep: str, schema: str, splits=None, levels: int = 0) -> DataFrame:
    """Add the projection ``p`` of each vector ``v`` and, with the top of a tree, its ``cell``."""
    basis = directions(width)

    def run(stream):
        for batch in stream:
            points = stacked(batch.column("v").to_pylist(), width) @ basis
            columns = [batch.column(keep), batch.column("v"), pa.array(list(points), type=pa.list_(pa.float64()))]
            names = [keep, "v", "p"]
            if splits is not None:
                columns.append(pa.array(cells_of(points, splits, levels).astype(np.int32)))
                names.append("cell")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return frame.select(keep, "v").mapInArrow(run, schema)


def visited(queries: DataFrame, boxes: list, factor: float, home_only: bool) -> DataFrame:
    """``class, block, to``: the cells that each query has to search, its own first, then those within its radius."""
    names = np.array([b["cell"] for b in boxes], dtype=np.int64)
    low, high = (np.array([b[c] for b in boxes], dtype=np.float64).reshape(len(boxes), -1) for c in ("low", "high"))

    def run(stream):
        for batch in stream:
            classes, blocks = batch.column("class").to_numpy(), batch.column("block").to_numpy()
            own = batch.column("cell").to_numpy()
            if home_only:
                i, to = np.arange(len(classes)), own
            else:
                points = np.array(batch.column("p").to_pylist(), dtype=np.float64).reshape(len(classes), -1)
                bound = np.array([np.inf if b is None else b for b in batch.column("bound").to_pylist()], dtype=np.float64)
                i, j = np.nonzero((box_distances(points, low, high) <= (bound * factor)[:, None] + 1e-9) & (names[None, :] != own[:, None]))
                to = names[j]
            yield pa.RecordBatch.from_arrays([pa.array(classes[i]), pa.array(blocks[i]), pa.array(to.astype(np.int32))], names=["class", "block", "to"])

    return queries.mapInArrow(run, "class long, block long, to int")


def searched(routes: DataFrame, queries: DataFrame, rows: DataFrame, width: int, k: int, spare: int, factor: float) -> DataFrame:
    """``query, class, near``: what the visited cells hold; one group is a block of queries and a part of a cell."""
    leaf_rows = LEAF_ROWS
    meets = routes.select("block", "to").distinct()
    parts = rows.select("cell", "part").distinct()
    pairs = meets.join(parts, meets["to"] == parts["cell"]).select("block", F.col("cell").alias("c"), F.col("part").alias("s"))
    right = rows.join(pairs, (rows["cell"] == pairs["c"]) & (rows["part"] == pairs["s"])).select(
        "block", F.col("cell").alias("to"), "part", "class", "v", "p")
    own = queries.select("class", "v", "p", "bound")
    left = routes.join(own, "class").join(parts, F.col("to") == F.col("cell")).select("block", "to", "part", "class", "v", "p", "bound")

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "class": pd.Series(dtype="int64"), "near": pd.Series(dtype="float64")})
        known = q["bound"].fillna(np.inf).to_numpy(dtype=np.float64)
        at, near = search(np.stack(q["p"].to_list()), stacked(q["v"].to_list(), width), stacked(r["v"].to_list(), width),
                          np.stack(r["p"].to_list()), known, k, spare, factor, leaf_rows)
        i, j = np.nonzero(at >= 0)
        return pd.DataFrame({"query": q["class"].to_numpy()[i], "class": r["class"].to_numpy()[at[i, j]], "near": near[i, j]})

    keys = ["block", "to", "part"]
    # new columns, as both sides come from one table
    left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, FOUND)


def cosine(a: str, b: str) -> Column:
    """In double precision, summed in the order of the components."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: F.coalesce(s, zero) * F.coalesce(t, zero)), zero, lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(frame: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            sure: float = SURE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for each query by cosine, ties to the smaller id.

    ``queries`` (over ``vec_id``) tells which rows are queries; every row is indexed. Each true neighbour is missed with a probability of at most
    ``1 - sure`` over the choice of directions; scores are exact cosines of the original vectors. Null ids, vectors that are null or zero or
    hold null or non-finite components take no part; an id on several rows counts once, with its smallest vector; shorter vectors
    count as ending in zeros; fewer than ``k`` other rows are all returned; an empty table gives no rows; other columns are
    ignored. Equal vectors are searched as one.
    """
    factor = chi_square_bound(sure, DIMS)
    vectors = cut(vectors_of(frame, id_col, vector_col))
    # of equal vectors the k + 1 smallest ids suffice: one of them may be the query's own
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = cut(few.groupBy("v").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    count, width = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = width or 1
    # the top of the tree: fitted on a sample of bounded size, drawn by a hash of the id
    levels = max(0, math.ceil(math.log2(max(count, 1) / GROUP_ROWS))) if count > GROUP_ROWS else 0
    levels = min(levels, int(math.log2(SAMPLE_ROWS / 32)))
    sample = projected(classes.orderBy(F.xxhash64("class")).limit(SAMPLE_ROWS), width, "class", "class long, v array<double>, p array<double>")
    splits = top_tree(np.array([r["p"] for r in sample.select("p").collect()], dtype=np.float64).reshape(-1, DIMS), levels)
    placed = cut(projected(classes, width, "class", "class long, v array<double>, p array<double>, cell int", splits, levels))
    corner = lambda f: F.array(*[f(F.get("p", F.lit(d))) for d in range(DIMS)])
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), corner(F.min).alias("low"), corner(F.max).alias("high")).collect()
    # at most 2 ** levels cells; a cell above the bound is dealt to several groups
    shares = F.create_map(*[x for b in boxes for x in (F.lit(b["cell"]), F.lit(max(1, -(-b["rows"] // GROUP_ROWS))))]) if boxes else F.create_map()
    if not boxes:
        return empty_result(frame.sparkSession)
    rows = cut(placed.withColumn("part", F.pmod(F.xxhash64("class"), F.try_element_at(shares, F.col("cell")).cast("long"))))
    asked = cut(vectors.where(queries).join(classes.select("v", "class"), "v").select(F.col("vec_id").alias("query_id"), "class"))
    wanted = rows.join(asked.select("class").distinct(), "class", "left_semi").select("class", "v", "p", "cell")
    sizes = {r["cell"]: r["n"] for r in wanted.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return empty_result(frame.sparkSession)
    slots = F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(max(1, -(-n // GROUP_QUERIES))))])
    block = F.pmod(F.xxhash64("class"), F.try_element_at(slots, F.col("cell")).cast("long")) * F.lit(2**levels) + F.col("cell")
    wanted = cut(wanted.withColumns({"block": block, "bound": F.lit(None).cast("double")}))

    # own cell first
    near = cut(searched(visited(wanted, boxes, factor, True), wanted, rows, width, k + 1, SPARE, factor))
    listed = near.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.col("near").desc(), "class")))
    bounds = listed.where(F.col("nth") == k + 1).select(F.col("query").alias("class"), F.greatest(2.0 - 2.0 * F.col("near"), F.lit(0.0)).alias("bound"))
    open_ = cut(wanted.drop("bound").join(bounds, "class", "left"))
    more = searched(cut(visited(open_, boxes, factor, False)), open_, rows, width, k + 1, SPARE, factor)
    best = near.unionByName(more).withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.col("near").desc(), "class")))
    best = best.where(F.col("nth") <= k + 1 + SPARE).select("query", "class")

    left = classes.select(F.col("class").alias("query"), F.col("v").alias("qv"))
    scored = best.join(left, "query").join(classes, "class").select("query", cosine("qv", "v").alias("score"), F.explode("ids").alias("vec_id"))
    # of a query class, k + 1 rows answer all its queries
    few = scored.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("nth") <= k + 1)
    answers = asked.join(few.select("query", "score", "vec_id"), asked["class"] == F.col("query")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def empty_result(spark) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
