"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's rows are dealt into blocks by a hash of their id. How many blocks each output shard takes from each source is
drawn exactly: the root of a binary tree holds all sources' quotas, and every node splits its quotas between its halves by a
multivariate-hypergeometric draw, seeded by the node, so that any shard can walk down to its own quotas alone. Shards then take
disjoint runs of each source's permuted blocks, and rows are shuffled within their shard.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = r"[^\x20\x09-\x0D]+"
#: blocks of one source at most, words of a block, and blocks of all sources per output shard
SOURCE_BLOCKS, BLOCK_WORDS, SHARD_BLOCKS = 20_000, 20_000, 64
#: rows of a plan (about 50 bytes each) that may be broadcast
BROADCAST_ROWS = 50_000


def targets(sizes: list[int], weights: list[float], share: float = 1.5, repeats: float = 2.0) -> list[float]:
    """Sizes that the sources shall have: ``share`` of all words by weight, none above ``repeats`` times its own size."""
    out, open_, rest = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], share * sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / weight > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / weight
            return out
        for i in over:
            out[i] = repeats * sizes[i]
        rest -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def shard_quotas(quotas: list[int], shard: int, shards: int, seed: int) -> list[int]:
    """Blocks that one shard takes from each source: the draws on the way from the root to its leaf."""
    low, high, own = 0, shards, list(quotas)
    while high - low > 1:
        mid = (low + high) // 2
        total = sum(own)
        left = total * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        drawn, room, rest = [], left, total
        for q in own:  # one source after the other, each a hypergeometric draw of what is left
            rest -= q
            x = int(rng.hypergeometric(q, rest, room)) if q and rest and room else min(q, room)
            drawn.append(x)
            room -= x
        if shard < mid:
            own, high = drawn, mid
        else:
            own, low = [q - x for q, x in zip(own, drawn, strict=True)], mid
    return own


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """``doc_id, source, size`` of each row and a ``pick`` that orders rows by chance but alike in every run."""
    size = F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return [col(id_col).cast("long").alias("doc_id"), col(source_col).cast("string").alias("source"), size.alias("size"),
            F.xxhash64(col(id_col).cast("long"), col(text_col), F.lit(seed)).alias("pick")]


def source_plan(rows: DataFrame, cycle: tuple[float, ...], share: float, repeats: float) -> DataFrame:
    """``place, source, source_size, target, blocks``: one row per source; the sources, not their rows, pass the driver."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    # Python compares text by code point
    ordered = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in ordered]
    wanted = targets(sizes, [cycle[i % len(cycle)] for i in range(len(sizes))], share, repeats)
    blocks = [min(SOURCE_BLOCKS, max(1, s // BLOCK_WORDS)) for s in sizes]
    plan = [(i, r["source"], s, float(t), b) for i, (r, s, t, b) in enumerate(zip(ordered, sizes, wanted, blocks, strict=True))]
    frame = rows.sparkSession.createDataFrame(plan, "place int, source string, source_size long, target double, blocks int")
    return F.broadcast(frame) if len(plan) <= BROADCAST_ROWS else frame


def in_blocks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows next to what their source has in the plan, and the block of the source that they belong to."""
    both = rows.join(plan.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return both.withColumn("block", F.pmod(F.xxhash64("pick", F.lit(1)), F.col("blocks")).cast("int"))


def taken_blocks(placed: DataFrame, seed: int) -> DataFrame:
    """``place, pass, block, shard, room, total``: the blocks that the shards draw.

    The blocks of a source stand in an order drawn by chance, each pass in one of its own. Its quota are the blocks up to the one
    at which it reaches its target; a target above its size takes every block once and goes on in a second pass. The splitting
    tree shares the quotas out, and each shard draws its run of the order. ``room`` are the words that may still be taken when
    the block's turn comes, ``total`` those it has.
    """
    sums = placed.groupBy("place", "block").agg(F.sum("size").alias("total"), F.first("target").alias("target"),
                                                F.first("source_size").alias("source_size")).where("total > 0")
    turns = sums.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    left = F.round("target") - F.col("pass") * F.col("source_size")
    wanted = F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), left)).cast("long")
    order = Window.partitionBy("place").orderBy("pass", F.xxhash64("block", "pass", F.lit(seed)), "block")
    before = F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("pass") * F.col("source_size")
    permuted = cut(turns.withColumn("room", wanted - before).withColumn("rank", F.row_number().over(order).cast("long") - 1)
                   .select("place", "pass", "block", "rank", "room", "total"))
    quotas = {r["place"]: r["n"] for r in permuted.where("room > 0").groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    return cut(permuted.join(shard_runs(placed.sparkSession, quotas, seed), ["place", "rank"]).drop("rank"))


def shard_runs(spark: SparkSession, quotas: dict[int, int], seed: int) -> DataFrame:
    """``place, rank, shard``: the disjoint runs of each source's permuted blocks that the leaves of the splitting tree draw."""
    places = sorted(quotas)
    counts = [quotas[p] for p in places]
    shards = max(1, -(-sum(counts) // SHARD_BLOCKS))

    def leaves(parts):
        for pdf in parts:
            for shard in pdf["id"]:
                own = shard_quotas(counts, int(shard), shards, seed)
                yield pd.DataFrame({"place": places, "shard": int(shard), "quota": own})

    drawn = spark.range(shards).mapInPandas(leaves, "place int, shard long, quota long").where("quota > 0")
    ends = Window.partitionBy("place").orderBy("shard")
    return drawn.withColumn("end", F.sum("quota").over(ends)).select(
        "place", "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("rank"))


def drawn_rows(placed: DataFrame, taken: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``pass``, ``shard`` and ``words``: one row for each time the mix takes a row, with at most its words.

    Only rows of the one block per source and pass in which the target is reached are put in order, to be cut there.
    """
    blocks = F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken
    both = placed.where("size > 0").join(blocks, ["place", "block"])
    whole = both.where("room >= total").withColumn("words", F.col("size"))
    order = Window.partitionBy("place", "pass", "block").orderBy("pick", "doc_id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    last = both.where("room < total").withColumn("before", before).withColumn("words", F.least("size", F.col("room") - F.col("before")))
    names = [*keep, "pass", "shard", "words"]
    return whole.select(*names).unionByName(last.where("words > 0").select(*names))


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, repeats: float = 2.0, seed: int = 5) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, shards``: one row per input row, with the words the mix takes of it.

    ``shards`` are the output shards whose blocks hold it, one for each time it is taken.
    Sources are ordered by code point, null last, and weigh ``cycle`` in turn. Null texts have size 0; null ids, repeated rows
    and ties are rows of their own; a single row may be taken in part; an empty table gives no rows; other columns are ignored.
    """
    # repeated rows are told apart by a number of their own, so that each keeps its own words
    rows = cut(docs.select(*sized(docs, id_col, text_col, source_col, seed)).withColumn("row", F.monotonically_increasing_id()))
    placed = in_blocks(rows, source_plan(rows, cycle, share, repeats))
    drawn = drawn_rows(placed, taken_blocks(placed, seed), ["row"])
    words = drawn.groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards"))
    return placed.join(words, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("shards", F.array().cast("array<long>")).alias("shards"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, repeats: float = 2.0, seed: int = 5) -> DataFrame:
    """The rows of the mix with all columns of ``docs``: shard by shard, shuffled within each shard.

    A row that is taken twice stands there twice; where a source reaches its target inside a row, the text ends there.
    Rows without words (null, empty or blank texts) are kept once, spread over the shards: they take no part in any weight.
    Null ids and repeated rows are rows of their own; an empty table stays empty; rows travel as one struct.
    """
    fields = sized(docs, id_col, text_col, source_col, seed)
    rows = cut(docs.select(*fields))
    plan = source_plan(rows, cycle, share, repeats)
    taken = taken_blocks(in_blocks(rows, plan), seed)
    whole = F.struct(*[col(c) for c in docs.columns]).alias("__row")
    placed = in_blocks(docs.select(whole, *fields, F.monotonically_increasing_id().alias("__at")), plan)
    text = F.col("__row")[text_col]
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    ended = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(parts, 1, F.col("words").cast("int")), "")).otherwise(text)
    drawn = drawn_rows(placed, taken, ["__row", "pick", "size"]).select("__row", F.xxhash64("pick", "pass").alias("pick"), "shard", ended.alias("__text"))
    shards = (taken.agg(F.max("shard")).first()[0] or 0) + 1
    none = placed.where("size = 0").select("__row", "pick", F.pmod(F.xxhash64("pick", "__at"), F.lit(shards)).alias("shard"), text.alias("__text"))
    dealt = drawn.unionByName(none).repartition("shard").sortWithinPartitions("shard", "pick")
    return dealt.select(*[(F.col("__text") if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns])
