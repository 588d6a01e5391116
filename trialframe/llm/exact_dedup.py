"""Exact deduplication against a minimal perfect hash over historical digests.

History is reduced to its distinct digests, dealt into buckets. Each bucket becomes one row of an index: a cascade of bit
arrays that gives every digest of the bucket a slot of its own without a gap, and per slot the full digest, the winner's id
and the number of copies. New digests are looked up in their bucket; only if all 32 bytes in the slot agree is the text a
repeat, and its slot then tells winner and copies. Digests that the index does not know are grouped among themselves.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.llm.common import SPACES, id_and_text, mixed
from trialframe.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: distinct digests of one bucket of the index, and the least number of buckets
BUCKET_DIGESTS, LEAST_BUCKETS = 4000, 64
#: bits of a level per digest that still has no slot
GAMMA = 2.0
#: rows of a group from which it may count as hot, and the most groups that do
HOT_ROWS, HOT_GROUPS = 1000, 50_000
INDEX = "bucket long, sizes array<long>, bits binary, digests binary, winners binary, copies binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest (rows of 32 bytes) falls on a level."""
    h = digests[:, :8].copy().view("<u8").ravel() + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mixed(h) % np.uint64(size)).astype(np.int64)


def build_levels(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The bit arrays and every digest's slot; slots run from 0 without a gap."""
    levels, slots, left, given = [], np.full(len(digests), -1), np.arange(len(digests)), 0
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        at = places(digests[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        bits = np.zeros(size, dtype=np.uint8)
        bits[at[alone[at]]] = 1
        rank = np.cumsum(bits) - 1
        slots[left[alone[at]]] = given + rank[at[alone[at]]]
        given += int(bits.sum())
        left = left[~alone[at]]
        levels.append(bits)
    return levels, slots


def find_slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot that the bit arrays give each digest, -1 for digests that fall on no set bit."""
    slots, left, begin, given = np.full(len(digests), -1), np.arange(len(digests)), 0, 0
    for level, size in enumerate(sizes):
        own = bits[begin: begin + size].astype(np.int64)
        at = places(digests[left], level, size)
        hit = own[at] == 1
        slots[left[hit]] = given + np.cumsum(own)[at[hit]] - 1
        left, begin, given = left[~hit], begin + size, given + int(own.sum())
    return slots


def as_bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, 32)


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One index row per bucket out of distinct ``digest, winner, copies``."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = as_bytes(pdf["digest"])
        levels, slots = build_levels(digests)
        order = np.argsort(slots)
        winners = pdf["winner"].to_numpy(dtype="<i8", na_value=np.iinfo("<i8").max)
        return pd.DataFrame({
            "bucket": [pdf["bucket"].iloc[0]], "sizes": [[len(x) for x in levels]],
            "bits": [np.packbits(np.concatenate(levels)).tobytes()], "digests": [digests[order].tobytes()],
            "winners": [winners[order].tobytes()], "copies": [pdf["copies"].to_numpy(dtype="<i8")[order].tobytes()],
        })

    return groups.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInPandas(build, INDEX)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def look_up(groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """``digest, winner, copies, known``: every slot of the index, with what the new groups add to it, and all nonmembers.

    A repeat gives its copies and its id to the slot that holds its digest; the slot tells the winner and the number of copies
    of its text. Nonmembers stay as they came, with ``known`` false.
    """
    none = np.iinfo("<i8").max

    def look(new: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        known = np.zeros(len(new), dtype=bool)
        parts = []
        if len(rows):
            row = rows.iloc[0]
            held = np.frombuffer(row["digests"], dtype=np.uint8).reshape(-1, 32)
            winners = np.frombuffer(row["winners"], dtype="<i8").copy()
            copies = np.frombuffer(row["copies"], dtype="<i8").copy()
            if len(new):
                digests, sizes = as_bytes(new["digest"]), [int(x) for x in row["sizes"]]
                slots = find_slots(digests, sizes, np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=sum(sizes)))
                known = slots >= 0
                known[known] = (held[slots[known]] == digests[known]).all(axis=1)
                own = new["winner"].to_numpy(dtype="<i8", na_value=none)[known]
                np.minimum.at(winners, slots[known], own)
                np.add.at(copies, slots[known], new["copies"].to_numpy(dtype="<i8")[known])
            best = pd.array(winners, dtype="Int64")
            best[best == none] = pd.NA
            parts.append(pd.DataFrame({"digest": [x.tobytes() for x in held], "winner": best, "copies": copies, "known": True}))
        if not known.all():
            others = new.loc[~known, ["digest", "winner", "copies"]]
            parts.append(others.assign(winner=others["winner"].astype("Int64"), known=False))
        return pd.concat(parts)

    left = groups.withColumn("bucket", bucket_of(buckets)).groupBy("bucket")
    return left.cogroup(index.groupBy("bucket")).applyInPandas(look, "digest binary, winner long, copies long, known boolean")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", historical: Column | None = None) -> DataFrame:
    """``doc_id, digest, copies, keep_id, group_size, known``: one row per id and text.

    ``copies`` counts rows with this id and text, ``group_size`` all rows with the text; ``keep_id`` is the smallest id
    among them. ``historical`` (over ``doc_id``) tells which rows form the indexed history; by default those in the lower
    half of the ids. The split never changes the groups. Null texts count as empty; null ids come after all others (a
    group of only null ids has a null ``keep_id``); an empty table gives no rows; other columns are ignored.
    """
    own = id_and_text(docs, id_col, text_col)
    if historical is None:
        low, high = own.agg(F.min("doc_id"), F.max("doc_id")).first()
        historical = F.col("doc_id") < F.lit((low + high + 1) // 2 if low is not None else 0)
    digest = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    rows = cut(own.select("doc_id", digest.alias("digest")).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
               .withColumn("old", F.coalesce(historical, F.lit(False))))
    distinct, total = rows.agg(F.approx_count_distinct("digest"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, distinct // BUCKET_DIGESTS)
    groups = rows.groupBy("digest", "old").agg(F.min("doc_id").alias("winner"), F.sum("copies").alias("copies"))
    index = build_index(groups.where("old").drop("old"), buckets)
    whole = cut(look_up(groups.where("not old").drop("old"), index, buckets)
                .select("digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), "known"))
    # fewer than HOT_GROUPS groups can hold more rows than this each; they are broadcast, so that no key carries many rows
    many = max(HOT_ROWS, total // HOT_GROUPS)
    hot, rest = F.broadcast(whole.where(F.col("group_size") > many)), whole.where(F.col("group_size") <= many)
    rows = rows.drop("old")
    both = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(rest, "digest"))
    return both.select("doc_id", "digest", "copies", "keep_id", "group_size", "known")


def kept_marks(groups: DataFrame) -> DataFrame:
    """One row per input row with ``kept``: of equal texts, one row with the smallest id."""
    return (groups.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).drop("copy", "copies"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows with one id and one text any one stays.

    Null texts count as empty, whole texts of any length are digested; of a text that only rows with null ids hold one row stays.
    An empty table stays empty. Rows travel as one struct, so columns of any name pass.
    """
    stay = (exact_groups(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .select(F.col("doc_id").alias("stay_id"), F.col("digest").alias("stay_digest"), "copies"))
    marked = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).cast("long").alias("own_id"),
        F.unhex(F.sha2(normalised(F.coalesce(col(text_col), F.lit(""))).cast("binary"), 256)).alias("own_digest"))
    both = marked.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_digest") == F.col("stay_digest")))
    once = both.where("copies = 1").unionByName(both.where("copies > 1").dropDuplicates(["own_id", "own_digest"]))
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
