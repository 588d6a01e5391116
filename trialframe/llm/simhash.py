"""SimHash near-duplicates by a self-join of binary tries.

A pair of fingerprints within four bits agrees on at least two of six bands of bits, so every fingerprint is sent to the
fifteen pairs of bands. Fingerprints that share a pair of bands form one trie; the join walks pairs of its nodes
together, from the highest bit down, adds up the bits in which they differ and drops a pair once the budget is spent, or
once all fingerprints below both nodes are linked already. Nodes with more fingerprints than one task should hold are first
split into their child pairs, which become keys of their own.
"""

from __future__ import annotations

import sys
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.columns import col
from trialframe.llm.common import batches, give_back, id_and_text, linked_components
from trialframe.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS, BUDGET, BANDS = 64, 4, 6
#: distinct fingerprints below one key of the join, and rows of one of its tasks
NODE_ROWS, TASK_ROWS = 20_000, 400_000
#: node pairs that are walked at once
FRONT = 1 << 20


def fingerprint(text: bytes, words_per_shingle: int, seed: int) -> int:
    """The bits that more than half of the shingles' hashes have; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *[e + 1 for e in ends[: -words_per_shingle]]]
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), len(starts)
    for i in range(0, n, 1 << 15):
        pairs = zip(starts[i: i + (1 << 15)], ends[i + words_per_shingle - 1: i + (1 << 15) + words_per_shingle - 1], strict=False)
        hashes = np.array([digest(line[s:e], seed) for s, e in pairs], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text as a signed 64-bit number; null texts count as empty."""
    def run(stream):
        for ids, texts in batches(stream):
            found = np.array([fingerprint(t, words, seed) for t in texts], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(found)], names=["doc_id", "fp"])
        give_back()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def band_rows(nodes: DataFrame) -> DataFrame:
    """``key, fp, side, err, depth``: each fingerprint once for every pair of bands."""
    edges = [BITS * i // BANDS for i in range(BANDS + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = [F.concat(F.lit(f"{i}:"), F.hex(F.col("fp").bitwiseAND(F.lit(signed[a] | signed[b]))))
            for i, (a, b) in enumerate(combinations(range(BANDS), BANDS - BUDGET))]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select(
        "key", "fp", F.lit(0).alias("side"), F.lit(0).alias("err"), F.lit(BITS).alias("depth"))


def split_large(rows: DataFrame, bound: int) -> DataFrame:
    """Replace keys with more rows than ``bound`` by the pairs of their trie node's children.

    Side 0 joins with itself, side 1 with side 2 of the same key.
    """
    for _ in range(BITS):
        sizes = cut(rows.where("depth > 0").groupBy("key").count().where(F.col("count") > bound))
        if sizes.limit(1).count() == 0:
            break
        large = rows.join(sizes, "key").drop("count")
        depth = F.col("depth") - 1
        bit = F.when(F.expr("shiftrightunsigned(fp, depth - 1) & 1") == 1, 1).otherwise(0)
        child = lambda name, side, err: F.struct(F.concat("key", name).alias("key"), side.alias("side"), (F.col("err") + err).alias("err"))
        text = bit.cast("string")
        own = F.array(child(F.concat(F.lit("/"), text), F.lit(0), F.lit(0)), child(F.lit("/x"), bit + 1, F.lit(1)))
        pair = lambda v: child(
            F.when(F.col("side") == 1, F.concat(F.lit("/"), text, F.lit(v))).otherwise(F.concat(F.lit(f"/{v}"), text)),
            F.col("side"), F.when(text == v, 0).otherwise(1))
        parts = (large.withColumn("part", F.explode(F.when(F.col("side") == 0, own).otherwise(F.array(pair("0"), pair("1")))))
                 .select("part.key", "fp", "part.side", "part.err", depth.alias("depth")).where(f"err <= {BUDGET} and (depth > 0 or side > 0)"))
        rows = cut(rows.join(sizes, "key", "left_anti").unionByName(parts))
    return rows


def merge_links(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked entries the smallest label of their component."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def join_tries(fp: np.ndarray, unit: np.ndarray, side: np.ndarray, err: np.ndarray, depth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a spanning forest) between the distinct fingerprints of this task, walked unit by unit.

    The arrays are sorted by unit, side and fingerprint. ``depth`` is the number of low bits that a unit still has to walk, all
    without it; ``err`` counts the differences in the bits above.
    """
    distinct, member = np.unique(fp, return_inverse=True)
    label = np.arange(len(distinct))
    near = np.flatnonzero((unit[1:] == unit[:-1]) & (side[1:] == side[:-1]) & (side[1:] == 0)
                          & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= BUDGET))
    merge_links(label, member[near], member[near + 1])
    first = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])]))
    last = np.append(first[1:], len(fp))
    alone = side[first] == 0
    cross = np.flatnonzero((side[first][:-1] == 1) & (side[first][1:] == 2) & (unit[first][:-1] == unit[first][1:])) if len(first) > 1 else np.array([], dtype=np.int64)
    front = [np.concatenate([x[alone], x[cross + k]]) for x, k in ((first, 0), (last, 0), (first, 1), (last, 1))]
    front[2][: alone.sum()], front[3][: alone.sum()] = first[alone], last[alone]
    cost = np.concatenate([err[first][alone], err[first][cross]])
    left = np.full(len(cost), BITS) if depth is None else np.concatenate([depth[first][alone], depth[first][cross]])
    waiting = [(int(d) - 1, *(x[left == d] for x in (*front, cost))) for d in np.unique(left)]
    ones = {}
    while waiting:
        bit, alo, ahi, blo, bhi, cost = waiting.pop()
        mine = label[member]
        change = np.concatenate([[0], np.cumsum(mine[1:] != mine[:-1])])
        linked = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (mine[alo] == mine[blo])
        single = (ahi - alo == 1) & (bhi - blo == 1)
        ends = np.flatnonzero(single & ~linked)
        hit = ends[np.bitwise_count(fp[alo[ends]] ^ fp[blo[ends]]) <= BUDGET]
        merge_links(label, member[alo[hit]], member[blo[hit]])
        go = np.flatnonzero(~single & ~linked)
        if not len(go) or bit < 0:
            continue
        if len(go) > FRONT:
            waiting += [(bit, *(x[go[i: i + FRONT]] for x in (alo, ahi, blo, bhi, cost))) for i in range(0, len(go), FRONT)]
            continue
        alo, ahi, blo, bhi, cost = (x[go] for x in (alo, ahi, blo, bhi, cost))
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[bit][ahi] - ones[bit][alo]), bhi - (ones[bit][bhi] - ones[bit][blo])
        own = alo == blo
        parts = [(alo, amid, blo, bmid, cost), (amid, ahi, bmid, bhi, cost), (alo, amid, bmid, bhi, cost + 1),
                 *[tuple(x[~own] for x in (amid, ahi, blo, bmid, cost + 1))]]
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        live = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= BUDGET)
        waiting.append((bit - 1, *(x[live] for x in joined)))
    moved = np.flatnonzero(label != np.arange(len(distinct)))
    return distinct[moved], distinct[label[moved]]


def near_links(nodes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """``a, b``: links that connect exactly the distinct fingerprints (``fp``) within the error budget of each other."""
    rows = split_large(band_rows(nodes), node_rows)
    tasks = max(16, nodes.count() * 15 // TASK_ROWS)

    def run(stream):
        parts = [b for b in stream if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        key = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        fp = table["fp"].to_numpy().astype("<i8").view("<u8")
        side, err, depth = (table[c].to_numpy().astype(np.int64) for c in ("side", "err", "depth"))
        order = np.lexsort((fp, side, key))
        a, b = join_tries(fp[order], key[order], side[order], err[order], depth[order])
        yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])
        give_back()

    return rows.select("key", "fp", "side", "err", "depth").repartition(tasks, "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component, component_id``: one row per document.

    ``component_id`` is the smallest id that can be reached over fingerprints at most four bits apart, ``component`` the smallest
    fingerprint (a key for groups that have null ids only). Null texts count as empty: their fingerprint is 0, linked
    like any other. Repeated rows and ties share a fingerprint and so a component; null ids take part and never name a
    component of other rows; an empty table gives no rows; other columns are ignored.
    """
    marks = cut(fingerprints(docs, id_col, text_col, words, seed))
    nodes = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = linked_components(near_links(nodes.select("fp")))
    own = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = own.groupBy("component").agg(F.min("first").alias("component_id"))
    named = own.join(smallest, "component").select("fp", "component", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the smallest id, any one of equal rows."""
    marks = cut(near_duplicates(docs, id_col, text_col, words, seed))
    stay = (marks.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component")
            .agg(F.min("fp").alias("__fp"), F.min("doc_id").alias("__id")).drop("component"))
    times = marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__times"))
    stay = cut(stay.join(times, F.col("__id").eqNullSafe(F.col("doc_id"))).drop("doc_id"))
    carried = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("__row"))
    own = F.col("__row")[id_col].cast("long")
    once = carried.join(stay.where("__times = 1"), own.eqNullSafe(F.col("__id")), "left_semi")
    many = stay.where("__times > 1")
    if many.limit(1).count():
        # rows that share their id are told apart by their own fingerprint
        shared = carried.join(many.select(F.col("__id")).distinct(), own.eqNullSafe(F.col("__id")), "left_semi")
        fields = shared.select("__row", own.alias("doc_id"), F.coalesce(F.col("__row")[text_col], F.lit("")).alias("text"))

        def run(stream):
            for batch in stream:
                prints = [fingerprint(t, words, seed) for _, texts in batches([batch]) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("doc_id"), pa.array(np.array(prints, dtype="<u8").view("<i8"))],
                                                 names=["__row", "doc_id", "fp"])

        kind = T.StructType([*fields.schema.fields[:2], T.StructField("fp", T.LongType())])
        printed = fields.mapInArrow(run, kind).dropDuplicates(["doc_id", "fp"])
        once = once.unionByName(printed.join(many, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp")), "left_semi").select("__row"))
    return once.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
