"""Helpers shared by the corpus operators: batches of text, words, chunks and linked components."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.session import cut

# functions that run in tasks travel with them, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: bytes that separate words; all other bytes belong to words
SPACES = r"[\x20\x09-\x0D]+"
#: text bytes that a task holds at a time
BATCH_BYTES = 4 << 20
#: text bytes of one chunk of documents that is grouped under one key
CHUNK_BYTES = 8 << 20


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, for tokenizers and memos shared by its tasks."""
    return sys.modules.setdefault("_trialframe_worker", types.ModuleType("_trialframe_worker")).__dict__


def give_back() -> None:
    """Return free memory to the system: Spark reuses Python workers, which keep what an earlier task needed at its height."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; extra columns and clashing names stay outside."""
    return docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))


def batches(stream, limit: int = BATCH_BYTES):
    """Pairs of ids and texts as bytes, at most ``limit`` bytes or one document at a time."""
    for batch in stream:
        texts = batch.column("text").cast(pa.large_binary()) if batch.num_rows else None
        if texts is None:
            continue
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
        ids, begin = batch.column("doc_id").to_pylist(), 0
        while begin < len(ids):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, side="right")) - 1)
            yield ids[begin:end], texts.slice(begin, end - begin).to_pylist()
            begin = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def chunk_of(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Column:
    """A chunk number spread over documents by their id; chunks hold about ``chunk_bytes`` of text."""
    chunks = max(1, -(-total_bytes(docs) // chunk_bytes))
    return F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk")


def linked_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node`` and the smallest node reachable from it (``component``), for every node with an edge.

    ``edges`` has the columns ``a`` and ``b``. Each round hooks every node to the smallest component next to it and then
    follows the components' own pointers; tables between rounds lie in the shared folder.
    """
    both = cut(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b"), F.col("a")).where("a <> b")).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(rounds):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("near"))
        hooked = label.join(near, label.node == near.a).select("node", F.least("component", "near").alias("target"), "component")
        # a pointer that improves also pulls the node it pointed at before
        pulled = hooked.select(F.col("component").alias("node"), "target").union(hooked.select("node", "target"))
        moved = pulled.groupBy("node").agg(F.min("target").alias("target"))
        jump = moved.select(F.col("node").alias("place"), F.col("target").alias("next"))
        new = cut(moved.join(jump, F.col("target") == F.col("place")).select("node", F.least("target", "next").alias("component")))
        changed = new.alias("n").join(label.alias("o"), "node").where("n.component <> o.component").limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError(f"components did not settle within {rounds} rounds")
