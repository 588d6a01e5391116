"""Chunks of documents that talk to buckets of keys.

An operator that compares all windows of all texts works in rounds: every chunk of documents (some megabytes, dealt by a hash of
the row) sends one packed message to each bucket of keys, the bucket compares what it got and answers every chunk, and
the chunk goes on from the answers. Messages are compressed arrays, so a round costs a few bytes per window. All rounds read
the same chunks, which Spark shuffles once and reuses.
"""

from __future__ import annotations

import pickle
import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import CHUNK_BYTES, id_and_text, total_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MESSAGE = "chunk long, bucket int, data binary"
#: stands for a null id: after all others
NO_ID = np.iinfo("<i8").max


def pack(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``chunk, doc_id, text`` and the bytes of all texts."""
    own = id_and_text(docs, id_col, text_col)
    size = total_bytes(own)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // chunk_bytes))))
    return own.select(chunk.alias("chunk"), "doc_id", "text"), size


def rows_of(table: pa.Table) -> tuple[int, list, list[bytes]]:
    """A chunk's number, and its ids and texts in an order that is the same in every round."""
    texts = table["text"].cast(pa.large_binary()).to_pylist()
    ids = table["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return table["chunk"][0].as_py(), [ids[i] for i in order], [texts[i] for i in order]


def messages(chunk: int, parts: dict[int, tuple]) -> pa.Table:
    return pa.table({
        "chunk": pa.array([chunk] * len(parts), type=pa.int64()), "bucket": pa.array(list(parts), type=pa.int32()),
        "data": pa.array([pack(*p) for p in parts.values()], type=pa.binary()),
    })


def answers(bucket: int, parts: dict[int, tuple]) -> pa.Table:
    return pa.table({
        "chunk": pa.array(list(parts), type=pa.int64()), "bucket": pa.array([bucket] * len(parts), type=pa.int32()),
        "data": pa.array([pack(*p) for p in parts.values()], type=pa.binary()),
    })


def received(table: pa.Table, by: str) -> dict[int, tuple]:
    """The arrays of each message, by its chunk or bucket."""
    found = sorted(zip(table[by].to_pylist(), table["data"].to_pylist(), strict=True), key=lambda x: x[0])
    return {k: unpack(d) for k, d in found}


def send(chunks: DataFrame, f) -> DataFrame:
    """First round: ``f(chunk, ids, texts)`` gives the message to each bucket."""
    def run(table: pa.Table) -> pa.Table:
        chunk, ids, texts = rows_of(table)
        return messages(chunk, f(chunk, ids, texts))

    return chunks.groupBy("chunk").applyInArrow(run, MESSAGE)


def resend(chunks: DataFrame, replies: DataFrame, f) -> DataFrame:
    """A later round: ``f(chunk, ids, texts, replies)`` gives the next messages."""
    def run(table: pa.Table, replied: pa.Table) -> pa.Table:
        chunk, ids, texts = rows_of(table)
        return messages(chunk, f(chunk, ids, texts, received(replied, "bucket")))

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, MESSAGE)


def compare(sent: DataFrame, f) -> DataFrame:
    """What buckets do: ``f`` gets the messages of all chunks and gives the answer to each."""
    def run(table: pa.Table) -> pa.Table:
        return answers(table["bucket"][0].as_py(), f(received(table, "chunk")))

    return sent.groupBy("bucket").applyInArrow(run, MESSAGE)


def finish(chunks: DataFrame, replies: DataFrame, f, schema: str) -> DataFrame:
    """The last step: ``f(ids, texts, replies)`` gives the columns of the result."""
    def run(table: pa.Table, replied: pa.Table) -> pa.Table:
        chunk, ids, texts = rows_of(table)
        return f(ids, texts, received(replied, "bucket"))

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def parts_by_bucket(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """Runs of equal values in a sorted array of bucket numbers."""
    if not len(bucket):
        return []
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(first, [*first[1:], len(bucket)], strict=True)]
