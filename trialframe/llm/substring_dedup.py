"""Removal of repeated passages of words by prefix-partitioned suffix trees.

Every suffix of every document (cut after ``window`` words) belongs to the group of its shortest prefix that is rare enough:
a census counts prefixes of one, two, four and eight words, and a group takes a prefix only if its suffixes fit a fraction
of one bucket. Groups are dealt to buckets; a bucket sorts the suffixes of its subtrees by their path labels, and inner nodes
at depth ``window`` - labels that several suffixes share - are the repeats. Chunks send each path label once with its first
document, so a passage that a third of all documents share arrives once per chunk.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.chunks import NO_ID, chunked, compare, finish, parts_by_bucket, send
from trialframe.llm.common import batches, id_and_text, mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: prefix lengths of the census and counters per length
LEVELS, BINS = (1, 2, 4, 8), 1 << 12
#: suffixes of one bucket, least number of buckets, and the largest group as a share of a bucket
BUCKET_SUFFIXES, LEAST_BUCKETS, GROUP_SHARE = 1_000_000, 64, 4


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word of all texts in a row, and the words before each text."""
    # every word is hashed where it stands, which is quicker than looking up a number for it
    own = [b"".join(map(xxhash.xxh3_128_digest, t.split())) for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(x) // 16 for x in own], dtype=np.int64)])
    digests = np.frombuffer(b"".join(own), dtype="<u8").reshape(-1, 2)
    return np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1]), begin


def window_starts(begin: np.ndarray, window: int) -> np.ndarray:
    """Positions at which a whole window begins inside its text."""
    sizes = np.maximum(np.diff(begin) - window + 1, 0)
    shift = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(begin[:-1] - shift, sizes)


def labels(a: np.ndarray, b: np.ndarray, starts: np.ndarray, window: int, levels: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Two digests of each window's path label, and one of its prefix at every level."""
    first, second, prefixes = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.uint64), []
    for i in range(window):
        first = first * np.uint64(0x9E3779B97F4A7C15) + a[starts + i]
        second = second * np.uint64(0xC2B2AE3D27D4EB4F) + b[starts + i]
        if i + 1 in levels:
            prefixes.append(mixed(first + np.uint64(i)))
    return mixed(first), mixed(second), prefixes


def by_label(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of the windows in a stable order by both digests of their labels; the second rarely decides."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        return np.lexsort((second, first))
    return order


def by_bucket(one: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Order of different places below ``n`` by their buckets, then by place."""
    at = np.full(n, -1, dtype=np.int64)
    at[one] = np.arange(len(one))
    at = at[at >= 0]
    return at[np.argsort(bucket[at].astype(np.min_scalar_type(int(bucket.max(initial=0)))), kind="stable")]


def census(docs: DataFrame, window: int, levels: tuple[int, ...]) -> np.ndarray:
    """Suffixes per level and counter over all documents; the counters' number is fixed."""
    def run(stream):
        total = np.zeros((len(levels), BINS), dtype=np.int64)
        for _, texts in batches(stream):
            a, b, begin = coded(texts)
            for row, p in zip(total, labels(a, b, window_starts(begin, window), max(levels, default=0), levels)[2], strict=True):
                row += np.bincount((p >> np.uint64(52)).astype(np.int64), minlength=BINS)
        level, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level * BINS + place), pa.array(total[level, place])], names=["counter", "n"])

    out = np.zeros(len(levels) * BINS, dtype=np.int64)
    for r in docs.mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        out[r["counter"]] = r["n"]
    return out.reshape(len(levels), BINS)


def group_buckets(prefixes: list[np.ndarray], whole: np.ndarray, counts: np.ndarray, bound: int, buckets: int) -> np.ndarray:
    """The bucket of each suffix: by its shortest prefix within the bound, or by its whole label."""
    group = whole.copy()
    open_ = np.ones(len(whole), dtype=bool)
    for level, p in enumerate(prefixes):
        fits = open_ & (counts[level][(p >> np.uint64(52)).astype(np.int64)] <= bound)
        group[fits] = p[fits] + np.uint64(level + 1)
        open_ &= ~fits
    return (mixed(group) % np.uint64(buckets)).astype(np.int64)


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int, f, schema: str) -> DataFrame:
    """``f(ids, texts, begin, starts, removed)`` per chunk, where ``removed`` marks windows that start in a document with a smaller id."""
    chunks, _ = chunked(docs, id_col, text_col)
    levels = tuple(n for n in LEVELS if n < window)
    counts = census(id_and_text(docs, id_col, text_col), window, levels)
    total = int(counts[0].sum()) if levels else 0
    buckets = max(LEAST_BUCKETS, total // BUCKET_SUFFIXES)
    bound = max(1, total // buckets // GROUP_SHARE)

    def suffixes(ids, texts):
        """Distinct labels in the order of their buckets and first documents, and each window's place among them."""
        a, b, begin = coded(texts)
        starts = window_starts(begin, window)
        first, second, prefixes = labels(a, b, starts, window, levels)
        doc = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        owner = doc[np.searchsorted(begin, starts, side="right") - 1] if len(starts) else starts
        bucket = group_buckets(prefixes, first, counts, bound, buckets)
        # documents come in the order of their ids, so the first window of a label has the smallest id
        order = by_label(first, second)
        fresh = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])[: len(order)]
        one = order[fresh]
        rank = by_bucket(one, bucket[one], len(starts))
        place = np.empty(len(one), dtype=np.int64)
        place[rank] = np.arange(len(one))
        of = np.empty(len(starts), dtype=np.int64)
        of[order] = place[np.cumsum(fresh) - 1] if len(order) else 0
        one = one[rank]
        return begin, starts, owner, of, first[one], second[one], owner[one], bucket[one]

    def tell(chunk, ids, texts):
        *_, first, second, doc, bucket = suffixes(ids, texts)
        out = {}
        for k, at in parts_by_bucket(bucket):
            own, n = np.unique(doc[at], return_counts=True)
            # 80 bits of the label; its group adds the bits of the bucket
            out[k] = (first[at], (second[at] >> np.uint64(48)).astype(np.uint16), np.diff(own, prepend=0), n.astype(np.uint32))
        return out

    def subtrees(parts):
        first, second = (np.concatenate([p[i] for p in parts.values()]) for i in (0, 1))
        doc = np.concatenate([np.repeat(np.cumsum(p[2]), p[3]) for p in parts.values()])
        order = by_label(first, second)
        node = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])
        smallest = np.minimum.reduceat(doc[order], np.flatnonzero(node))[np.cumsum(node) - 1]
        later = np.empty(len(doc), dtype=bool)
        later[order] = smallest < doc[order]
        ends = np.cumsum([len(p[0]) for p in parts.values()])
        return {k: (np.packbits(x),) for k, x in zip(parts, np.split(later, ends[:-1]), strict=True)}

    def last(ids, texts, replies):
        begin, starts, owner, of, first, _, doc, bucket = suffixes(ids, texts)
        later = np.zeros(len(first), dtype=bool)
        for k, at in parts_by_bucket(bucket):
            later[at] = np.unpackbits(replies[k][0], count=at.stop - at.start).astype(bool)
        return f(ids, texts, begin, starts, (owner > doc[of]) | later[of])

    return finish(chunks, compare(send(chunks, tell), subtrees), last, schema)


def covered(size: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``size`` places lie in a window that begins at one of ``starts``."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end positions of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256, spans``: one row per row of ``docs``.

    ``spans`` are the maximal runs of removed words (first word and end), ``kept`` the words that stay, joined by one space.
    A word is removed if a window of ``window`` words over it also starts in a document with a smaller id, judged on the input.
    Null and empty texts have no words; rows with one id never remove each other; null ids come after all others; an empty
    table gives no rows; other columns are ignored.
    """
    def last(ids, texts, begin, starts, removed):
        gone = covered(int(begin[-1]), starts[removed], window)
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept", "kept_sha256", "spans")}
        for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
            own = text.split()
            mask = gone[begin[i]: begin[i + 1]]
            kept = b" ".join([w for w, x in zip(own, mask, strict=True) if not x] if mask.any() else own)
            first, end = spans(mask)
            for k, v in zip(out, (doc, len(own), int(mask.sum()), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest(),
                                  [{"first": int(x), "end": int(y)} for x, y in zip(first, end, strict=True)]), strict=True):
                out[k].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
        return pa.table({k: pa.array(v, type=t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return repeated_windows(docs, id_col, text_col, window, last,
                            "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, spans array<struct<first:long,end:long>>")
