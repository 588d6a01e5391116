"""Ranked lexical search, reversed: the items' terms are indexed, the documents stream past.

An inverted index over the terms of the items (queries) goes to every task. One pass over the documents counts what the weights
need: documents, terms, and the documents that hold each term of an item. A second pass streams each document's term
counts through the index, adds up its score for every item, and keeps a bounded heap per item and task; heaps are merged in two
levels. Items whose index would pass a bound are searched in several blocks, one pass each, so that what is
broadcast and what a task holds does not grow with the items.
"""

from __future__ import annotations

import heapq
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.llm.common import batches, give_back
from trialframe.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: fixed values: k1 and b in hundredths, as the score's integer form has them
SATURATION, LENGTH_SHARE = 8, 90
#: places in the index (an item holding a term) of one block of items, and items of one block
BLOCK_PLACES, BLOCK_ITEMS = 400_000, 20_000
#: scores that a task holds at a time, and spread of the first merge
SCORE_CELLS, SPREAD = 2_000_000, 64
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes that belong to terms stay (A to Z as small letters), all others become spaces
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HEAP = "item int, score long, doc_id long"


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters, with A to Z as small letters."""
    return text.translate(FOLD).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term``: the distinct terms of each item; rows with one id are one item; null texts have none."""
    folded = F.translate(F.coalesce(col(text_col), F.lit("")), UPPER, UPPER.lower())
    found = F.array_distinct(F.regexp_extract_all(folded, F.lit(TERMS), F.lit(0)))
    return items.select(col(id_col).alias("item_id"), F.explode(found).alias("term")).distinct()


def numbered_blocks(wanted: DataFrame, places: int, most_items: int) -> tuple[DataFrame, int]:
    """``item_id, item, block``: items in numbered blocks, so that a block has few enough items and places in the index."""
    sizes = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("places"))
    total, count = sizes.agg(F.sum("places"), F.count(F.lit(1))).first()
    # a block of twice the mean stays below the bounds
    n = max(1, -(-2 * (total or 0) // places) if (total or 0) > places else 1, -(-2 * count // most_items) if count > most_items else 1)
    block = F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")
    number = F.row_number().over(Window.partitionBy("block").orderBy("item_id")).cast("int") - 1
    return sizes.withColumn("block", block).withColumn("item", number).select("item_id", "item", "block"), n


def counted(docs: DataFrame, known: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, their terms with repeats, and the documents that hold each of the known terms."""
    index = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(known)})

    def run(stream):
        place = index.value
        holding, total, length = np.zeros(len(place), dtype=np.int64), 0, 0
        for _, texts in batches(stream):
            for text in texts:
                words = terms(text)
                if words:
                    total += 1
                    length += len(words)
                    hits = [place[w] for w in set(words) if w in place]
                    holding[hits] += 1
        at = np.flatnonzero(holding)
        give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([holding[at], [total, length]]))],
            names=["term", "n"])

    sums = docs.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}  # one row per term of the block's index
    return found.get(-1, 0), found.get(-2, 0), {t: found.get(i, 0) for i, t in enumerate(known)}


def heaps(docs: DataFrame, index: dict, k: int) -> DataFrame:
    """``item, score, doc_id``: each task's best ``k`` documents of every item, out of bounded heaps."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(stream):
        own = sent.value
        place, weight, first, items, n_items = own["place"], own["weight"], own["first"], own["items"], own["n_items"]
        documents, length, wide = own["documents"], own["length"], own["wide"]
        best: list[list] = [[] for _ in range(n_items)]
        least = np.zeros(n_items, dtype=np.int64)
        rows = max(1, SCORE_CELLS // max(n_items, 1))
        for ids, texts in batches(stream):
            for begin in range(0, len(ids), rows):
                row, term, tf, norm = [], [], [], []
                part = texts[begin:begin + rows]
                for r, text in enumerate(part):
                    words = terms(text)
                    if not words:
                        continue
                    counts: dict[int, int] = {}
                    for w in words:
                        t = place.get(w)
                        if t is not None:
                            counts[t] = counts.get(t, 0) + 1
                    m = 100 - LENGTH_SHARE + LENGTH_SHARE * len(words) * documents // length
                    row += [r] * len(counts)
                    term += counts.keys()
                    tf += counts.values()
                    norm += [m] * len(counts)
                if not row:
                    continue
                term, tf = np.array(term), np.array(tf, dtype=np.int64)
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * np.array(norm, dtype=np.int64)))
                scores = summed(np.array(row), term, gain, first, items, len(part), n_items, wide)
                # ties with a full heap's last entry may still win by their id
                at, who = np.nonzero((scores >= least) & (scores > 0))
                for r, item, score in zip(at.tolist(), who.tolist(), scores[at, who].tolist(), strict=True):
                    i = ids[begin + r]
                    entry, heap = (score, i is not None, -i if i is not None else 0), best[item]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == k:
                        least[item] = heap[0][0]
        out = [(i, e[0], -e[2] if e[1] else None) for i, heap in enumerate(best) for e in heap]
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], type=pa.int32()), pa.array([o[1] for o in out], type=pa.int64()),
                                          pa.array([o[2] for o in out], type=pa.int64())], names=["item", "score", "doc_id"])

    return docs.mapInArrow(run, HEAP)


def summed(row, term, gain, first, items, n_rows: int, n_items: int, wide: bool) -> np.ndarray:
    """Scores of a block of documents: each term's gain goes to all items that hold the term (places ``first[t]`` to ``first[t+1]``)."""
    scores = np.zeros(n_rows * n_items, dtype=np.int64)
    places = first[term + 1] - first[term]
    ends = np.cumsum(places)
    begin = 0
    while begin < len(term):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + SCORE_CELLS, side="right")))
        n = places[begin:end]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[term[begin:end]], n)
        cell, value = np.repeat(row[begin:end], n) * n_items + items[at], np.repeat(gain[begin:end], n)
        if wide:
            np.add.at(scores, cell, value)
        else:  # doubles hold these sums exactly
            scores += np.bincount(cell, weights=value, minlength=len(scores)).astype(np.int64)
        begin = end
    return scores.reshape(n_rows, n_items)


def search_block(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``item, rank, doc_id, score`` for the items of one block (``item, term``)."""
    posted: dict[str, list[int]] = {}
    for r in wanted.collect():  # at most a block's places
        posted.setdefault(r["term"].encode(), []).append(r["item"])
    known = sorted(posted)
    documents, length, holding = counted(docs, known)
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1))) for t in known]
    lists = [sorted(posted[t]) for t in known]
    n_items = 1 + max((p[-1] for p in lists), default=-1)
    per_item = np.bincount(np.concatenate([np.array(p) for p in lists]), minlength=1).max() if lists else 0
    index = {
        "place": {t: i for i, t in enumerate(known)}, "weight": np.array(weight, dtype=np.int64),
        "first": np.concatenate([[0], np.cumsum([len(p) for p in lists])]).astype(np.int64),
        "items": np.array([i for p in lists for i in p], dtype=np.int64), "n_items": n_items,
        "documents": documents, "length": max(length, 1), "wide": float(max(weight, default=0)) * 1e6 * float(per_item) >= 2.0**53,
    }
    found = heaps(docs, index, k)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # heaps of many tasks are merged in groups first
    some = found.withColumn("part", F.spark_partition_id() % SPREAD).withColumn(
        "nth", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("nth") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, scores above 0, ties to the smaller id.

    Every row of ``docs`` is a document, rows with equal or null ids too (null ids come last among ties); null and empty texts have no
    terms and are not found. Rows of items with one id are one item with the terms of all; items without terms, or that no
    document scores for, give no rows. Whole texts of any length count; other columns are ignored.
    """
    own = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).where("text is not null")
    wanted = cut(item_terms(items, item_col, item_text))
    blocks, n = numbered_blocks(wanted, BLOCK_PLACES, BLOCK_ITEMS)
    blocks = cut(blocks)
    same = wanted.join(blocks, wanted["item_id"].eqNullSafe(blocks["item_id"])).select("block", "item", "term")
    out = None
    for b in range(n):
        names = blocks.where(F.col("block") == b).select("item_id", "item")
        part = search_block(own, same.where(F.col("block") == b).select("item", "term"), k).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
