"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text becomes a sparse vector: its words and marks (runs of letters and digits, runs of other visible characters), their
pairs, and marks for a word that repeats the one or two before it, each hashed to one of ``2 ** bits`` places with a weight from its
share of the text. Training passes over a bounded sample of labelled rows in one small task; scoring is one sparse dot
product per text in the tasks that read the texts, with the weights (of fixed size) shipped along.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.llm.common import batches, give_back, id_and_text, mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: places of the hashed features; the weights take 4 bytes each, whatever the size of the corpus
FEATURE_BITS = 18
#: labelled rows that a classifier is fitted on at most, and characters of text among them
SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 40_000_000
#: text bytes that are scored at a time
SCORE_BYTES = 1 << 20
#: rows per update, passes, and the constants of the updates
STEP_ROWS, PASSES, ALPHA, BETA, L1, L2 = 16, 4, 0.5, 1.0, 0.02, 0.2


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature places, their values and the first position of each text (one more than texts) in these arrays."""
    part = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")
    known: dict[bytes, int] = {}
    codes, lengths = [], []
    for text in texts:
        found = part.findall(text.lower())
        lengths.append(len(found))
        codes += [known.setdefault(w, len(known)) for w in found]
    words = list(known)
    base = np.array([int.from_bytes(w[:8], "little") ^ (int.from_bytes(w[8:16], "little") * 0x9E3779B97F4A7C15 + len(w)) & 0xFFFFFFFFFFFFFFFF
                     for w in words], dtype=np.uint64)
    base = mixed(base) if len(base) else base
    one = base[np.array(codes, dtype=np.int64)] if codes else np.array([], dtype=np.uint64)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    same_text = text_of[1:] == text_of[:-1]
    two = mixed(one[:-1] * np.uint64(3) + one[1:])[same_text]
    again = (one[1:] == one[:-1]) & same_text
    thrice = again[1:] & again[:-1] & (text_of[2:] == text_of[:-2]) if len(again) else again
    marks = mixed(np.repeat(np.array([1, 2], dtype=np.uint64), [again.sum(), thrice.sum()]))
    size = np.zeros(len(texts), dtype=np.int64) + np.array(lengths, dtype=np.int64)
    steps = mixed(np.uint64(7) + np.log2(size + 1).astype(np.uint64))
    of = np.concatenate([text_of, text_of[1:][same_text], text_of[1:][again], text_of[2:][thrice] if len(thrice) else [], np.arange(len(texts))]).astype(np.int64)
    kind = np.concatenate([one, two, marks, steps])
    # a text's own features, each once, weighted by the root of its share
    place = (kind >> np.uint64(64 - bits)).astype(np.int64)
    cell, count = np.unique(of * (1 << bits) + place, return_counts=True)
    owner = cell >> bits
    value = np.sqrt(count / np.maximum(size, 1)[owner])
    return cell & ((1 << bits) - 1), value.astype(np.float32), np.searchsorted(owner, np.arange(len(texts) + 1))


def train(texts: list[bytes], labels: np.ndarray, bits: int = FEATURE_BITS, seed: int = 7) -> np.ndarray:
    """Weights by per-coordinate follow-the-regularised-leader steps over small groups of rows."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    if not len(labels):
        return z.astype(np.float32)
    # a few texts at a time, so that only the features themselves are held together
    parts = []
    for i in range(0, len(texts), 256):
        place, value, begin = features(texts[i: i + 256], bits)
        parts.append((place.astype(np.int32), value, np.diff(begin)))
    place, value, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    begin = np.concatenate([[0], np.cumsum(size)])
    rng = np.random.default_rng(seed)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    for _ in range(PASSES):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), STEP_ROWS):
            rows = order[i: i + STEP_ROWS]
            spans = [np.arange(begin[r], begin[r + 1]) for r in rows]
            at, owner = np.concatenate(spans), np.repeat(np.arange(len(rows)), [len(s) for s in spans])
            w = weights(place[at])
            p = 1 / (1 + np.exp(-np.bincount(owner, w * value[at], minlength=len(rows))))
            spot, back = np.unique(place[at], return_inverse=True)
            g = np.bincount(back, ((p - labels[rows])[owner] * value[at]), minlength=len(spot))
            sigma = (np.sqrt(n[spot] + g * g) - np.sqrt(n[spot])) / ALPHA
            z[spot] += g - sigma * weights(spot)
            n[spot] += g * g
    return weights(np.arange(1 << bits)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        held_out: Column | None = None, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> np.ndarray:
    """Weights fitted on at most ``sample_rows`` labelled rows outside ``held_out`` (over ``doc_id``), drawn by a hash of the id.

    Null labels, and ids with more than one label, teach nothing.
    """
    ids = (labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("int").alias("label"))
           .where("doc_id is not null and label in (0, 1)"))
    if held_out is not None:
        ids = ids.where(~held_out)
    ids = ids.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    drawn = ids.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample_rows)
    # one text for each drawn id, so that repeated rows add nothing to the bound
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        fits = pdf["text"].str.len().cumsum() <= sample_chars
        pdf = pdf[fits | (np.arange(len(pdf)) == 0)]
        w = train([t.encode() for t in pdf["text"]], pdf["label"].to_numpy(dtype=np.float64))
        give_back()
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()]})

    found = texts.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "weights binary").first()
    return np.frombuffer(found[0], dtype="<f4") if found else np.zeros(1 << FEATURE_BITS, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the probability of label 1 for every row's whole text, null texts as empty."""
    bits = int(len(weights)).bit_length() - 1
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def run(stream):
        for ids, texts in batches(stream, SCORE_BYTES):
            place, value, begin = features(texts, bits)
            owner = np.repeat(np.arange(len(texts)), np.diff(begin))
            dot = np.bincount(owner, shipped.value[place] * value, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(1 / (1 + np.exp(-dot)))], names=["doc_id", "score"])
        give_back()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least ``least``, with all their columns."""
    rows = docs.withColumn("__row", F.struct(*[col(c) for c in docs.columns]))
    rows = rows.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), "__row")
    bits = int(len(weights)).bit_length() - 1
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def run(stream):
        for batch in stream:
            good = []
            for _, texts in batches([batch], SCORE_BYTES):
                place, value, begin = features(texts, bits)
                owner = np.repeat(np.arange(len(texts)), np.diff(begin))
                dot = np.bincount(owner, shipped.value[place] * value, minlength=len(texts))
                good.append(1 / (1 + np.exp(-dot)) >= least)
            if good:
                yield batch.select(["__row"]).filter(pa.array(np.concatenate(good)))
        give_back()

    return rows.mapInArrow(run, rows.select("__row").schema).select("__row.*")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, least: float = 0.3, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per document, scored from its whole text alone.

    ``held_out`` (over ``doc_id``) marks rows whose labels are never learned from. Null and empty texts get the score of an
    empty text, null ids are scored and not held out, repeated rows get equal scores, without any labels all scores are
    one half, an empty table gives no rows; other columns are ignored.
    """
    weights = fit(docs, labels, label_col, id_col, text_col, F.coalesce(held_out, F.lit(False)))
    return score(docs, weights, id_col, text_col).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
