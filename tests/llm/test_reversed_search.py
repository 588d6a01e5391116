import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.llm import reversed_search as R

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item", T.StringType()),
                      T.StructField("score", T.StringType()), T.StructField("block", T.StringType())])


def words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(docs, items, k):
    own = [(i, words(t)) for i, t in docs]
    own = [(i, w) for i, w in own if w]
    n, total = len(own), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in own:
            tf, m = Counter(w), 100 - 90 + 90 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                        for t in terms if t in tf)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if e[1] else e[2], -e[0]) for r, e in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def items_of(rows):
    texts = [r[1] for r in rows]
    return [(1, texts[5][:400], "a", "b", "c"), (2, "of the THE —", "a", "b", "c"), (3, None, "a", "b", "c"), (4, "zzz unseen", "a", "b", "c"),
            (None, "edited 日本", "a", "b", "c"), (6, texts[2], "a", "b", "c"), (6, "aab ab", "a", "b", "c"), (7, "", None, None, None), (1, "z", "a", "b", "c")]


@pytest.mark.parametrize("bounds", [(400_000, 20_000, 2_000_000), (20, 2, 7)])
def test_against_brute_force(spark, docs, rows, monkeypatch, bounds):
    for name, value in zip(("BLOCK_PLACES", "BLOCK_ITEMS", "SCORE_CELLS"), bounds, strict=True):
        monkeypatch.setattr(R, name, value)
    items = items_of(rows)
    got = R.ranked(docs, spark.createDataFrame(items, ITEMS), k=5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([r[:2] for r in rows], items, 5)


def test_repeated_rows_and_ties(spark):
    docs = [(i, "same text of all" if i % 3 else f"other words {i}") for i in range(90)] + [(4, "same text of all"), (None, "same text of all")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = [(1, "same text", "", "", ""), (2, "words", "", "", "")]
    got = R.ranked(frame, spark.createDataFrame(items, ITEMS), k=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 4)


def test_very_long_text_and_terms(spark):
    docs = [(1, "alpha " * 900_000), (2, "x" * 5_000_000 + " alpha"), (3, "beta"), (4, "alpha beta gamma")]
    items = [(1, "ALPHA beta", "", "", "")]
    got = R.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), k=10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 10)


def test_empty_tables(spark, docs, nothing, rows):
    items = spark.createDataFrame(items_of(rows), ITEMS)
    assert R.ranked(nothing, items).count() == 0
    assert R.ranked(docs, items.limit(0)).count() == 0


def test_sums_beyond_doubles():
    import numpy as np

    row, term, gain = np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([2**60 + 1, 3, 5])
    first, items = np.array([0, 2, 3]), np.array([0, 1, 1])
    assert R.summed(row, term, gain, first, items, 2, 2, True).tolist() == [[2**60 + 1, 2**60 + 4], [5, 5]]
    assert R.summed(row, term, np.array([7, 3, 5]), first, items, 2, 2, False).tolist() == [[7, 10], [5, 5]]


def test_terms_agree_with_the_pattern(spark):
    text = "".join(chr(c) for c in [*range(0, 300), 0x2003, 0x65E5, 0x1F600]) + " Ab9_c"
    pattern = F.regexp_extract_all(F.translate("t", R.UPPER, R.UPPER.lower()), F.lit(R.TERMS), F.lit(0))
    found = spark.createDataFrame([(text,)], "t string").select(pattern.alias("x")).first()["x"]
    assert [t.encode() for t in found] == R.terms(text.encode()) == [w.encode() for w in words(text)]
