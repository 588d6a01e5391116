import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trialframe.llm import suffix_dedup as S


def brute(rows, window):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[p: p + window] for _, t in texts for p in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - window + 1):
            if seen[t[p: p + window]] > 1:
                gone[p: p + window] = True
        kept = bytes(b for b, x in zip(t, gone, strict=False) if not x)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in frame.collect()), key=repr)


@pytest.fixture
def small_chunks(monkeypatch):
    import trialframe.llm.chunks as C

    monkeypatch.setattr(S, "chunked", lambda *a, f=C.chunked: f(*a, 6000))


@pytest.mark.parametrize(("window", "gram"), [(400, 64), (30, 8), (5, 5)])
def test_against_brute_force(docs, rows, small_chunks, window, gram):
    got = found(S.repeated_bytes(docs, window=window, gram=gram))
    assert got == brute(rows, window)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("bounds", [(0, 0), (2, 4), (10**6, 10**6)])
def test_common_passages_with_many_contexts(spark, small_chunks, monkeypatch, bounds):
    monkeypatch.setattr(S, "CHUNK_CONTEXTS", bounds[0])
    monkeypatch.setattr(S, "ALL_CONTEXTS", bounds[1])
    monkeypatch.setattr(S, "SORT_ROWS", 50)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abé \n\x00") for _ in range(n))
    passage, other = text(80), text(50)
    rows = [(i, text(rng.randint(0, 40)) + (passage if i % 2 else other)[rng.randint(0, 9): rng.randint(20, 90)] + text(rng.randint(0, 40))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(S.repeated_bytes(docs, window=24, gram=6)) == brute(rows, 24)


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 300))) for _ in range(30)] + [b"a" * 100, b"ab" * 60]
    key, at, low, high = S.all_anchors(texts, 20, 4)
    whole, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    place, starts = {}, []
    for k, x, a, b in zip(key, at, low, high, strict=True):
        for p in range(a, b + 1):
            starts.append(p)
            assert place.setdefault(whole[p: p + 20], (k, x - p)) == (k, x - p)
    wanted = [e - len(t) + p for t, e in zip(texts, ends, strict=True) for p in range(len(t) - 19)]
    assert starts == wanted


def test_range_minima():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 99, 200)
    first = rng.integers(0, 200, 500)
    last = np.minimum(199, first + rng.integers(0, 60, 500))
    assert (S.range_minima(values, first, last) == [values[a: b + 1].min() for a, b in zip(first, last, strict=True)]).all()


def test_empty(nothing):
    assert S.repeated_bytes(nothing).count() == 0
