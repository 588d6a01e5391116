import hashlib
import re

import numpy as np
import pytest

from trialframe.llm import substring_dedup as S


def brute(rows, window):
    docs = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    first = {}
    for i, words in docs:
        for p in range(len(words) - window + 1):
            key, rank = tuple(words[p: p + window]), (i is None, i or 0)
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, words in docs:
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p: p + window])] < (i is None, i or 0):
                gone.update(range(p, p + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        runs = [k for k in sorted(gone) if k - 1 not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), len(runs)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 3, 13])
def test_against_brute_force(docs, rows, window, monkeypatch):
    import trialframe.llm.chunks as C

    monkeypatch.setattr(C, "chunked", lambda *a, f=C.chunked: f(*a[:3], 5000))
    monkeypatch.setattr(S, "chunked", lambda *a, f=C.chunked: f(*a))
    found = S.repeated_spans(docs, window=window)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, len(r.spans)) for r in found.collect()), key=repr)
    assert got == brute(rows, window)
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def test_spans_and_kept_words(docs):
    for r in S.repeated_spans(docs, window=5).collect():
        assert sum(s.end - s.first for s in r.spans) == r.n_removed
        assert len(r.kept.split(" ")) == r.n_words - r.n_removed or not r.kept
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_frequent_prefixes_are_split(docs, rows, monkeypatch):
    monkeypatch.setattr(S, "GROUP_SHARE", 10**9)
    got = sorted(((r.doc_id, r.n_removed) for r in S.repeated_spans(docs, window=9).collect()), key=repr)
    assert got == sorted(((r[0], r[2]) for r in brute(rows, 9)), key=repr)


def test_empty(nothing):
    assert S.repeated_spans(nothing).count() == 0


def test_orders_by_single_sorts_equal_the_lexical_ones():
    rng = np.random.default_rng(1)
    for labels in (1 << 60, 40, 1):
        first = rng.integers(0, labels, 500).astype(np.uint64)
        for second in (first * np.uint64(3), rng.integers(0, 3, 500).astype(np.uint64)):
            assert (S.by_label(first, second) == np.lexsort((second, first))).all()
    for buckets in (1, 64, 70_000):
        one = rng.permutation(900)[:500]
        bucket = rng.integers(0, buckets, 500)
        assert (S.by_bucket(one, bucket, 900) == np.lexsort((one, bucket))).all()
    assert len(S.by_bucket(one[:0], bucket[:0], 900)) == len(S.by_label(first[:0], first[:0])) == 0
