import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trialframe.llm import mixing as M


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, fixed = set(s for s in names if sizes[s]), {}
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return sizes, fixed | share
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left.discard(s)


def test_taken_words_meet_the_targets(docs, rows, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 300)
    sizes, goal = wanted(rows)
    got = M.taken_words(docs).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((r[0], size(r[1]), r[3]) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s, t in goal.items():
        assert abs(taken[s] - t) <= 1
    key = lambda x: sorted(str(tuple(r)) for r in x)
    assert all(len(r.shards) <= 2 for r in got)
    assert key(got) == key(M.taken_words(docs.repartition(5)).collect())


def test_targets_stop_at_twice_the_size():
    got = M.targets([10, 1000, 1000], [3.0, 1.0, 2.0])
    assert got[0] == 20 and abs(sum(got) - 1.5 * 2010) < 1e-6 and all(t <= 2 * s for t, s in zip(got, [10, 1000, 1000]))
    assert M.targets([], []) == [] and M.targets([0, 5], [3.0, 1.0]) == [0.0, 7.5]


@pytest.mark.parametrize("shards", [1, 2, 5, 16, 33])
def test_shard_quotas_partition_the_blocks(shards):
    counts = [100, 0, 7, 400, 1]
    leaves = [M.shard_quotas(counts, i, shards, 5) for i in range(shards)]
    assert [sum(x) for x in zip(*leaves)] == counts
    totals = [sum(x) for x in leaves]
    assert max(totals) - min(totals) <= 2
    assert leaves == [M.shard_quotas(counts, i, shards, 5) for i in range(shards)]


def test_draws_are_hypergeometric():
    first = [M.shard_quotas([30, 10], 0, 2, seed)[1] for seed in range(2000)]
    # of 40 blocks 20 are drawn: mean 5, variance 20 * 1/4 * 3/4 * 20/39
    assert abs(np.mean(first) - 5) < 0.12 and abs(np.var(first) - 75 / 39) < 0.25


def test_blocks_of_shards_are_disjoint(docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 100)
    monkeypatch.setattr(M, "SHARD_BLOCKS", 8)
    rows = docs.select(*M.sized(docs, "doc_id", "text", "source", 5))
    got = M.taken_blocks(M.in_blocks(rows, M.source_plan(rows, (3.0, 1.0, 2.0), 1.5, 2.0)), 5).collect()
    assert len({(r.place, r["pass"], r.block) for r in got}) == len(got)
    assert len({r.shard for r in got}) > 3


def test_leaves_decide(docs, monkeypatch):
    """A leaf of the tree that draws nothing leaves its blocks out of the mix."""
    monkeypatch.setattr(M, "BLOCK_WORDS", 100)
    monkeypatch.setattr(M, "SHARD_BLOCKS", 8)
    right = M.taken_words(docs).collect()
    shards = {x for r in right for x in r.shards}
    assert len(shards) > 3 and all((r.taken > 0) == bool(r.shards) and len(r.shards) <= 2 for r in right)
    quotas = M.shard_quotas
    monkeypatch.setattr(M, "shard_quotas", lambda q, shard, n, seed: [0] * len(q) if shard == 1 else quotas(q, shard, n, seed))
    wrong = M.taken_words(docs).collect()
    assert sum(r.taken for r in wrong) < sum(r.taken for r in right)


def test_mixed_documents(docs, rows, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 300)
    _, goal = wanted(rows)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += size(r.text)
    assert all(abs(words[s] - t) <= 1 for s, t in goal.items())


def test_empty(nothing):
    assert M.taken_words(nothing).count() == 0
    assert M.mixed_documents(nothing).count() == 0
