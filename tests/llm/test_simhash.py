import random
import re

import numpy as np
import pytest
import xxhash

from trialframe.llm import simhash as S
from trialframe.llm.common import linked_components


def print_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest index reachable over pairs within four bits, by brute force."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_whole_operator(docs, rows):
    got = sorted(((r.doc_id if r.doc_id is not None else 10**9, r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(docs).collect()))
    ordered = sorted(rows, key=lambda r: r[0] if r[0] is not None else 10**9)
    prints = [print_of(r[1]) for r in ordered]
    roots = components(prints)
    assert got == sorted((r[0] if r[0] is not None else 10**9, p, ordered[k][0]) for r, p, k in zip(ordered, prints, roots, strict=True))


def test_one_row_of_each_group_stays(docs, rows):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ordered = sorted(rows, key=lambda r: r[0] if r[0] is not None else 10**9)
    roots = components([print_of(r[1]) for r in ordered])
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(ordered[k][0]) for k in set(roots))


def test_rows_with_one_id_and_several_texts(spark):
    texts = [" ".join(random.Random(i).choices("abcdefgh", k=40)) for i in range(4)]
    rows = [(1, texts[0], "x"), (1, texts[1], "y"), (1, texts[1], "y"), (None, texts[2], "z"), (None, texts[3], "w"), (None, texts[3], "w"), (2, texts[0], "v")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame(
        [rows[0], rows[1], rows[3], rows[4]], "doc_id long, text string, fp string").collect()))


def test_a_single_null_id_keeps_its_own_text(spark):
    texts = [" ".join(random.Random(i).choices("abcdefgh", k=40)) for i in range(3)]
    rows = [(1, texts[0]), (2, texts[0]), (None, texts[1]), (3, texts[2])]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def crowd(seed, n):
    """Fingerprints with dense balls, chains and strangers."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        base = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(sorted(out))
        for _ in range(rng.randint(1, 6)):
            base ^= 1 << rng.randrange(64)
        out.add(base)
    return sorted(out)


@pytest.mark.parametrize("bound", [5, 20_000])
def test_links_connect_what_brute_force_connects(spark, bound):
    prints = crowd(2, 400)
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = S.near_links(nodes, node_rows=bound)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links.collect():
        a, b = sorted((root(r.a & (1 << 64) - 1), root(r.b & (1 << 64) - 1)))
        parent[b] = a
    assert [prints.index(root(p)) for p in prints] == components(prints)


def twins():
    """Two dense balls: only pairs that differ in three high bits and one of the next band link them."""
    base = random.Random(4).getrandbits(64)
    ball = [base ^ p << 47 for p in range(64) if p.bit_count() % 2 == 0]
    return sorted(ball + [x ^ 0b111 << 61 ^ 1 << 47 for x in ball])


def test_cross_units_pay_their_high_bits_once():
    fp = np.array(twins(), dtype=np.uint64)
    side = np.repeat([1, 2], len(fp) // 2)
    assert components([int(x) for x in fp]) == [0] * len(fp)
    unit, err, depth = (np.full(len(fp), k) for k in (0, 3, 61))
    a, b = S.join_tries(fp, unit, side, err, depth)
    pairs = {(int(x), int(y)) for x in fp[side == 1] for y in fp[side == 2] if int(x ^ y).bit_count() <= 4}
    parent = {int(p): int(p) for p in fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        parent[max(root(int(x)), root(int(y)))] = min(root(int(x)), root(int(y)))
    assert all(root(x) == root(y) for x, y in pairs)


def test_split_tries_link_over_their_high_bits(spark):
    prints = twins()
    links = S.near_links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long"), node_rows=12).collect()
    ones = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links]
    assert any((a ^ b) >> 61 for a, b in ones)


def test_join_of_one_dense_ball():
    rng = np.random.default_rng(1)
    fp = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 2)).astype(np.uint64), axis=1))
    n = len(fp)
    a, b = S.join_tries(fp, np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64))
    assert len(a) == n - 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(300, 200), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in linked_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {300: 200, 200: 200}


def test_empty(nothing):
    assert S.near_duplicates(nothing).count() == 0
