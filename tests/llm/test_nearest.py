import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.llm import nearest as N

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))] + [
    T.StructField(n, T.StringType()) for n in ("class", "v", "p", "cell", "block", "score", "w", "q")])
EXTRA = ("x",) * 8


def usable(rows):
    own = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        own[i] = min(own.get(i, v), v)
    return own


def brute(rows, k, every):
    own = usable(rows)
    width = max(map(len, own.values()), default=0)
    out = {}
    scaled = {i: [x / max(map(abs, v)) for x in v] + [0.0] * (width - len(v)) for i, v in own.items()}
    for i, v in scaled.items():
        if i % every == 0:
            cos = lambda w, v=v: math.fsum(a * b for a, b in zip(v, w)) / math.sqrt(math.fsum(a * a for a in v) * math.fsum(b * b for b in w))
            out[i] = sorted((-cos(w), j) for j, w in scaled.items() if j != i)[:k]
    return out


def vectors(seed, n=400, width=24):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = [c + rng.gauss(0, 0.5) for c in rng.choice(centres)]
        if i % 9 == 0 and rows:
            v = rng.choice(rows)[1]  # equal vectors
        if i % 17 == 3:
            v = rng.choice([None, [None] * width, [math.nan] + [1.0] * (width - 1), [math.inf] * width, [0.0] * width, [1.0], [],
                            [1e-320] * width, [1e300, -1e300]])
        rows.append((i, v, *EXTRA))
    return [*rows, *rows[:3], (None, [1.0] * width, *EXTRA), (4, [9.0] * width, *EXTRA), (-100, [1.0] * width, *EXTRA)]


def recall(got, want):
    mine = {}
    for q, _, i, _ in got:
        mine.setdefault(q, set()).add(i)
    # a neighbour as near as the last one counts, whichever of them was taken
    return sum(len(mine.get(q, set()) & {i for _, i in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("bounds", [(16_384, 2_048, 128), (50, 9, 8)])
def test_recall_and_scores(spark, monkeypatch, bounds):
    for name, value in zip(("GROUP_ROWS", "GROUP_QUERIES", "LEAF_ROWS"), bounds, strict=True):
        monkeypatch.setattr(N, name, value)
    rows = vectors(1)
    got = [tuple(r) for r in N.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.pmod("vec_id", F.lit(10)) == 0).collect()]
    want, own = brute(rows, 5, 10), usable(rows)
    assert recall(got, want) >= 0.9
    for q, w in want.items():
        mine = sorted(r[1:] for r in got if r[0] == q)
        assert [r[0] for r in mine] == list(range(1, 1 + len(w)))
        assert [(-r[2], r[1]) for r in mine] == sorted((-r[2], r[1]) for r in mine)
        for _, i, score in mine:
            a, b = (np.array(own[x] + [0.0] * (24 - len(own[x]))) / max(map(abs, own[x])) for x in (q, i))
            assert i != q and score == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), rel=1e-12, abs=1e-12)


def test_a_sure_search_is_exact(spark):
    rows = vectors(2, 200)
    got = N.nearest(spark.createDataFrame(rows, SCHEMA), F.pmod("vec_id", F.lit(20)) == 0, sure=1 - 1e-12).collect()
    want = brute(rows, 5, 20)
    for q, w in want.items():
        assert [r["score"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == pytest.approx([-s for s, _ in w])


def test_one_very_common_vector(spark):
    rows = [(i, [1.0, -2.0, 0.5] if i % 3 else [float(i), 1.0, -float(i % 7)], *EXTRA) for i in range(300)]
    got = N.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 2 == 0, k=3).collect()
    assert len(got) == 150 * 3
    for r in got:
        if r["query_id"] % 3:
            common = [i for i in range(300) if i % 3 and i != r["query_id"]][:3]
            assert r["vec_id"] == common[r["rank"] - 1] and r["score"] == pytest.approx(1.0)


def test_few_rows_and_none(spark):
    rows = [(i, [float(i), 1.0], *EXTRA) for i in range(3)]
    got = N.nearest(spark.createDataFrame(rows, SCHEMA), F.lit(True)).collect()
    assert sorted((r[0], r[1]) for r in got) == [(q, k) for q in range(3) for k in (1, 2)]
    assert N.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert N.nearest(spark.createDataFrame(rows, SCHEMA), F.lit(False)).count() == 0


def test_chi_square_bound():
    draws = (np.random.default_rng(1).standard_normal((200_000, 12)) ** 2).sum(axis=1)
    for sure in (0.5, 0.9, 0.97):
        assert (draws <= N.chi_square_bound(sure, 12)).mean() == pytest.approx(sure, abs=0.005)


def test_cells_follow_the_splits():
    points = np.random.default_rng(3).standard_normal((1000, 4))
    splits = N.top_tree(points, 4)
    cell = N.cells_of(points, splits, 4)
    assert len(splits) == 15 and set(cell) == set(range(16)) and max(np.bincount(cell)) <= 64
    leaves = N.leaves_of(points, 30)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000)) and max(map(len, leaves)) <= 30


def test_real_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table.collect()]
    got = [tuple(r) for r in N.nearest(table, F.pmod("vec_id", F.lit(5)) == 0).collect()]
    assert recall(got, brute(rows, 5, 5)) >= 0.9
