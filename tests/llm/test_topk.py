import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.llm import topk as K

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("class", T.StringType()), T.StructField("score", T.StringType())])


def brute(rows, k, every):
    own = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        own[i] = min(own.get(i, q), q)
    out = []
    for i, v in own.items():
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in own.items() if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def vectors(seed, n=150, width=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(width)]
        if i % 5 == 0 and rows:
            v = rng.choice(rows)[1]  # equal vectors
        if i % 17 == 3:
            v = rng.choice([None, [None] * width, [math.nan] + [1.0] * (width - 1), [math.inf] * width, [0.0] * width, [1.0]])
        rows.append((i, v, "c", "s"))
    return [*rows, *rows[:3], (None, [1.0] * width, "c", "s"), (4, [9.0] * width, "c", "s"), (10**6, [1e6] * width, None, None)]


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 20)])
@pytest.mark.parametrize("every", [10, 1])
def test_against_brute_force(spark, monkeypatch, blocks, every):
    monkeypatch.setattr(K, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(K, "VECTOR_BLOCK", blocks[1])
    rows = vectors(every)
    got = K.top_inner_products(spark.createDataFrame(rows, SCHEMA), F.pmod("vec_id", F.lit(every)) == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, every)


def test_one_very_common_vector(spark):
    rows = [(i, [1.0, -2.0, 0.5] if i % 3 else [float(i % 7), 1.0, 0.0], "c", "s") for i in range(300)]
    got = K.top_inner_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 2 == 0, k=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 2)


def test_few_rows_and_none(spark):
    rows = vectors(3)[:3]
    got = K.top_inner_products(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 1)
    assert K.top_inner_products(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert K.top_inner_products(spark.createDataFrame(rows, SCHEMA), F.lit(False)).count() == 0


def test_scores_beyond_double_precision(spark):
    rows = [(i, [float(4_000_000 + i), 3e6, -1e6], "c", "s") for i in range(8)]
    got = K.top_inner_products(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 1)
