import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.llm import quality as Q


def held(column="doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_rows_are_told_apart(tables):
    docs, labels = tables
    got = Q.quality_scores(docs, labels, held()).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and set(got.quality) == {0, 1}
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert (got.predicted == (got.score >= 0.3)).all() and got[got.quality == 1].predicted.mean() > 0.97
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)


def test_labels_of_held_out_rows_change_nothing(tables):
    docs, labels = tables
    one = Q.fit(docs, labels, held_out=held())
    other = Q.fit(docs, labels.withColumn("quality", F.when(held(), 1 - F.col("quality")).otherwise(F.col("quality"))), held_out=held())
    assert one.any() and (one == other).all()


def test_scores_are_sparse_dot_products():
    texts = [b"", b"a", b"a b a b a", b"x | y | z " * 50]
    place, value, begin = Q.features(texts, 10)
    weights = np.linspace(-1, 1, 1 << 10)
    for i, text in enumerate(texts):
        p, v, b = Q.features([text], 10)
        assert (p == place[begin[i]: begin[i + 1]]).all() and np.allclose(v, value[begin[i]: begin[i + 1]])
    assert np.isfinite([weights[place] @ value]).all()


def test_every_row_is_scored(docs, rows, nothing, tables):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit("x").alias("score"))
    got = Q.quality_scores(docs, labels, held()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert Q.quality_scores(nothing, labels, held()).count() == 0
    none = Q.quality_scores(docs, tables[1].limit(0), held()).collect()
    assert {r.score for r in none} == {0.5}


def test_rows_that_are_kept(docs, rows):
    weights = Q.fit(docs, docs.select("doc_id", F.when(F.length("text") > 50, 1).otherwise(0).alias("quality")))
    scores = Q.score(docs, weights)
    kept = Q.keep_good(docs, weights, 0.5)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scores.where("score >= 0.5").collect())
