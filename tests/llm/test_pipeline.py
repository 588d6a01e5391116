import math
from collections import Counter, defaultdict

import corpus_pipeline as P
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from trialframe.llm import quality
from trialframe.llm.queries import remainder

from tests.llm.test_exact_dedup import norm
from tests.llm.test_mixing import size, wanted
from tests.llm.test_simhash import components, print_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows_of(docs):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]


def test_stages_keep_the_columns(steps):
    assert all(x.schema == steps[0].schema for x in steps[1:-1])


def test_good_documents_stay(spark, steps):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    weights = quality.fit(steps[0], labels, held_out=F.coalesce(remainder(5) == 0, F.lit(False)))

    def score(text):
        place, value, _ = quality.features([(text or "").encode()], quality.FEATURE_BITS)
        return 1 / (1 + math.exp(-sum(float(weights[p]) * float(v) for p, v in zip(place, value, strict=True))))

    assert Counter(rows_of(steps[1])) == Counter(r for r in rows_of(steps[0]) if score(r[1]) >= P.LEAST_QUALITY)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    gone = Counter(rows_of(steps[0])) - Counter(rows_of(steps[1]))
    # so few labels teach a careful classifier, which loses no good document for the bad ones it finds
    assert sum(marks.get(r[0]) == 0 for r in gone) > 0 and sum(marks.get(r[0]) == 1 for r in gone) <= 1


def test_repeats_go(steps):
    best = {}
    for r in rows_of(steps[1]):
        best[norm(r[1])] = min(best.get(norm(r[1]), r), r)
    assert Counter(rows_of(steps[2])) == Counter(best.values())


def test_near_repeats_go(steps):
    rows = sorted(rows_of(steps[2]))
    roots = components([print_of(r[1]) for r in rows])
    assert sorted(rows_of(steps[3])) == [rows[k] for k in sorted(set(roots))]


def test_sources_meet_their_targets(steps):
    rows = rows_of(steps[3])
    _, goal = wanted(rows)
    words = defaultdict(int)
    for r in rows_of(steps[4]):
        words[r[3]] += size(r[1])
    assert all(abs(words[s] - t) <= 1 for s, t in goal.items())


def test_every_token_is_packed(steps):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    tokens = sum(len(e.ids) + 1 for e in t.encode_batch([r[1] or "" for r in rows_of(steps[4])], add_special_tokens=False))
    assert steps[5].agg(F.sum("length")).first()[0] == tokens
    assert steps[5].where("length * 4 <> octet_length(ids)").count() == 0


def test_run_gives_the_last_stage(spark, steps):
    got = P.run(spark, FOLDER)
    assert got.columns == steps[-1].columns
    assert got.agg(F.sum("length")).first()[0] == steps[-1].agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, docs, nothing, stage):
    assert P.STAGES[stage][1](spark, nothing, FOLDER).count() == 0
    assert P.STAGES[stage][1](spark, docs, FOLDER).count() > 0
