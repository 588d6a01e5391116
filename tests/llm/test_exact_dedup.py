import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.llm import exact_dedup as X


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            stays = i == keep and first
            first = first and not stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(text.encode()).digest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("historical", [None, "true", "false", "doc_id % 3 = 1"])
def test_groups(docs, rows, historical):
    found = X.kept_marks(X.exact_groups(docs, historical=historical and F.expr(historical)))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in found.collect()), key=repr)
    assert got == brute(rows)
    assert found.where("known").count() or historical is not None


def test_rows_that_stay(docs, rows):
    kept = X.drop_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted(
        -1 if i is None else i for i, _, _, stays, _ in brute(rows) if stays)


def test_index_is_minimal_and_perfect():
    rng = random.Random(3)
    digests = np.frombuffer(rng.randbytes(32 * 5000), dtype=np.uint8).reshape(-1, 32)
    levels, slots = X.build_levels(digests)
    assert sorted(slots) == list(range(5000))
    sizes, bits = [len(x) for x in levels], np.concatenate(levels)
    assert (X.find_slots(digests, sizes, bits) == slots).all()
    strange = np.frombuffer(rng.randbytes(32 * 1000), dtype=np.uint8).reshape(-1, 32)
    other = X.find_slots(strange, sizes, bits)
    assert other.min() >= -1 and other.max() < 5000


def test_same_place_on_a_level_is_told_apart_by_the_bytes(spark):
    base = bytes(range(32))
    twin = base[:8] + bytes(24)  # falls where the base falls on every level
    known = spark.createDataFrame([(bytearray(base), 4, 2)], "digest binary, winner long, copies long")
    new = spark.createDataFrame([(bytearray(twin), 9, 1), (bytearray(base), 2, 1)], "digest binary, winner long, copies long")
    got = {r.winner: (r.known, r.copies) for r in X.look_up(new, X.build_index(known, 1), 1).collect()}
    assert got == {9: (False, 1), 2: (True, 3)}


def test_slots_decide(docs, monkeypatch):
    """With other bytes in the slots nothing is a repeat, so the rows of the history no longer join theirs."""
    build = X.build_index

    def spoiled(groups, buckets):
        return build(groups, buckets).withColumn("digests", F.translate(F.hex("digests"), "0123456789ABCDEF", "123456789ABCDEF0"))\
            .withColumn("digests", F.unhex("digests"))

    right = X.exact_groups(docs, historical=F.expr("doc_id % 3 = 1"))
    old = right.where("known").count()
    assert old
    monkeypatch.setattr(X, "build_index", spoiled)
    wrong = X.exact_groups(docs, historical=F.expr("doc_id % 3 = 1"))
    assert wrong.where("known").count() == 0 and wrong.count() < right.count()


@pytest.mark.parametrize("many", [1, 3])
def test_hot_groups(docs, rows, many, monkeypatch):
    monkeypatch.setattr(X, "HOT_ROWS", many)
    monkeypatch.setattr(X, "HOT_GROUPS", 10 ** 9)
    found = X.kept_marks(X.exact_groups(docs))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in found.collect()), key=repr)
    assert got == brute(rows)


def test_columns_of_any_name(spark):
    names = ["doc_id", "text", "row", "own_id", "own_digest", "stay_id", "stay_digest", "copies", "known", "__own", "__text", "__id", "a.b"]
    table = spark.createDataFrame([(1, "x", *"abcdefghijk"), (2, "x", *"lmnopqrstuv"), (None, "y", *"abcdefghijk"),
                                   (3, "é " * 3_000_000, *"abcdefghijk"), (4, "é\n" * 3_000_000, *"abcdefghijk")], names)
    got = sorted((tuple(r)[:1] + tuple(r)[2:] for r in X.drop_repeats(table).collect()), key=repr)
    assert got == sorted([(1, *"abcdefghijk"), (None, *"abcdefghijk"), (3, *"abcdefghijk")], key=repr)


def test_empty(nothing):
    assert X.kept_marks(X.exact_groups(nothing)).count() == 0
    assert X.drop_repeats(nothing).count() == 0
