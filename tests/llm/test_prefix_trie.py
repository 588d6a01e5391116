import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.llm import prefix_trie as P

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType())] + [
    T.StructField(n, T.StringType()) for n in ("place", "symbol", "words", "turns", "at", "length", "has", "node", "__base", "__h")])
EXTRA = ("x",) * 10


def log(seed=1, n=90):
    """Conversations over few texts, so that openings are shared; nulls, ties, repeated rows, equal and very long ones."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c % 11 == 7:
            continue
        length = rng.choice([0, 1, 2, 3, 4, 6, 9])
        for k in range(length):
            text = rng.choice(["a b", "a  b", "", None, "é日 x"]) if k else rng.choice(["hi", "hi", "hi there"])
            rows.append((c, rng.choice([None, 3]) if rng.random() < 0.05 else 10 + k, rng.choice(["user", "user", None]), text, *EXTRA))
    for c, extra in ((100, 0), (121, 0), (142, 3)):
        rows += [(c, k, "user", f"w{k % 3} " * (k % 4), *EXTRA) for k in range(400 + extra)]
    rows += rows[:3] + [(None, 1, "user", "lost", *EXTRA), (-7, 1, "user", "hi", *EXTRA), (2**62, 0, "user", "hi", *EXTRA)]
    rows.append((200, 0, "user", "long word " * 300_000, *EXTRA))
    return rows


def chats_of(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in own.items()}


def rebuilt(chats):
    out = {}
    for c, turns in chats.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = chats.get(base, [])[:h] + turns[h:]
    return out


def brute(chats):
    nodes = defaultdict(list)
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        gain = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += gain
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(chats[c]) == len(p)).encode()).hexdigest())
                  for p, m in nodes.items())


def found(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                              "ends_sha256").collect())


@pytest.mark.parametrize("batches", [(10_000, 16), (16, 2)])
def test_against_brute_force(spark, batches):
    rows = log()
    own = P.sequences(P.turn_symbols(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    chats = chats_of(rows)
    key = lambda r: (r[0], r[1], r[3:])
    assert sorted(found(P.trie_nodes(P.rebuilt(own), *batches)), key=key) == sorted(brute(rebuilt(chats)), key=key)


def test_plain_conversations_in_small_batches(spark):
    rows = log(5, 60)
    own = P.sequences(P.turn_symbols(spark.createDataFrame(rows, SCHEMA)))
    key = lambda r: (r[0], r[1], r[3:])
    assert sorted(found(P.trie_nodes(own, 7, 3)), key=key) == sorted(brute(chats_of(rows)), key=key)


def test_no_rows(spark):
    own = P.sequences(P.turn_symbols(spark.createDataFrame([], SCHEMA)))
    assert P.trie_nodes(P.rebuilt(own)).count() == 0


def test_one_opening_and_one_conversation_for_all(spark):
    rows = [(c, k, "user", f"t{k}" if k < 2 or c % 3 else f"own {c}", *EXTRA) for c in range(120) for k in range(3)]
    own = P.sequences(P.turn_symbols(spark.createDataFrame(rows, SCHEMA)))
    assert found(P.trie_nodes(own, 16, 2)) == brute(chats_of(rows))


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(-1, 40) for b in range(max(a + 1, 1), 70) if a >= 0]
    df = spark.createDataFrame(pairs, "a int, b int").select("a", "b", P.two_fattest(F.col("a"), F.col("b")).alias("f"))
    for a, b, f in df.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_search_finds_the_deepest_node(spark):
    """The fat binary search against walking down from the root."""
    rows = log(9, 80)
    members = P.paths(P.sequences(P.turn_symbols(spark.createDataFrame(rows, SCHEMA)))).cache()
    classes = members.dropDuplicates(["length", "at"])
    even = classes.where("conv_id % 2 = 0")
    trie = P.build(even, 8, 2)
    ends = {(r["depth"], bytes(r["edge"][-1])) for r in trie.collect()}
    longest = classes.agg(F.max("length")).first()[0]
    for r in P.locate(classes.where("conv_id % 2 = 1"), trie, longest).collect():
        assert r["a"] == max(d for d in range(r["length"] + 1) if (d, bytes(r["at"][d])) in ends)
