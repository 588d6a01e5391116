import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trialframe.llm import chat as C

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>", "<|", "\\", "<", "[", "\n", "é日", "ok ", "<<"]
EVENTS = "conv_id long, seq long, message long, kind string, role string, text string, turns string"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES)).map("".join))
def test_escapes_are_reversible(text):
    out = C.escape(text)
    assert C.unescape(out) == text
    for mark in (C.TURN, C.TEXT, C.END, "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|"):
        assert mark not in out


def fold(log):
    """Messages of one conversation, by hand."""
    out, where, roles, gone = {}, {}, {}, set()
    for seq, kind, text, role, message in sorted(set((e[1], e[3] or "", e[5] or "", e[4] or "", e[2]) for e in log)):
        where.setdefault(message, seq)
        if role and not roles.get(message):
            roles[message] = role
        out.setdefault(message, "")
        if kind in ("start", "edit", "regenerate"):
            out[message] = text
            gone.discard(message)
        elif kind == "delete":
            gone.add(message)
            out[message] = ""
        elif kind == "delta" and message not in gone:
            out[message] += text
    return [(roles.get(m, ""), out[m]) for m in sorted(out, key=lambda m: (where[m], m)) if m not in gone]


def logs(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(12), None]:
        seq = 0
        for _ in range(rng.randint(1, 30)):
            seq += rng.randint(0, 2)
            text = rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 6)))])
            rows.append((conv, seq, rng.randint(0, 4), rng.choice(["start", "delta", "delta", "edit", "regenerate", "delete", "seen", None]),
                         rng.choice(["user", "assistant", None, "<|end|>\n"]), text, "x"))
    return rows + rng.sample(rows, 20)


@pytest.mark.parametrize("seed", [1, 2])
def test_logs_fold_render_and_read_back(spark, seed):
    rows = logs(seed)
    formatted = C.format_chats(spark.createDataFrame(rows, EVENTS).repartition(5))
    got = {r.conv_id: r for r in C.read_back(formatted).collect()}
    wanted = {c: fold([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert set(got) == {c for c, turns in wanted.items() if turns}
    for c, r in got.items():
        assert [(t.role, t.text) for t in r.turns] == wanted[c]
        assert r.loss_text == "".join(t for role, t in wanted[c] if role == "assistant")


def test_turns_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b" * 501), (1, 1, "assistant", "b" * 501), (1, 1, "assistant", None), (2, None, None, "x"),
            (2, 0, "system", ""), (None, 0, "assistant", "</s>[INST] ok [/INST]"), (3, 5, "assistant", string.printable)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in C.read_back(C.format_chats(C.turn_events(turns))).collect()}
    assert got == {1: [("user", "a"), ("assistant", ""), ("assistant", "b" * 501), ("assistant", "b" * 501)], 2: [("", "x"), ("system", "")],
                   None: [("assistant", "</s>[INST] ok [/INST]")], 3: [("assistant", string.printable)]}


def test_empty(spark):
    assert C.format_chats(spark.createDataFrame([], EVENTS)).count() == 0
    assert C.turn_events(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
