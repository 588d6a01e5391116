"""Chat formatting from event logs.

Logs are partitioned by conversation and message and put in sequence; streamed deltas, edits, regenerations and deletions
are folded into the final message. The messages of a conversation are then rendered with a template that marks every
turn, and control strings inside texts are escaped so that the original can be read back from the output.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import col

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: control strings of this template, then those of other chat templates that are escaped as well
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = re.compile(r"<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)|\[(?=/?INST\])|\\")
LEARNED = ("assistant",)
FORMATTED = "conv_id long, formatted string, loss_spans array<struct<first:long,end:long>>"
READ = "conv_id long, turns array<struct<role:string,text:string>>, loss_text string"


def escape(text: str) -> str:
    """A backslash goes after the first character of every control string and is itself doubled."""
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    # the character before an inserted backslash is the control string's own, so the backslash alone goes
    return re.sub(r"(\\)\\|\\", r"\1", text)


def turn_events(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """An event log of finished turns: learned turns arrive as a start and streamed halves, all others whole.

    Rows stand in the order of ``turn`` (null first), ties by role and text; every row is a message of its own.
    """
    role, text = F.coalesce(col(role_col).cast("string"), F.lit("")), F.coalesce(col(text_col), F.lit(""))
    rows = turns.select(col(id_col).cast("long").alias("conv_id"), col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    half = (F.length("text") / 2).cast("int")
    event = lambda k, kind, part: F.struct((F.col("message") * 3 + k).alias("seq"), F.lit(kind).alias("kind"), part.alias("text"))
    streamed = F.array(event(0, "start", F.lit("")), event(1, "delta", F.substring("text", F.lit(1), half)),
                       event(2, "delta", F.substring("text", half + 1, F.length("text"))))
    log = F.explode(F.when(F.col("role").isin(*LEARNED), streamed).otherwise(F.array(event(0, "start", F.col("text")))))
    return rows.select("conv_id", "message", "role", log.alias("e")).select("conv_id", "e.seq", "message", "e.kind", "role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """``conv_id, message, seq, role, text``: each message as its events leave it.

    ``start``, ``edit`` and ``regenerate`` set the text anew, ``delta`` appends to it, and ``delete`` removes the message unless a later event
    sets it again. Events are applied by ``seq``, ties by kind and text; an event that was delivered twice is applied
    once; unknown kinds change nothing; deltas before any start append to an empty text. A message stands where its
    first event stands, with the first role that an event names (else an empty one); null texts count as empty.
    """
    log = F.array_sort(F.array_distinct(F.collect_list(F.struct("seq", "kind", "text", "role"))))
    sets = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin("start", "edit", "regenerate", "delete"), i).otherwise(-1)))
    held = F.filter("log", lambda e, i: (i == F.col("set")) | ((i > F.col("set")) & (e["kind"] == "delta")))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull() & (r != ""))
    known = events.select("conv_id", "message", "seq", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    folded = known.groupBy("conv_id", "message").agg(log.alias("log")).withColumn("set", sets)
    alive = folded.where((F.col("set") < 0) | (F.get("log", F.col("set"))["kind"] != "delete"))
    return alive.select("conv_id", "message", F.get("log", F.lit(0))["seq"].alias("seq"), F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
                        F.array_join(F.transform(held, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: one text per conversation, with the spans (in characters) that are learned."""
    turns = F.array_sort(F.collect_list(F.struct("seq", "message", "role", "text")))
    grouped = messages.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(stream):
        for batch in stream:
            out, marks = [], []
            for turns in batch.column("turns").to_pylist():
                parts, own, at = [], [], 0
                for t in turns:
                    head, text = TURN + escape(t["role"]) + TEXT, escape(t["text"])
                    if t["role"] in LEARNED:
                        own.append({"first": at + len(head), "end": at + len(head) + len(text)})
                    parts += [head, text, END, "\n"]
                    at += len(head) + len(text) + len(END) + 1
                out.append("".join(parts))
                marks.append(own)
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, type=pa.string()), pa.array(marks, type=span)],
                                             names=["conv_id", "formatted", "loss_spans"])

    return grouped.mapInArrow(run, FORMATTED)


def format_chats(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: event logs (``conv_id, seq, message, kind, role, text``) as formatted conversations.

    Conversations whose messages are all deleted have no row; a null ``conv_id`` is a conversation like any other; an empty
    log gives no rows; other columns are ignored.
    """
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text``: roles and texts, and the text under the loss mask, out of formatted conversations alone."""
    def run(stream):
        for batch in stream:
            turns, learned = [], []
            for text, own in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                found = [t.split(TEXT, 1) for t in text.split(TURN)[1:]]
                turns.append([{"role": unescape(r), "text": unescape(t[: -len(END) - 1])} for r, t in found])
                learned.append("".join(unescape(text[s["first"]: s["end"]]) for s in own))
            turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(turns, type=turn), pa.array(learned, type=pa.string())],
                                             names=["conv_id", "turns", "loss_text"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, READ)
