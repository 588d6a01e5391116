"""Prefix trie of conversations, built as a z-fast trie in tables.

A node of the compacted trie spans the depths between its parent's extent and its own. It is stored under two keys: the first
position of its edge (which leads down from the parent) and its handle, the position at the two-fattest depth of the
edge. A conversation finds its exit node by fat binary search over the handles, about log2(length) joins, instead of walking turn by
turn. Conversations are inserted in batches: a batch is located in the trie as it is, edges are split where conversations
leave them, and what is new below is compacted and added. In the end edges are expanded to one row per depth.

A position (the first d turns of a conversation) is known by its depth and by 128 bits mixed from the turns and their places.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import broadcast_if_small, col
from trialframe.llm.common import mixed
from trialframe.operators.ordered import positions
from trialframe.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: distinct conversations of the first batch, and how many times larger each further batch is
FIRST_BATCH, GROWTH = 20_000, 16
#: search steps between two written tables
STEPS = 4
WORDS = r"[^\x20\x09-\x0D]+"
ROOT = b"\0" * 16
PATHS = "conv_id long, length int, at array<binary>, words array<long>"


# ---------------------------------------------------------------- sequences

def turn_symbols(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv_id, place, symbol, words``: turns in order (null turns first, ties by role and text) as digests of role and text.

    Null roles and texts count as empty; rows without an id are left out; repeated rows are turns of their own.
    """
    role, text = F.coalesce(col(role_col).cast("string"), F.lit("")), F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = turns.select(col(id_col).cast("long").alias("conv_id"), col(turn_col).isNotNull().alias("has"), col(turn_col).alias("turn"),
                        role.alias("role"), text.alias("text")).where("conv_id is not null")
    placed = positions(rows, ["conv_id"], ["has", "turn", "role", "text"], "place")
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    return placed.select("conv_id", "place", F.unhex(F.sha2(whole, 256)).alias("symbol"),
                         F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))


def sequences(symbols: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as digests and numbers of words (no texts)."""
    return symbols.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "symbol", "words"))).alias("turns"))


def rebuilt(convs: DataFrame, share: int = 20, most: int = 4) -> DataFrame:
    """Conversations that open with the first h turns of conversation ``c - c % share``, then go on with their own after their first h.

    h is the crc32 of the decimal id, modulo ``most``; all turns are taken if there are fewer, and none of a conversation that is absent.
    """
    own = convs.withColumns({"__base": F.col("conv_id") - F.col("conv_id") % share,
                             "__h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})
    bases = convs.where(F.col("conv_id") % share == 0).select(
        F.col("conv_id").alias("__base"), F.slice("turns", 1, most - 1).alias("__opening"))
    rest = F.slice("turns", F.col("__h") + 1, F.size("turns"))
    opening = F.slice(F.coalesce("__opening", F.slice("turns", 1, 0)), 1, F.col("__h"))
    return own.join(bases, "__base", "left").select("conv_id", F.concat(opening, rest).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """``conv_id, length, at, words``: the position after each number of turns (from 0) and the words up to there."""
    def run(stream):
        for batch in stream:
            ids, lengths, at, words = [], [], [], []
            for i, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                n = len(turns)
                digests = np.frombuffer(b"".join(t["symbol"] for t in turns), dtype="<u8").reshape(n, 4)
                place = np.arange(1, n + 1, dtype="<u8")
                halves = np.zeros((n + 1, 2), dtype="<u8")
                for half in (0, 1):
                    step = mixed(digests[:, half] + place * np.uint64(0x9E3779B97F4A7C15)) ^ mixed(digests[:, half + 2] ^ (place + np.uint64(half)))
                    halves[1:, half] = np.bitwise_xor.accumulate(step)
                raw = halves.tobytes()
                ids.append(i)
                lengths.append(n)
                at.append([raw[16 * d:16 * d + 16] for d in range(n + 1)])
                words.append(np.concatenate([[0], np.cumsum([t["words"] for t in turns], dtype=np.int64)]).tolist() if n else [0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.int64()), pa.array(lengths, type=pa.int32()), pa.array(at, type=pa.list_(pa.binary())),
                 pa.array(words, type=pa.list_(pa.int64()))], names=["conv_id", "length", "at", "words"])

    return convs.select("conv_id", "turns").mapInArrow(run, PATHS)


# ---------------------------------------------------------------- the z-fast trie

def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the largest power of two."""
    top = F.length(F.bin(low.cast("long").bitwiseXOR(high.cast("long")))) - 1
    return F.call_function("shiftleft", F.lit(-1).cast("long"), top).bitwiseAND(high.cast("long")).cast("int")


def position(path: Column, depth: Column) -> Column:
    return F.get(path, depth.cast("int"))


def empty_trie(spark) -> DataFrame:
    """The root alone. A node spans the depths ``above`` (its parent's) to ``depth``; ``edge`` holds its positions, ``words`` the
    words up to each of them, ``up`` and ``up_words`` those of the parent."""
    return spark.createDataFrame(
        [(-1, None, 0, 0, [bytearray(ROOT)], [0])],
        "above int, up binary, up_words long, depth int, edge array<binary>, words array<long>")


def last(c: str) -> Column:
    return F.element_at(c, -1)


def handles(trie: DataFrame) -> DataFrame:
    """``f, handle, above, depth, extent``: every node below the root under its two-fattest position."""
    f = two_fattest(F.col("above"), F.col("depth"))
    nodes = trie.where("depth > 0").withColumn("f", f)
    return nodes.select("f", position(F.col("edge"), F.col("f") - F.col("above") - 1).alias("handle"),
                        F.col("above").alias("h_above"), F.col("depth").alias("h_depth"), last("edge").alias("extent"))


def locate(batch: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """Add ``a``, the depth of the deepest node whose extent the conversation begins with, by fat binary search.

    ``(a, b]`` holds the depths still open. A handle that is missing closes all depths from it on; one that is found moves ``a`` to the
    extent of its node, or ends the search at the node's parent if the conversation leaves the edge.
    """
    index = broadcast_if_small(cut(handles(trie)))
    state = batch.withColumns({"a": F.lit(0), "b": F.col("length")})
    for step in range(max(longest, 1).bit_length()):
        f = F.when(F.col("a") < F.col("b"), two_fattest(F.col("a"), F.col("b")))
        asked = state.withColumn("probe", f)
        # finished searches ask for depths that no node has, spread so that they do not meet in one task
        asked = asked.withColumns({
            "probe": F.coalesce("probe", (-1 - F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20))).cast("int")),
            "probed": F.when(F.col("probe").isNotNull(), position(F.col("at"), F.col("probe")))})
        found = asked.join(index, (F.col("probe") == F.col("f")) & (F.col("probed") == F.col("handle")), "left")
        hit = F.col("h_depth").isNotNull()
        whole = hit & (F.col("h_depth") <= F.col("length")) & (position(F.col("at"), F.col("h_depth")) == F.col("extent"))
        active = F.col("a") < F.col("b")
        new_a = F.when(active & whole, F.col("h_depth")).when(active & hit, F.col("h_above")).otherwise(F.col("a"))
        new_b = F.when(active & ~hit, F.col("probe") - 1).when(active & hit & ~F.coalesce(whole, F.lit(False)), F.col("h_above")).otherwise(F.col("b"))
        state = found.select(*batch.columns, new_a.alias("a"), new_b.alias("b"))
        if step % STEPS == STEPS - 1:
            state = cut(state)
    return state.drop("b")


def inserted(trie: DataFrame, batch: DataFrame, longest: int) -> DataFrame:
    """The trie with the conversations of a batch (distinct sequences that it does not end with yet) added."""
    located = locate(batch, trie, longest)
    down = trie.where("depth > 0").select((F.col("above") + 1).alias("first_depth"), F.get("edge", F.lit(0)).alias("first"),
                                          F.col("edge").alias("old_edge"))
    nxt = F.when(F.col("a") < F.col("length"), position(F.col("at"), F.col("a") + 1))
    # conversations that end at their deepest node look for nothing, under keys spread like those above
    entry = located.withColumns({"next_depth": F.col("a") + 1, "next": F.coalesce(nxt, F.encode(F.col("conv_id").cast("string"), "utf-8"))})
    exits = entry.join(down, (F.col("next_depth") == F.col("first_depth")) & (F.col("next") == F.col("first")), "left")
    mine = F.slice("at", F.col("a") + 2, F.size("old_edge"))
    same = F.zip_with(mine, "old_edge", lambda x, y: F.coalesce(x == y, F.lit(False)))
    wrong = F.array_position(same, F.lit(False))
    shared = F.when(F.col("old_edge").isNull(), 0).when(wrong == 0, F.size("old_edge")).otherwise(wrong - 1)
    left = cut(exits.select("conv_id", "length", "at", "words", "first_depth", "first", (F.col("a") + shared).cast("int").alias("leave")))

    # edges are split where conversations leave or end
    splits = left.where("first is not null").groupBy("first_depth", "first").agg(F.sort_array(F.collect_set("leave")).alias("cuts"))
    keyed = trie.withColumns({"k_depth": F.col("above") + 1, "k": F.get("edge", F.lit(0))})
    marked = keyed.join(splits, (F.col("k_depth") == F.col("first_depth")) & (F.col("k") == F.col("first")), "left")
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: (c > F.col("above")) & (c < F.col("depth")))
    ends = F.concat(inner, F.array("depth"))
    begins = F.concat(F.array("above"), inner)
    pieces = marked.select("above", "up", "up_words", "edge", "words", F.inline(F.arrays_zip(begins.alias("lo"), ends.alias("hi"))).alias("lo", "hi"))
    offset = F.col("lo") - F.col("above")
    old = pieces.select(
        F.col("lo").alias("above"),
        F.when(offset == 0, F.col("up")).otherwise(F.get("edge", offset - 1)).alias("up"),
        F.when(offset == 0, F.col("up_words")).otherwise(F.get("words", offset - 1)).alias("up_words"),
        F.col("hi").alias("depth"),
        F.slice("edge", offset + 1, F.col("hi") - F.col("lo")).alias("edge"),
        F.slice("words", offset + 1, F.col("hi") - F.col("lo")).alias("words"))

    # below, positions where conversations end or part become nodes, each added by one of the conversations through it
    depths = F.explode(F.sequence(F.col("leave") + 1, F.col("length")))
    tails = left.where("length > leave").select("conv_id", "length", "leave", "at", depths.alias("d"))
    tails = tails.select("conv_id", "leave", "d", position(F.col("at"), F.col("d")).alias("p"),
                         F.when(F.col("d") < F.col("length"), position(F.col("at"), F.col("d") + 1)).alias("then"))
    ended = F.max(F.when(F.col("then").isNull(), 1).otherwise(0))
    forks = tails.groupBy("d", "p").agg(ended.alias("ended"), F.min("then").alias("one"), F.max("then").alias("other"),
                                        F.min("conv_id").alias("owner"))
    explicit = forks.where((F.col("ended") == 1) | (F.col("one") != F.col("other"))).select("d", "p", "owner")
    own = tails.join(explicit, ["d", "p"])
    before = F.lag("d").over(Window.partitionBy("conv_id").orderBy("d"))
    steps = own.withColumn("lo", F.coalesce(before, F.col("leave"))).where("conv_id = owner").select("conv_id", "lo", F.col("d").alias("hi"))
    new = steps.join(left.select("conv_id", "at", "words"), "conv_id").select(
        F.col("lo").alias("above"), position(F.col("at"), F.col("lo")).alias("up"), position(F.col("words"), F.col("lo")).alias("up_words"),
        F.col("hi").alias("depth"), F.slice("at", F.col("lo") + 2, F.col("hi") - F.col("lo")).alias("edge"),
        F.slice("words", F.col("lo") + 2, F.col("hi") - F.col("lo")).alias("words"))
    return cut(old.unionByName(new))


def build(classes: DataFrame, first_batch: int = FIRST_BATCH, growth: int = GROWTH) -> DataFrame:
    """The compacted trie of distinct sequences (``conv_id, length, at, words``), inserted batch by batch."""
    count, longest = classes.agg(F.count(F.lit(1)), F.max("length")).first()
    trie, begin, size = empty_trie(classes.sparkSession), 0, first_batch
    parts = max(1, -(-count // first_batch))
    slot = F.pmod(F.xxhash64("conv_id"), F.lit(parts))
    step = 1
    while begin < parts:
        trie = inserted(trie, classes.where((slot >= begin) & (slot < begin + step)), longest or 0)
        begin, step = begin + step, step * growth
    return trie


# ---------------------------------------------------------------- what nodes hold

def over_subtrees(nodes: DataFrame, sums: list[str], smallest: list[str] = ()) -> DataFrame:
    """``node`` and its columns summed (or their smallest) over the node and all below it, in steps that double the reach."""
    state = nodes.select("node", "up", *sums, *smallest)
    while True:
        state = cut(state)
        open_ = state.where("up is not null")
        if not open_.limit(1).count():
            return state.drop("up")
        handed = open_.groupBy(F.col("up").alias("to")).agg(
            *[F.sum(c).alias(f"in_{c}") for c in sums], *[F.min(c).alias(f"in_{c}") for c in smallest])
        jump = state.select(F.col("node").alias("at"), F.col("up").alias("further"))
        # nodes that have reached the root ask under keys of their own, which no node has
        far = state.withColumn("via", F.coalesce("up", F.concat("node", F.lit(b"-"))))
        state = (far.join(jump, F.col("via") == F.col("at"), "left").join(handed, F.col("node") == F.col("to"), "left")
                 .select("node", F.col("further").alias("up"),
                         *[(F.col(c) + F.coalesce(F.col(f"in_{c}"), F.lit(0))).alias(c) for c in sums],
                         *[F.least(c, f"in_{c}").alias(c) for c in smallest]))


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: SHA-256 of the comma-joined decimal ids in ascending order, streamed row by row."""
    def run(stream):
        node, state = None, None
        for batch in stream:
            out = []
            for n, i in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if n != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(str(i).encode())
                else:
                    state.update(b",%d" % i)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], type=pa.binary()), pa.array([o[1] for o in out], type=pa.string())],
                                             names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], type=pa.binary()), pa.array([state.hexdigest()], type=pa.string())],
                                             names=["node", "ends_sha256"])

    return ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def trie_nodes(convs: DataFrame, first_batch: int = FIRST_BATCH, growth: int = GROWTH) -> DataFrame:
    """One row per distinct opening of conversations (``conv_id, turns`` as of :func:`sequences`), from the empty one on.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in
    the subtree), ``saved_tokens`` (words that members need not repeat, over the subtree), ``ends_sha256`` (ids of the members that
    end here). An empty table gives no rows; conversations without turns belong to the root alone; equal conversations
    share all nodes; other columns are ignored. An id must stand on one row. A conversation is one row of 24 bytes a turn; its
    texts are never gathered. The ids of equal conversations are hashed in one stream each, as SHA-256 asks for.
    """
    members = cut(paths(convs))
    end = F.element_at("at", -1)
    classes = cut(members.groupBy("length", end.alias("end")).agg(
        F.count(F.lit(1)).alias("ending"), F.min("conv_id").alias("conv_id"),
        F.min_by("at", "conv_id").alias("at"), F.min_by("words", "conv_id").alias("words")))
    trie = build(classes.select("conv_id", "length", "at", "words"), first_batch, growth)
    nodes = trie.withColumn("node", last("edge"))
    kids = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    facts = (nodes.select("node", "up", "depth", (last("words") - F.col("up_words")).alias("edge_words"))
             .join(classes.select(F.col("end").alias("node"), "ending", F.col("conv_id").alias("conv")), "node", "left").join(kids, "node", "left"))
    facts = cut(facts.select("node", "up", "edge_words", F.coalesce("ending", F.lit(0)).alias("n_convs"), "conv",
                             F.coalesce("n_children", F.lit(0)).alias("n_children"),
                             F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves")))
    counts = over_subtrees(facts, ["n_convs", "n_leaves"], ["conv"])
    saved = facts.select("node", "up", "edge_words", "n_children").join(counts, "node").withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("edge_words"))
    saved = cut(saved)
    below = over_subtrees(saved, ["saved"]).withColumnRenamed("saved", "whole")
    parents = saved.select(F.col("node").alias("up"), F.col("conv").alias("up_conv"))
    stats = (saved.join(below, "node").join(parents, "up", "left")
             .join(digests_of_ends(members.select(end.alias("node"), "conv_id")), "node", "left")
             .select("node", "conv", "up_conv", "n_convs", "n_leaves", "n_children", (F.col("whole") - F.col("saved")).alias("below"), "ends_sha256"))
    spread = (nodes.join(stats, "node").where("n_convs > 0")
              .select("*", F.posexplode("edge").alias("i", "here")))
    tip = F.col("i") == F.size("edge") - 1
    words = last("words") - F.when(F.col("i") == 0, F.col("up_words")).otherwise(F.get("words", F.col("i") - 1))
    return spread.select(
        F.col("conv").alias("conv_id"), (F.col("above") + 1 + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n_convs").cast("long").alias("n_convs"),
        F.when(tip, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        (F.col("below") + (F.col("n_convs") - 1) * words).alias("saved_tokens"),
        F.when(tip & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
