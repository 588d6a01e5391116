"""Registered queries of the corpus operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import (
    chat,
    exact_dedup,
    language_model,
    mixing,
    nearest,
    packing,
    prefix_trie,
    quality,
    reversed_search,
    simhash,
    substring_dedup,
    suffix_dedup,
    topk,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, folder, "documents"), byte_bpe())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "class")


def remainder(of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


@query
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.repeated_bytes(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), remainder(5) == 0)


@query
def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_dedup.kept_marks(exact_dedup.exact_groups(table(spark, folder, "documents")))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op9_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
"""


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.repeated_spans(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


@query
def op3_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_inner_products(table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


ORACLES["op3_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))],
                                  "conv_id long, turn int, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    formatted = chat.format_chats(chat.turn_events(turns))
    lengths = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = chat.read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"))
    return read.join(lengths, "conv_id")


ORACLES["op8_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, length(regexp_replace(role || text, '[^\\]', '', 'g'))
    + length(regexp_replace(role || text, '(<\||</?s>|<</?SYS>>|\[/?INST\])', '\1' || chr(1), 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + 24) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query
def op2_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.log_probabilities(table(spark, folder, "documents"), remainder(7) == 2)


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    own = prefix_trie.sequences(prefix_trie.turn_symbols(table(spark, folder, "conversations")))
    return prefix_trie.trie_nodes(prefix_trie.rebuilt(own))


ORACLES["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
           lambda a, x: list_reduce([xor(a, x)] || range(8), lambda b, i: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END))),
         4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
d AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d, md5(length(role) || ':' || role || text) AS symbol,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
p AS (
  SELECT conv_id, d, md5(string_agg(symbol, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key, words FROM d
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY d, key),
up AS (SELECT DISTINCT a.d, a.key, b.key AS parent FROM p AS a JOIN p AS b ON a.conv_id = b.conv_id AND a.d = b.d + 1),
kids AS (SELECT d - 1 AS d, parent AS key, count(*) AS n_children FROM up GROUP BY ALL),
s AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, key)),
below AS (
  SELECT a.d, a.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * s.words) AS saved
  FROM s JOIN p AS a ON a.conv_id = s.conv_id AND a.d <= s.d GROUP BY ALL),
ends AS (
  SELECT d, key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha
  FROM (SELECT conv_id, max(d) AS d, max_by(key, d) AS key FROM p GROUP BY conv_id) GROUP BY ALL)
SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, m.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM s JOIN below USING (d, key) LEFT JOIN up USING (d, key) LEFT JOIN n AS m ON m.d = s.d - 1 AND m.key = up.parent
     LEFT JOIN ends ON ends.d = s.d AND ends.key = s.key
"""


@query
def op12_reversed_search(spark: SparkSession, folder: str) -> DataFrame:
    return reversed_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op12_reversed_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
tf AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
c AS (SELECT row, doc_id, n, term, count(*) AS tf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, s),
g AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * c.n * s.n) // s.l))) AS gain
  FROM c JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM g JOIN q USING (term) GROUP BY item_id, row, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""


@query
def op11_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)
