"""Row-level steps, filters, sorts, limits and set operations."""

from pyspark.sql import functions as F

from queries import query, table
from trialframe.functions.flatten import flatten_variant, path_values
from trialframe.functions.text import masked
from trialframe.operators import compare, jobs, verbs
from trialframe.operators import transforms as tf
from trialframe.operators.ordered import positions
from trialframe.plans import flow


@query("""
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'HOT' WHEN '2-HIGH' THEN 'HOT' ELSE o_orderpriority END
             AS o_orderpriority,
           CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS code
    FROM orders""")
def conditional_map(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    steps = [
        {"name": "ConditionalTransformer", "col": "o_orderpriority", "dest": "o_orderpriority",
         "value": {"1-URGENT": "2-HIGH", "2-HIGH": "HOT"}},
        {"name": "ConditionalTransformer", "col": "o_orderstatus", "dest": "code", "value": {"F": "done", "O": "open"}},
    ]
    return flow.transform(df, steps).drop("o_orderstatus")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50")
def filter_columns(spark, folder):
    df = table(spark, folder, "events").select("event_id", "user_id", "value", "event_type")
    steps = [{"name": "FilterColumnTransformer", "filters": {"event_type": "purchase"}},
             {"df.query": {"expr": "event_type == 'purchase' and value > 50"}}]
    return flow.transform(df, steps).drop("event_type")


@query("SELECT l_extendedprice, l_discount FROM lineitem")
def select_regex(spark, folder):
    return flow.transform(table(spark, folder, "lineitem"), [{"df.filter": {"regex": "^l_(ext|disc).*"}}])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def eval_expr(spark, folder):
    steps = [{"df.eval": {"expr": "net = l_extendedprice * (1 - l_discount)"}},
             {"df.filter": {"items": ["l_orderkey", "l_linenumber", "net", "absent"]}}]
    return flow.transform(table(spark, folder, "lineitem"), steps)


@query("""
    SELECT 'orders' AS source, o_orderkey AS id, o_totalprice AS price, NULL AS event_type, NULL AS value FROM orders
    UNION ALL SELECT 'events', event_id, NULL, event_type, value FROM events""")
def union_sparse(spark, folder):
    orders = table(spark, folder, "orders").selectExpr("'orders' as source", "o_orderkey as id", "o_totalprice as price")
    events = table(spark, folder, "events").selectExpr("'events' as source", "event_id as id", "event_type", "value")
    return tf.union_by_name([orders, events])


@query("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id AS "who.user", event_type AS "who.what.type"
    FROM events""")
def flatten_json(spark, folder):
    df = table(spark, folder, "events").selectExpr(
        "event_id", """parse_json(concat(left(props, length(props) - 1), ', "who": {"user": ', user_id,
                       ', "what": {"type": "', event_type, '"}, "none": {}}}')) as record""")
    return flatten_variant(df, "record")


@query("""
    SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events
    UNION ALL SELECT event_id, 'who.type', event_type FROM events""")
def path_value_rows(spark, folder):
    df = table(spark, folder, "events").selectExpr(
        "event_id", """parse_json(concat(left(props, length(props) - 1), ', "who": {"type": "', event_type, '"}}'))
                       as record""")
    return path_values(df, "record", ["event_id"])


@query("""
    SELECT c.c_custkey, coalesce(sum(o_totalprice_c), NULL) AS total, row_number() OVER (
             ORDER BY sum(o_totalprice_c) DESC NULLS LAST, c.c_custkey) - 1 AS place
    FROM customer c LEFT JOIN (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(round(o_totalprice * 100) AS BIGINT)
                                      END AS o_totalprice_c FROM orders) o ON o_custkey = c_custkey
    GROUP BY c.c_custkey""".replace("coalesce(sum(o_totalprice_c), NULL)", "CAST(sum(o_totalprice_c) AS BIGINT)"))
def sorted_report(spark, folder):
    orders = table(spark, folder, "orders").selectExpr(
        "o_custkey as c_custkey", "case when o_orderpriority = '1-URGENT' then cast(round(o_totalprice * 100) as bigint) end as price")
    totals = table(spark, folder, "customer").select("c_custkey").join(
        orders.groupBy("c_custkey").agg(F.sum("price").alias("total")), "c_custkey", "left")
    numbered = verbs.call(totals, "reset_index", {"order_by": ["-total", "c_custkey"], "name": "place"})
    return verbs.call(numbered, "sort_values", {"by": ["total", "c_custkey"], "ascending": [False, True]})


@query("""
    SELECT 'head' AS part, event_id FROM (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 7)
    UNION ALL SELECT 'tail', event_id FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 7)
    UNION ALL SELECT 'pairs', n FROM (SELECT count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events))""")
def limit_distinct(spark, folder):
    df = table(spark, folder, "events").select("event_id", "ts", "event_type", "user_id")
    order = ["ts", "event_id"]
    head = verbs.call(df, "head", {"n": 7, "order_by": order}).selectExpr("'head' as part", "event_id")
    tail = verbs.call(df, "tail", {"n": 7, "order_by": order}).selectExpr("'tail' as part", "event_id")
    pairs = verbs.call(df.select("event_type", "user_id"), "drop_duplicates").agg(
        F.count(F.lit(1)).alias("event_id")).select(F.lit("pairs").alias("part"), "event_id")
    return head.unionByName(tail).unionByName(pairs)


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def top_k(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return verbs.call(df, "nlargest", {"n": 100, "columns": "o_totalprice", "order_by": "o_orderkey"})


@query("""
    SELECT o_custkey, o_orderpriority, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1""")
def dedup(spark, folder):
    df = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    kept = verbs.call(df, "drop_duplicates", {"subset": ["o_custkey", "o_orderpriority"],
                                              "order_by": ["o_orderdate", "o_orderkey"]})
    return kept.drop("o_orderdate")


@query("""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1 AS again,
           count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1 AS repeated
    FROM orders""")
def duplicate_marks(spark, folder):
    df = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    subset = ["o_custkey", "o_orderpriority"]
    marked = verbs.call(df, "duplicated", {"subset": subset, "order_by": "o_orderkey", "name": "again"})
    return verbs.call(marked, "duplicated", {"subset": subset, "keep": False, "name": "repeated"}).drop(*subset)


@query("""
    SELECT p_partkey AS key, upper_size, price, capped, size_mod, size_pow, is_big FROM (
      SELECT p_partkey, CAST(p_size AS DOUBLE) AS upper_size, round_even(p_retailprice, 0) AS price,
             least(greatest(p_size, 10), 40) AS capped, p_size - 7 * floor(p_size / 7.0) AS size_mod,
             CAST(p_size AS DOUBLE) ** 2 AS size_pow, p_size >= 25 AS is_big FROM part)""")
def column_verbs(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    df = df.selectExpr("*", "p_size as capped", "p_size as size_mod", "p_size as size_pow", "p_size as is_big")
    return verbs.chain(df, [
        {"df.rename": {"columns": {"p_partkey": "key", "p_size": "upper_size", "p_retailprice": "price"}}},
        {"df.drop": {"columns": ["p_brand"]}},
        {"df.astype": {"dtype": {"upper_size": "float"}}},
        {"df.round": {"decimals": {"price": 0}}},
        {"df.clip": {"lower": 10, "upper": 40, "columns": ["capped"]}},
        {"df.mod": {"other": 7, "columns": ["size_mod"]}},
        {"df.pow": {"other": 2, "columns": ["size_pow"]}},
        {"df.ge": {"other": 25, "columns": ["is_big"]}},
    ])


@query("""
    SELECT p_brand IN ('Brand#1', 'Brand#2') AS p_brand, p_size IN (1, 2, 3) AS p_size, count(*) AS count
    FROM part GROUP BY ALL""")
def isin_flags(spark, folder):
    df = table(spark, folder, "part").select("p_brand", "p_size")
    flags = verbs.call(df, "isin", {"values": {"p_brand": ["Brand#1", "Brand#2"], "p_size": [1, 2, 3]}})
    return verbs.call(flags, "value_counts")


@query("""
    SELECT c_custkey, coalesce(nullif(c_nationkey, 7), -1) AS nation, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')
             AS segment
    FROM customer
    WHERE (CASE WHEN c_nationkey = 7 THEN 0 ELSE 1 END) + (CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END)
          + (CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END) >= 2""")
def null_verbs(spark, folder):
    df = table(spark, folder, "customer").selectExpr(
        "c_custkey", "nullif(c_nationkey, 7) as nation", "nullif(c_mktsegment, 'BUILDING') as segment",
        "case when c_acctbal < 0 then null else c_acctbal end as balance")
    return verbs.chain(df, [
        {"df.dropna": {"thresh": 2, "subset": ["nation", "segment", "balance"]}},
        {"df.fillna": {"value": {"nation": -1, "segment": "none"}}},
        {"df.drop": {"columns": "balance"}},
    ])


@query("""
    SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations""")
def explode_words(spark, folder):
    df = table(spark, folder, "conversations").select("conv_id", "turn", F.split("text", " ", -1).alias("word"))
    return verbs.call(df, "explode", {"column": "word"})


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS TIME) BETWEEN TIME '09:00:00' AND TIME '17:00:00'")
def time_of_day(spark, folder):
    df = table(spark, folder, "events").select("event_id", "event_type", "ts")
    return verbs.call(df, "between_time", {"start_time": "9:00", "end_time": "17:00", "on": "ts"}).drop("ts")


@query("""
    WITH l AS (SELECT o_orderkey, regexp_replace(o_orderpriority, '[0-9]+', '%REPL%', 'g') AS p, o_orderstatus AS s
               FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')),
    r AS (SELECT o_orderkey, regexp_replace(CASE WHEN o_orderstatus = 'O' THEN '9' || substr(o_orderpriority, 2)
                                                 ELSE o_orderpriority END, '[0-9]+', '%REPL%', 'g') AS p,
                 CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS s
          FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'))
    SELECT o_orderkey, CASE WHEN r.s IS NULL THEN 'left_only' WHEN l.s IS NULL THEN 'right_only' ELSE 'diff' END AS status,
           l.p AS left_p, r.p AS right_p, l.s AS left_s, r.s AS right_s
    FROM l FULL JOIN r USING (o_orderkey)
    WHERE l.s IS NULL OR r.s IS NULL OR l.s <> r.s OR l.p <> r.p""")
def table_diff(spark, folder):
    orders = table(spark, folder, "orders")
    left = orders.filter("not (o_orderpriority = '5-LOW' and o_orderstatus = 'P')").selectExpr(
        "o_orderkey", "o_orderpriority as p", "o_orderstatus as s")
    right = orders.filter("not (o_orderpriority = '1-URGENT' and o_orderstatus = 'F')").selectExpr(
        "o_orderkey",
        "case when o_orderstatus = 'O' then concat('9', substr(o_orderpriority, 2)) else o_orderpriority end as p",
        "case when o_totalprice > 400000 then 'X' else o_orderstatus end as s")
    return compare.compare_tables(left, right, ["o_orderkey"], ["p", "s"], ["[0-9]+"])


@query("""
    SELECT c_custkey, regexp_replace(regexp_replace(c_name, '[0-9]{3,}', '%REPL%', 'g'), '^Cust', '%REPL%', 'g') AS masked
    FROM customer""")
def regex_mask(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", masked(F.col("c_name"), ["[0-9]{3,}", "^Cust"]).alias("masked"))


@query("""
    SELECT 'left' AS side, c_custkey AS id FROM customer WHERE c_custkey NOT IN (
      SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    UNION ALL SELECT 'right', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def symmetric_difference(spark, folder):
    customers = table(spark, folder, "customer").selectExpr("c_custkey as id")
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr("o_custkey as id")
    return jobs.symmetric_difference(customers, urgent, ["id"])


@query("""
    SELECT DISTINCT o_custkey AS id, o_orderstatus AS state FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
    UNION SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW'""")
def union_snapshots(spark, folder):
    orders = table(spark, folder, "orders").selectExpr("o_custkey as id", "o_orderstatus as state", "o_orderdate",
                                                       "o_orderpriority")
    early = orders.filter("o_orderdate < timestamp '1999-01-01'").select("id", "state")
    low = orders.filter("o_orderpriority = '5-LOW'").select("id", "state")
    return jobs.union_distinct(early, low)


@query("""
    SELECT event_id, CAST(ceil(value) AS BIGINT) AS up, CAST(floor(value) AS BIGINT) AS down, event_id % 2 = 1 AS odd,
           event_type AS state, CAST(user_id AS VARCHAR) AS second, json_extract_string(props, '$.k') AS k,
           len(range(event_id % 7, event_id % 20, 3)) AS n_levels
    FROM events""")
def scalar_misc(spark, folder):
    from trialframe.functions import values

    df = table(spark, folder, "events")
    pairs = values.as_map(["type", "user"], [F.col("event_type"), F.col("user_id")])
    hosts = F.array(*[F.struct(F.lit(t).alias("host_type"), c.cast("string").alias("name")) for t, c in (
        ("client", F.col("event_id")), ("server", F.col("event_type")), ("client", F.col("user_id")))])
    levels = values.range_levels(F.col("event_id") % 7, F.col("event_id") % 20, 3)
    return df.select(
        "event_id", F.ceil("value").alias("up"), F.floor("value").alias("down"),
        values.truth(F.col("event_id") % 2).alias("odd"), F.element_at(pairs, "type").alias("state"),
        values.pick_host(hosts, "client", 1, "name").alias("second"), values.json_entry(F.col("props"), "k").alias("k"),
        F.size(levels).cast("bigint").alias("n_levels"))


@query("""
    SELECT c_mktsegment AS exp_name, c_custkey AS flow FROM customer
    WHERE regexp_matches(c_mktsegment, '^(?:B.*|.*Y$)')""")
def spec_filters(spark, folder):
    flows = table(spark, folder, "customer").selectExpr("c_custkey as flow", "c_mktsegment as exp_name")
    return flow.kept_flows_table(flows, flows.select("exp_name"), "B.*|.*Y$")


@query("""
    SELECT c_custkey AS exp_name, 'n' || c_nationkey AS suite,
           CASE WHEN c_acctbal < 0 THEN 'own' || c_custkey ELSE 'd' || m END AS suite_id
    FROM customer JOIN (SELECT c_nationkey, max(c_custkey) AS m FROM customer GROUP BY ALL) USING (c_nationkey)""")
def suite_id_resolve(spark, folder):
    base = table(spark, folder, "customer").selectExpr(
        "c_custkey as exp_name", "concat('n', c_nationkey) as suite", "c_acctbal")
    own = base.filter("c_acctbal < 0").selectExpr("suite", "exp_name", "concat('own', exp_name) as suite_id")
    default = base.groupBy("suite").agg(F.concat(F.lit("d"), F.max("exp_name").cast("string")).alias("suite_id"))
    return flow.resolve_ids(base.select("suite", "exp_name"), own, default)


@query("""
    SELECT doc_id, row_number() OVER (ORDER BY source, n_chars DESC, doc_id) - 1 AS place FROM documents""")
def ordinal_column(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return positions(df, [], ["source", "-n_chars", "doc_id"], "place").select("doc_id", "place")
