"""Wide and long forms."""

from pyspark.sql import functions as F

from queries import query, table
from trialframe.operators import verbs

TYPES = ["click", "error", "purchase", "signup", "view"]


@query("""
    SELECT d, variable, n FROM (
      SELECT strftime(ts, '%Y-%m-%d') AS d, count(*) FILTER (event_type = 'click') AS click,
             count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
             count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view
      FROM events GROUP BY ALL) UNPIVOT (n FOR variable IN (click, error, purchase, signup, view))""")
def pivot_melt(spark, folder):
    df = table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("d"), "event_type", "event_id")
    wide = verbs.call(df, "pivot_table", {"index": "d", "columns": "event_type", "values": "event_id",
                                          "aggfunc": "count", "levels": TYPES})
    wide = verbs.call(wide, "fillna", {"value": {t: 0 for t in TYPES}})
    return verbs.call(wide, "melt", {"id_vars": "d", "value_vars": TYPES, "value_name": "n"})


@query("""
    SELECT o_custkey, CAST(sum(round(o_totalprice * 100)) FILTER (o_orderstatus = 'F') AS BIGINT) AS F,
           CAST(sum(round(o_totalprice * 100)) FILTER (o_orderstatus = 'O') AS BIGINT) AS O,
           CAST(sum(round(o_totalprice * 100)) FILTER (o_orderstatus = 'P') AS BIGINT) AS P
    FROM orders GROUP BY ALL""")
def unstack_sums(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_custkey", "o_orderstatus", "cast(round(o_totalprice * 100) as bigint) as price")
    sums = verbs.chain(df, [{"df.groupby": {"by": ["o_custkey", "o_orderstatus"]}}, {"df.sum": {"columns": "price"}}])
    return verbs.call(sums, "unstack", {"index": "o_custkey", "columns": "o_orderstatus", "values": "price"})


@query("""
    SELECT p_partkey, variable, value FROM (
      SELECT p_partkey, CAST(nullif(p_size, 10) AS DOUBLE) AS p_size, p_retailprice FROM part)
    UNPIVOT (value FOR variable IN (p_size, p_retailprice))""")
def stack_rows(spark, folder):
    df = table(spark, folder, "part").selectExpr("p_partkey", "nullif(p_size, 10) as p_size", "p_retailprice")
    return verbs.call(df, "stack", {"id_vars": "p_partkey"})


@query("""
    WITH a AS (SELECT l_returnflag AS f, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT 'q' AS key, max(q) FILTER (f = 'A') AS A, max(q) FILTER (f = 'N') AS N, max(q) FILTER (f = 'R') AS R FROM a
    UNION ALL SELECT 'n', max(n) FILTER (f = 'A'), max(n) FILTER (f = 'N'), max(n) FILTER (f = 'R') FROM a""")
def transpose_small(spark, folder):
    small = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.sum("l_quantity").cast("bigint").alias("q"), F.count(F.lit(1)).alias("n"))
    return verbs.call(small, "transpose", {"index": "l_returnflag"})


@query("""
    SELECT p_partkey AS part_id, p_name AS x_name, p_size * 2 AS x_size, p_size > 20 AS big FROM part""")
def rename_verbs(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    out = verbs.chain(df, [
        {"df.rename": {"columns": {"p_name": "name", "p_size": "size", "p_partkey": "id"}}},
        {"df.add_prefix": {"prefix": "x_"}},
        {"df.multiply": {"other": 2, "columns": ["x_size"]}},
        {"df.eval": {"expr": "big = x_size > 40"}},
        {"df.set_index": {"keys": "x_id"}},
        {"df.rename": {"columns": {"x_id": "part_id"}}},
        {"df.reindex": {"columns": ["part_id", "x_name", "x_size", "big"]}},
    ])
    return verbs.call(out, "set_axis", {"labels": ["part_id", "x_name", "x_size", "big"]})


@query("""
    SELECT CAST(k AS BIGINT) AS k, CAST(user_id AS VARCHAR) AS u, event_type AS t FROM (
      SELECT json_extract_string(props, '$.k') AS k, user_id, event_type FROM events)""")
def infer_types(spark, folder):
    df = table(spark, folder, "events").selectExpr("get_json_object(props, '$.k') as k", "user_id as u",
                                                   "event_type as t")
    return verbs.chain(df, [{"df.infer_objects": {"columns": ["k", "t"]}}, {"df.astype": {"dtype": {"u": "str"}}}])
