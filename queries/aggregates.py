"""Aggregation steps and whole-frame summaries."""

from pyspark.sql import functions as F

from queries import query, table
from trialframe.operators import aggregate as agg
from trialframe.operators import verbs
from trialframe.plans.flow import transform

CENTS = "cast(round(value * 100) as bigint)"


@query("""
    SELECT l_returnflag, l_linestatus, l_suppkey, avg(l_quantity) AS l_quantity_mean,
           min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
           round(stddev_samp(l_quantity), 6) AS l_quantity_std, count(l_quantity) AS l_quantity_count
    FROM lineitem GROUP BY ALL""")
def rep_agg(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber as rep", "l_quantity")
    out = transform(df, [{"name": "RepAggTransformer", "data_columns": ["l_quantity"]}])
    return out.withColumn("l_quantity_std", F.round("l_quantity_std", 6))


@query("""
    SELECT nullif(l_suppkey, 3) AS supp, nullif(l_returnflag, 'A') AS flag, sum(l_quantity) AS l_quantity_sum,
           count(l_quantity) AS l_quantity_count
    FROM lineitem WHERE l_suppkey <> 3 GROUP BY ALL""")
def rep_agg_null_keys(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "nullif(l_suppkey, 3) as supp", "nullif(l_returnflag, 'A') as flag", "l_linenumber as rep", "l_quantity")
    return agg.rep_aggregate(df, ["l_quantity"], agg_functions=["sum", "count"])


@query("""
    SELECT event_type, nullif(user_id, 5) AS user_id, avg(v) AS v_mean, min(v) AS v_min, max(v) AS v_max,
           round(stddev_samp(v), 4) AS v_std, count(v) AS v_count
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL""")
def group_agg(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_type", "nullif(user_id, 5) as user_id", f"{CENTS} as v")
    out = transform(df, [{"name": "GroupByAggTransformer", "data_columns": ["v"],
                          "groupby_columns": ["event_type", "user_id"]}])
    return out.withColumn("v_std", F.round("v_std", 4))


@query("""
    SELECT hour(ts) AS h, event_type, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v_sum
    FROM events GROUP BY ALL""")
def group_agg_factors(spark, folder):
    df = table(spark, folder, "events").selectExpr(
        "cast(hour(ts) as bigint) as h", "event_type", "user_id", f"{CENTS} as v",
        "case when event_id % 2 = 0 then array('user_id') else array('event_type', 'user_id') end as factor_columns")
    return agg.group_aggregate(df, ["v"], ["h", "$FACTORS$"], ["sum"])


@query("""
    SELECT event_type, median(v) AS v_median, round(var_samp(v), 2) AS v_var, CAST(sum(v) AS BIGINT) AS v_sum,
           count(DISTINCT v) AS v_nunique, arg_min(v, event_id) AS v_first, arg_max(v, event_id) AS v_last,
           count(*) AS v_size, round(stddev_samp(v) / sqrt(count(v)), 6) AS v_sem, round(skewness(v), 6) AS v_skew,
           round(kurtosis(v), 6) AS v_kurt, bool_or(v <> 0) AS v_any, bool_and(v <> 0) AS v_all
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL""")
def agg_vocabulary(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_id", "event_type", f"{CENTS} as v")
    out = agg.group_aggregate(
        df, ["v"], ["event_type"],
        ["median", "var", "sum", "nunique", "first", "last", "size", "sem", "skew", "kurt", "any", "all"],
        order_by="event_id")
    return out.withColumns({"v_var": F.round("v_var", 2), "v_sem": F.round("v_sem", 6),
                            "v_skew": F.round("v_skew", 6), "v_kurt": F.round("v_kurt", 6)})


@query("""
    SELECT user_id, avg(v) AS v_custom_tail FROM (
      SELECT user_id, CAST(round(value * 100) AS BIGINT) AS v,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    WHERE n <= 5 GROUP BY user_id""")
def custom_tail(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_id", "ts", "user_id", f"{CENTS} as v")
    return agg.group_aggregate(df, ["v"], ["user_id"], ["custom_tail"], 5, order_by=["ts", "event_id"])


@query("""
    SELECT p_type, median(p_retailprice) AS p_retailprice, count(*) AS n
    FROM part GROUP BY ALL""")
def group_median(spark, folder):
    df = table(spark, folder, "part").select("p_type", "p_retailprice")
    medians = verbs.chain(df, [{"df.groupby": {"by": ["p_type"]}}, {"df.median": {}}])
    sizes = verbs.chain(df, [{"df.groupby": {"by": ["p_type"]}}, {"df.size": {}}])
    return medians.join(sizes, "p_type").withColumnRenamed("size", "n")


@query("""
    WITH t AS (SELECT CASE WHEN p_size % 4 = 0 THEN NULL ELSE [p_brand, p_type] END AS tags, p_retailprice FROM part)
    SELECT CASE WHEN tags IS NULL THEN NULL ELSE '["' || tags[1] || '","' || tags[2] || '"]' END AS tags,
           max(p_retailprice) AS p_retailprice_max, count(p_retailprice) AS p_retailprice_count
    FROM t GROUP BY ALL""")
def hashable_keys(spark, folder):
    df = table(spark, folder, "part").selectExpr(
        "case when p_size % 4 = 0 then null else array(p_brand, p_type) end as tags", "p_retailprice")
    return agg.group_aggregate(df, ["p_retailprice"], ["tags"], ["max", "count"])


@query("""
    SELECT event_type, count(k) AS k_count, avg(k) AS k_mean, max(k) AS k_max FROM (
      SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY ALL""")
def coerce_numeric(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_type", "get_json_object(props, '$.k') as k")
    return agg.group_aggregate(df, ["k"], ["event_type"], ["count", "mean", "max"])


@query("""
    WITH v AS (SELECT l_quantity AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS p FROM lineitem),
    s AS (SELECT count(q) AS qc, avg(q) AS qm, round(stddev_samp(q), 4) AS qs, min(q) AS q0, quantile_cont(q, 0.25) AS q1,
                 quantile_cont(q, 0.5) AS q2, quantile_cont(q, 0.75) AS q3, max(q) AS q4,
                 count(p) AS pc, avg(p) AS pm, round(stddev_samp(p), 2) AS ps, min(p) AS p0,
                 quantile_cont(CAST(p AS DOUBLE), 0.25) AS p1, quantile_cont(CAST(p AS DOUBLE), 0.5) AS p2,
                 quantile_cont(CAST(p AS DOUBLE), 0.75) AS p3, max(p) AS p4 FROM v)
    SELECT 'count' AS statistic, CAST(qc AS DOUBLE) AS q, CAST(pc AS DOUBLE) AS p FROM s
    UNION ALL SELECT 'mean', qm, pm FROM s UNION ALL SELECT 'std', qs, ps FROM s
    UNION ALL SELECT 'min', q0, p0 FROM s UNION ALL SELECT '25%', q1, p1 FROM s
    UNION ALL SELECT '50%', q2, p2 FROM s UNION ALL SELECT '75%', q3, p3 FROM s
    UNION ALL SELECT 'max', q4, p4 FROM s""")
def describe(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_quantity as q", "cast(round(l_extendedprice * 100) as bigint) as p")
    out = agg.describe(df)
    std = F.col("statistic") == "std"
    return out.withColumns({"q": F.when(std, F.round("q", 4)).otherwise(F.col("q")),
                            "p": F.when(std, F.round("p", 2)).otherwise(F.col("p"))})


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")
def value_counts(spark, folder):
    return agg.value_counts(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""
    WITH v AS (SELECT l_quantity AS q, CAST(round(l_discount * 100) AS DOUBLE) AS d, CAST(round(l_tax * 100) AS DOUBLE) AS t
               FROM lineitem),
    s AS (SELECT corr(q, d) AS rqd, corr(q, t) AS rqt, corr(d, t) AS rdt, covar_samp(q, d) AS vqd, covar_samp(q, t) AS vqt,
                 covar_samp(d, t) AS vdt, var_samp(q) AS vq, var_samp(d) AS vd, var_samp(t) AS vt FROM v)
    SELECT 'corr' AS matrix, 'q' AS column, 1.0 AS q, round(rqd, 8) AS d, round(rqt, 8) AS t FROM s
    UNION ALL SELECT 'corr', 'd', round(rqd, 8), 1.0, round(rdt, 8) FROM s
    UNION ALL SELECT 'corr', 't', round(rqt, 8), round(rdt, 8), 1.0 FROM s
    UNION ALL SELECT 'cov', 'q', round(vq, 6), round(vqd, 6), round(vqt, 6) FROM s
    UNION ALL SELECT 'cov', 'd', round(vqd, 6), round(vd, 6), round(vdt, 6) FROM s
    UNION ALL SELECT 'cov', 't', round(vqt, 6), round(vdt, 6), round(vt, 6) FROM s""")
def corr_cov(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_quantity as q", "round(l_discount * 100) as d", "round(l_tax * 100) as t")
    parts = []
    for label, matrix, digits in (("corr", agg.corr(df), 8), ("cov", agg.cov(df), 6)):
        parts.append(matrix.select(F.lit(label).alias("matrix"), "column",
                                   *[F.round(n, digits).alias(n) for n in df.columns]))
    return parts[0].unionByName(parts[1])


@query("""
    SELECT CAST(sum(l_quantity) AS BIGINT) AS q_sum, max(l_quantity) AS q_max, median(l_quantity) AS q_median,
           count(DISTINCT l_quantity) AS q_nunique, min(l_discount) AS d_min,
           quantile_cont(l_discount, 0.9) AS d_q90 FROM lineitem""")
def frame_aggregates(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr("l_quantity as q", "l_discount as d")
    sums = verbs.call(df, "agg", {"func": {"q": ["sum", "max", "median", "nunique"], "d": ["min"]}})
    tail = verbs.call(df, "quantile", {"q": 0.9, "columns": ["d"]}).select(F.col("d").alias("d_q90"))
    return agg.side_by_side([sums, tail]).withColumn("q_sum", F.col("q_sum").cast("bigint"))


@query("""
    WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size)
    SELECT p_size FROM c WHERE n = (SELECT max(n) FROM c)""")
def most_frequent(spark, folder):
    return verbs.call(table(spark, folder, "part"), "mode", {"name": "p_size"})


@query("""
    SELECT o_custkey, max(o_totalprice) AS o_totalprice, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey,
           arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) AS o_orderpriority
    FROM orders GROUP BY o_custkey""")
def extremes(spark, folder):
    df = table(spark, folder, "orders").select("o_custkey", "o_totalprice", "o_orderkey", "o_orderpriority")
    return verbs.call(df, "idxmax", {"by": "o_totalprice", "keys": ["o_custkey"], "order_by": ["o_orderkey"]})


@query("""
    SELECT o_orderpriority, max(o_totalprice) AS o_totalprice, count(*) AS n FROM orders GROUP BY ALL""")
def named_apply(spark, folder):
    df = table(spark, folder, "orders").select("o_orderpriority", "o_totalprice")
    best = verbs.chain(df, [{"df.groupby": {"by": "o_orderpriority"}}, {"df.apply": {"func": "max"}}])
    sizes = verbs.chain(df, [{"df.groupby": {"by": "o_orderpriority"}}, {"df.pipe": {"func": "size"}}])
    return best.join(sizes.withColumnRenamed("size", "n"), "o_orderpriority")


@query("""
    SELECT e.event_type, f.factors, count(*) AS n FROM events e JOIN (
      SELECT event_type, 'event_type,' || (CASE WHEN count(*) % 2 = 0 THEN 'user_id' ELSE 'value' END) AS factors
      FROM events GROUP BY event_type) f USING (event_type) GROUP BY ALL""")
def factor_meta_join(spark, folder):
    from trialframe.sources.results import with_factor_columns

    events = table(spark, folder, "events").selectExpr("'s' as suite_name", "'1' as suite_id", "event_type as exp_name")
    factors = events.groupBy("suite_name", "suite_id", "exp_name").agg(
        F.when(F.count(F.lit(1)) % 2 == 0, F.array(F.lit("event_type"), F.lit("user_id"))).otherwise(
            F.array(F.lit("event_type"), F.lit("value"))).alias("factor_columns"))
    joined = with_factor_columns(events, factors)
    return joined.groupBy(F.col("exp_name").alias("event_type"), F.array_join("factor_columns", ",").alias("factors")).agg(
        F.count(F.lit(1)).alias("n"))
