"""Running values, offsets, ranks, frames, gaps and time buckets."""

from pyspark.sql import functions as F

from queries import query, table
from trialframe.operators import verbs
from trialframe.operators.ordered import positions, quantiles

ORDER = ["ts", "event_id"]
EVENTS = "(SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def events(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "event_id", "ts", "user_id", "event_type", "cast(round(value * 100) as bigint) as v")


def by_user(df):
    return verbs.groupby(df, "user_id")


@query(f"""
    SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS v_sum, min(v) OVER w AS v_min, max(v) OVER w AS v_max,
           count(*) OVER w - 1 AS nth
    FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def cumulative(spark, folder):
    df = events(spark, folder)
    for verb, suffix in (("cumsum", "_sum"), ("cummin", "_min"), ("cummax", "_max")):
        df = verbs.call(by_user(df), verb, {"order_by": ORDER, "columns": ["v"], "suffix": suffix})
    df = verbs.call(by_user(df), "cumcount", {"order_by": ORDER, "name": "nth"})
    return df.select("event_id", "v_sum", "v_min", "v_max", "nth")


@query(f"""
    SELECT event_id, CAST(sum(v) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
    FROM {EVENTS}""")
def cumulative_all(spark, folder):
    done = verbs.call(events(spark, folder), "cumsum", {"order_by": ORDER, "columns": ["v"]})
    return done.selectExpr("event_id", "v as total")


@query(f"""
    SELECT event_id, lag(v, 2) OVER w AS v_shift, v - lag(v) OVER w AS v_diff,
           v::DOUBLE / lag(v) OVER w - 1 AS v_pct, lead(v) OVER w AS v_next
    FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def offsets(spark, folder):
    df = events(spark, folder)
    for verb, periods, suffix in (("shift", 2, "_shift"), ("diff", 1, "_diff"), ("pct_change", 1, "_pct"),
                                  ("shift", -1, "_next")):
        df = verbs.call(by_user(df), verb, {"order_by": ORDER, "columns": ["v"], "periods": periods, "suffix": suffix})
    return df.select("event_id", "v_shift", "v_diff", "v_pct", "v_next")


@query("""
    SELECT o_orderkey, rank() OVER w::DOUBLE AS p_min, (rank() OVER w + count(*) OVER t - 1)::DOUBLE AS p_max,
           rank() OVER w + (count(*) OVER t - 1) / 2.0 AS p_average, dense_rank() OVER w::DOUBLE AS p_dense,
           row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, o_orderkey)::DOUBLE AS p_first,
           rank() OVER w / count(*) OVER (PARTITION BY o_custkey) AS p_pct
    FROM (SELECT o_orderkey, o_custkey, round(o_totalprice / 100000) AS p FROM orders)
    WINDOW w AS (PARTITION BY o_custkey ORDER BY p DESC), t AS (PARTITION BY o_custkey, p)""".replace(
        "rank() OVER w::DOUBLE", "CAST(rank() OVER w AS DOUBLE)").replace(
        "dense_CAST(rank() OVER w AS DOUBLE)", "CAST(dense_rank() OVER w AS DOUBLE)"))
def ranks(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_orderkey", "o_custkey", "round(o_totalprice / 100000) as p")
    for method in ("min", "max", "average", "dense", "first"):
        df = verbs.rank(verbs.groupby(df, "o_custkey"), ["p"], method, ascending=False, order_by="o_orderkey",
                        suffix=f"_{method}")
    df = verbs.rank(verbs.groupby(df, "o_custkey"), ["p"], "min", ascending=False, pct=True, suffix="_pct")
    return df.drop("o_custkey", "p")


@query(f"""
    SELECT event_id, CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END AS v_mean,
           CASE WHEN count(v) OVER c >= 3 THEN max(v) OVER c END AS v_max
    FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING),
                         c AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def rolling_mean(spark, folder):
    df = verbs.rolling(by_user(events(spark, folder)), 3, ORDER, min_periods=2).apply("mean", ["v"], "_mean")
    df = verbs.rolling(by_user(df), 3, ORDER, center=True).apply("max", ["v"], "_max")
    return df.select("event_id", "v_mean", "v_max")


@query(f"""
    SELECT event_id, CASE WHEN count(v) OVER w >= 2 THEN CAST(sum(v) OVER w AS BIGINT) END AS v_sum,
           avg(v) OVER w AS v_mean
    FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def expanding_sum(spark, folder):
    df = verbs.expanding(by_user(events(spark, folder)), ORDER, min_periods=2).apply("sum", ["v"], "_sum")
    df = verbs.expanding(by_user(df), ORDER).apply("mean", ["v"], "_mean")
    return df.select("event_id", "v_sum", "v_mean")


@query(f"""
    SELECT event_id, last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
                       ROWS UNBOUNDED PRECEDING) AS forward,
           first_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN v END AS g FROM {EVENTS})""")
def fill_gaps(spark, folder):
    df = events(spark, folder).selectExpr("event_id", "ts", "user_id", "case when event_id % 3 = 0 then v end as forward",
                                          "case when event_id % 3 = 0 then v end as back")
    df = verbs.ffill(df, ORDER, ["forward"], ["user_id"])
    return verbs.bfill(df, ORDER, ["back"], ["user_id"]).select("event_id", "forward", "back")


@query(f"""
    WITH p AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN v END AS g,
                      row_number() OVER (ORDER BY ts, event_id) AS n FROM {EVENTS}),
    b AS (SELECT *, last_value(CASE WHEN g IS NOT NULL THEN n END IGNORE NULLS) OVER (ORDER BY n) AS n0,
                 last_value(g IGNORE NULLS) OVER (ORDER BY n) AS g0,
                 first_value(CASE WHEN g IS NOT NULL THEN n END IGNORE NULLS) OVER (
                   ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n1,
                 first_value(g IGNORE NULLS) OVER (
                   ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g1 FROM p)
    SELECT event_id, round(CASE WHEN g IS NOT NULL THEN g WHEN n1 IS NULL THEN g0
                           ELSE g0 + (g1 - g0) * ((n - n0)::DOUBLE / (n1 - n0)) END, 6) AS g FROM b""")
def interpolate(spark, folder):
    df = events(spark, folder).selectExpr("event_id", "ts", "case when event_id % 4 = 0 then v end as g")
    return verbs.interpolate(df, ORDER, ["g"]).select("event_id", F.round("g", 6).alias("g"))


@query(f"""
    SELECT a.event_id, round(sum(b.v * pow(0.75, a.n - b.n)) / sum(pow(0.75, a.n - b.n)), 4) AS v_ewm
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {EVENTS}) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {EVENTS}) b
      ON a.user_id = b.user_id AND b.n <= a.n GROUP BY a.event_id""")
def weighted_mean(spark, folder):
    done = verbs.ewm(by_user(events(spark, folder)), ORDER, alpha=0.25).apply("mean", ["v"], "_ewm")
    return done.select("event_id", F.round("v_ewm", 4).alias("v_ewm"))


@query(f"""
    SELECT strftime(g.h, '%Y-%m-%d %H:%M:%S') AS h, avg(v) AS v_mean, CAST(coalesce(sum(v), 0) AS BIGINT) AS v_sum,
           count(v) AS v_count
    FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS h
          FROM events) g
    LEFT JOIN {EVENTS} e ON date_trunc('hour', ts) = g.h AND event_type = 'error' GROUP BY ALL""")
def resample_hour(spark, folder):
    df = events(spark, folder).selectExpr("ts", "case when event_type = 'error' then v end as v")
    out = verbs.resample(df, "1h", "ts").apply(["mean", "sum", "count"], ["v"])
    return out.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("h"), "v_mean",
                      F.col("v_sum").cast("bigint").alias("v_sum"), "v_count")


@query(f"""
    SELECT g.event_type, strftime(g.d, '%Y-%m-%d') AS d, count(v) AS v_count, max(v) AS v_max
    FROM (SELECT event_type, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS d
          FROM events GROUP BY event_type) g
    LEFT JOIN {EVENTS} e ON e.event_type = g.event_type AND date_trunc('day', ts) = g.d GROUP BY ALL""")
def resample_groups(spark, folder):
    out = verbs.resample(verbs.groupby(events(spark, folder), "event_type"), "1D", "ts").apply(["count", "max"], ["v"])
    return out.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("d"), "v_count", "v_max")


@query(f"""
    SELECT event_id, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v,
           0 AS step FROM {EVENTS}
    UNION ALL
    SELECT event_id, CAST(min(v) OVER w AS BIGINT), 1
    FROM {EVENTS} WINDOW w AS (ORDER BY ts, event_id ROWS 4 PRECEDING)
    QUALIFY count(v) OVER w >= 5""")
def groupby_chain(spark, folder):
    df = events(spark, folder).select("event_id", "ts", "user_id", "v")
    sums = verbs.chain(df, [{"df.groupby": {"by": "user_id"}}, {"df.cumsum": {"order_by": ORDER, "columns": "v"}}])
    lows = verbs.chain(df, [{"df.rolling": {"window": 5, "order_by": ORDER}}, {"df.min": {"columns": "v"}},
                            {"df.dropna": {"subset": "v"}}])
    return sums.select("event_id", "v", F.lit(0).alias("step")).unionByName(
        lows.select("event_id", "v", F.lit(1).alias("step")))


@query("""
    SELECT l_suppkey, round(quantile_cont(p, 0.1), 3) AS q10, quantile_cont(p, 0.5) AS q50,
           round(quantile_cont(p, 0.99), 3) AS q99
    FROM (SELECT l_suppkey, round(l_extendedprice * 100) AS p FROM lineitem) GROUP BY ALL""")
def exact_quantiles(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr("l_suppkey", "round(l_extendedprice * 100) as p")
    out = quantiles(df, ["l_suppkey"], "p", {"q10": 0.1, "q50": 0.5, "q99": 0.99})
    return out.withColumns({"q10": F.round("q10", 3), "q99": F.round("q99", 3)})


@query("""
    SELECT o_orderkey, o_custkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3""")
def group_tail(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    last = verbs.chain(df, [{"df.groupby": {"by": "o_custkey"}},
                            {"df.tail": {"n": 3, "order_by": ["o_orderdate", "o_orderkey"]}}])
    return last.drop("o_orderdate")


@query("""
    SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT event_id FROM events LIMIT
      (SELECT CAST(round_even(count(*) * 0.3, 0) AS BIGINT) FROM events))""")
def exact_sample(spark, folder):
    drawn = verbs.call(table(spark, folder, "events"), "sample", {"frac": 0.3, "random_state": 7})
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query(f"""
    SELECT g.user_id, strftime(g.h, '%Y-%m-%d %H:%M:%S') AS h, CAST(coalesce(sum(v), 0) AS BIGINT) AS v_sum, count(v) AS v_count
    FROM (SELECT user_id, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS h
          FROM events GROUP BY user_id) g
    LEFT JOIN {EVENTS} e ON e.user_id = g.user_id AND date_trunc('hour', ts) = g.h GROUP BY ALL""")
def resample_groups_filled(spark, folder):
    out = verbs.resample(by_user(events(spark, folder)), "1h", "ts").apply(["sum", "count"], ["v"])
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("h"), F.col("v_sum").cast("bigint").alias("v_sum"), "v_count")


@query("""
    SELECT strftime(last_day(o_orderdate), '%Y-%m-%d') AS month, count(*) AS n, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS price
    FROM orders GROUP BY ALL""")
def resample_month(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderdate as day", "1 as n", "cast(round(o_totalprice * 100) as bigint) as price")
    out = verbs.resample(df, "ME", "day", fill_empty=False).apply(["count", "max"], ["price"])
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("month"), F.col("price_count").alias("n"), F.col("price_max").alias("price"))


@query(f"""
    SELECT strftime(g.t, '%Y-%m-%d %H:%M:%S') AS t, v
    FROM (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 HOUR)) AS t FROM (SELECT date_trunc('minute', ts) AS m FROM events)) g
    LEFT JOIN (SELECT date_trunc('minute', ts) AS m, max(v) AS v FROM {EVENTS} GROUP BY 1) e ON e.m = g.t""")
def asfreq_hour(spark, folder):
    df = events(spark, folder).groupBy(F.date_trunc("minute", "ts").alias("m")).agg(F.max("v").alias("v"))
    return verbs.asfreq(df, "1h", "m").select(F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("t"), "v")


@query("""
    SELECT o_orderkey, round(first_value(v) OVER (PARTITION BY o_custkey, run ORDER BY o_orderdate, o_orderkey), 4) AS v_ewm
    FROM (SELECT *, count(v) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run
          FROM (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
                       THEN round(o_totalprice, 2) END AS v FROM orders))""")
def ewm_gaps(spark, folder):
    """One value per customer and then only gaps: the mean stays."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.round("o_totalprice", 2).alias("price"))
    group, order = verbs.groupby(df, "o_custkey"), ["o_orderdate", "o_orderkey"]
    first = verbs.call(group, "cumcount", {"order_by": order, "name": "nth"}).withColumn("v", F.when(F.col("nth") == 0, F.col("price")))
    done = verbs.ewm(verbs.groupby(first, "o_custkey"), order, alpha=0.5).apply("mean", ["v"], "_ewm")
    return done.select("o_orderkey", F.round("v_ewm", 4).alias("v_ewm"))


@query("""
    SELECT doc_id, row_number() OVER (ORDER BY 'https://host.example/a/long/common/beginning/' || coalesce(text, ''), doc_id) - 1 AS place
    FROM documents""")
def long_text_order(spark, folder):
    """Places in the order of whole texts that begin alike."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("https://host.example/a/long/common/beginning/"), F.coalesce("text", F.lit(""))).alias("url"))
    return positions(docs, [], ["url", "doc_id"], "place").select("doc_id", "place")


@query(f"""
    SELECT event_id, CASE WHEN count(v) OVER w >= 2 THEN CAST(sum(v) OVER w AS BIGINT) END AS v_sum,
           CAST(max(v) OVER w AS BIGINT) AS v_max, count(v) OVER w AS v_count,
           CAST(min(v) OVER b AS BIGINT) AS v_min
    FROM {EVENTS}
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '129599999999 microseconds' PRECEDING AND CURRENT ROW),
           b AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '36 hours' PRECEDING AND INTERVAL '1 microsecond' PRECEDING)""")
def rolling_time(spark, folder):
    df = events(spark, folder)
    for func, least in (("sum", 2), ("max", None), ("count", None)):
        df = verbs.rolling(by_user(df), "36h", on="ts", min_periods=least).apply(func, ["v"], f"_{func}")
    df = verbs.rolling(by_user(df), "36h", on="ts", closed="left").apply("min", ["v"], "_min")
    return df.select("event_id", "v_sum", "v_max", "v_count", "v_min")
