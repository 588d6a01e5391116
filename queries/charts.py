"""Chart-ready tables."""

from pyspark.sql import functions as F

from queries import query, table
from trialframe.functions.text import file_name, label, mapped, round_short
from trialframe.operators import aggregate as agg
from trialframe.plans import layout
from trialframe.plans.layout import Level, Metric, Rule
from trialframe.sinks.writers import error_bars, scatter

TYPES = ["view", "click", "purchase", "error"]


def flags(spark, folder):
    """Sums per return flag, line status and supplier nation."""
    items = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", "l_quantity")
    suppliers = table(spark, folder, "supplier").selectExpr("s_suppkey as l_suppkey", "s_nationkey")
    return items.join(suppliers, "l_suppkey").groupBy("l_returnflag", "l_linestatus", "s_nationkey").agg(
        F.sum("l_quantity").cast("bigint").alias("q"), F.count(F.lit(1)).alias("n"))


FLAGS = """(SELECT l_returnflag, l_linestatus, s_nationkey, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"""


@query("""
    SELECT event_id, event_type, list_position(['view', 'click', 'purchase', 'error'], event_type) - 1 AS place
    FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')""")
def allowed_sort(spark, folder):
    df = table(spark, folder, "events").select("event_id", "event_type")
    kept = layout.allowed_filter(df, ["event_type"], {"event_type": TYPES})
    return kept.withColumn("place", layout.value_rank("event_type", TYPES)).orderBy("place", "event_id")


@query("""
    SELECT l_orderkey, l_linenumber, 'amount' AS "$metrics$", l_quantity * 2.0 / 1.0 AS l_quantity, l_extendedprice,
           l_discount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'price', l_quantity, l_extendedprice * 1.0 / 1000.0,
           l_discount * 100.0 / 1.0 FROM lineitem""")
def metric_fanout(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return layout.fan_out(df, {
        "amount": Metric("l_quantity", value_multiplicator=2.0),
        "price": Metric("l_extendedprice", "l_discount", value_divider=1000.0, error_multiplicator=100.0),
    })


@query("""
    SELECT l_orderkey, l_linenumber, "$metrics$", "$metric_unit$", value_no, value_col, error_col, value, error FROM (
      SELECT l_orderkey, l_linenumber, 'amount' AS "$metrics$", 'pcs' AS "$metric_unit$", 0 AS value_no,
             'l_quantity' AS value_col, NULL AS error_col, l_quantity * 1.0 AS value, NULL AS error FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'rate', NULL, 0, 'l_discount', 'l_tax', l_discount * 100.0, l_tax * 1.0
      FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'rate', NULL, 1, 'l_tax', 'l_tax', l_tax * 100.0, l_tax * 1.0 FROM lineitem)
    WHERE value IS NOT NULL""")
def metric_values(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                                                 F.col("l_tax").alias("t"))
    metrics = {"amount": Metric("l_quantity", unit_label="pcs"),
               "rate": Metric(["l_discount", "l_tax"], ["t", "t"], value_multiplicator=100.0)}
    long = layout.metric_values(layout.fan_out(df, metrics), metrics)
    return long.withColumn("error_col", F.when(F.col("error_col") == "t", "l_tax"))


@query("""
    WITH i AS (SELECT DISTINCT r_name, n_name, c_mktsegment
               FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    r AS (SELECT r_name, n_name, count(*) AS n FROM i GROUP BY ALL),
    g AS (SELECT r_name, count(*) AS n_rows, max(n) AS n_cols, min(n) = max(n) AS is_grid FROM r GROUP BY ALL)
    SELECT r_name, n_name, c_mktsegment, dense_rank() OVER (ORDER BY r_name) - 1 AS fig_idx,
           dense_rank() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS row_idx,
           dense_rank() OVER (PARTITION BY r_name, n_name ORDER BY c_mktsegment) - 1 AS col_idx, n_rows, n_cols, is_grid
    FROM i JOIN g USING (r_name)""")
def grid_index(spark, folder):
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ids = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "r_name", "n_name", "c_mktsegment").distinct()
    levels = [Level("fig", ["r_name"]), Level("row", ["n_name"]), Level("col", ["c_mktsegment"])]
    placed = layout.with_ordinals(ids, levels)
    return placed.join(layout.grid_shape(placed), "fig_idx")


@query(f"""
    WITH b AS (SELECT DISTINCT s_nationkey, l_returnflag, l_linestatus FROM {FLAGS}),
    i AS (SELECT *, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY l_returnflag) - 1 AS g,
                 row_number() OVER (PARTITION BY s_nationkey ORDER BY l_returnflag, l_linestatus) - 1 AS n FROM b),
    c AS (SELECT *, CAST(round(n * 0.7 + g * 0.3, 6) AS DOUBLE) AS center FROM i)
    SELECT s_nationkey, l_returnflag, l_linestatus, n AS bar_no, center AS bar_center_pos,
           round(center - 0.3, 6) AS bar_left_pos,
           round((min(center) OVER w + max(center) OVER w) / 2, 6) AS group_center_pos
    FROM c WINDOW w AS (PARTITION BY s_nationkey, l_returnflag)""")
def bar_positions(spark, folder):
    df = flags(spark, folder)
    placed = layout.with_ordinals(df, [
        Level("subplot", ["s_nationkey"]), Level("group", ["l_returnflag"]), Level("bar", ["l_linestatus"])])
    where = layout.bar_positions(placed, ["subplot_idx"], 0.6, 0.1, 0.3)
    names = placed.select("s_nationkey", "l_returnflag", "l_linestatus", "subplot_idx", "group_idx", "bar_idx")
    joined = names.join(where, ["subplot_idx", "group_idx", "bar_idx"])
    return joined.select("s_nationkey", "l_returnflag", "l_linestatus", "bar_no", *[
        F.round(c, 6).alias(c) for c in ("bar_center_pos", "bar_left_pos", "group_center_pos")])


@query(f"""
    SELECT l_returnflag, l_linestatus, s_nationkey, CAST(q AS DOUBLE) AS q,
           CAST(coalesce(sum(q) OVER w, 0) AS DOUBLE) AS bottom, CAST(sum(q) OVER (PARTITION BY l_returnflag, s_nationkey) AS DOUBLE) AS total
    FROM (SELECT * FROM {FLAGS} WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'F'))
    WINDOW w AS (PARTITION BY l_returnflag, s_nationkey ORDER BY l_linestatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def stack_bottoms(spark, folder):
    df = flags(spark, folder).selectExpr(
        "l_returnflag", "l_linestatus", "s_nationkey", "case when not (l_returnflag = 'N' and l_linestatus = 'F') then cast(q as double) end as q")
    bar = ["l_returnflag", "s_nationkey"]
    stacked = layout.stack_bottoms(df, bar, ["l_linestatus"], "q", "bottom")
    totals = df.groupBy(*bar).agg(F.sum("q").alias("total"))
    return stacked.join(totals, bar)


BOX = """(SELECT event_type, CAST(round(value * 100) AS DOUBLE) AS v FROM events),
    s AS (SELECT event_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
          FROM v GROUP BY ALL),
    j AS (SELECT * , q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM v JOIN s USING (event_type))"""


@query(f"""
    WITH v AS {BOX}
    SELECT event_type, q1, median, q3, least(min(v) FILTER (v >= lo), q1) AS whisker_low,
           greatest(max(v) FILTER (v <= hi), q3) AS whisker_high, count(*) FILTER (v < lo OR v > hi) AS n_outliers,
           count(*) AS n_values, min(v) AS value_min, max(v) AS value_max
    FROM j GROUP BY event_type, q1, median, q3""")
def box_stats(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_type", "round(value * 100) as value")
    return layout.box_statistics(df, ["event_type"])


@query(f"WITH v AS {BOX} SELECT event_type, v AS value FROM j WHERE v < lo OR v > hi")
def box_outliers(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_type", "round(value * 100) as value")
    return layout.box_outliers(df, ["event_type"])


@query("""
    SELECT p_partkey, CASE WHEN p_brand LIKE '%1' AND p_size > 20 THEN 'red' WHEN p_type = 'SMALL' THEN 'green'
                           ELSE 'gray' END AS color,
           CASE WHEN p_brand LIKE '%1' AND p_size > 20 THEN 'o' END AS marker,
           CASE WHEN p_type = 'SMALL' THEN 'small: ' || p_brand
                ELSE coalesce(CASE p_type WHEN 'LARGE' THEN 'big' END, p_type) END AS label,
           CASE WHEN p_brand LIKE '%1' AND p_size > 20 THEN 0 WHEN p_type = 'SMALL' THEN 1 ELSE 2 END AS rule
    FROM part""")
def config_resolve(spark, folder):
    rules = [
        Rule({"color": "red", "marker": "o"}, "p_brand like '%1' && p_size > 20"),
        Rule({"color": "green", "label": {"template": "small: {p_brand}"}}, "p_type == 'SMALL'"),
        Rule({"color": "gray", "label": {"template": "{p_type}"}}),
    ]
    df = table(spark, folder, "part")
    chosen = layout.resolve(rules, df.columns, ["color", "marker", "label"], {"LARGE": "big"})
    return df.select("p_partkey", *[c.alias(n) for n, c in chosen.items()],
                     layout.matching_rule(rules, ["color"]).alias("rule"))


@query("""
    WITH x AS (SELECT o_orderkey, o_totalprice * 10.0 ** (o_orderkey % 9 - 6) AS v FROM orders),
    s AS (SELECT *, CASE WHEN v >= 1e9 THEN v / 1e9 WHEN v >= 1e6 THEN v / 1e6 WHEN v >= 1e3 THEN v / 1e3 ELSE v END AS u,
                 CASE WHEN v >= 1e9 THEN 'B' WHEN v >= 1e6 THEN 'M' WHEN v >= 1e3 THEN 'k' ELSE '' END AS x FROM x),
    f AS (SELECT o_orderkey, x, CASE WHEN u < 0.001 THEN printf('%.4f', u) WHEN u < 0.01 THEN printf('%.3f', u)
                   WHEN u < 0.1 THEN printf('%.2f', u) ELSE printf('%.1f', u) END AS t FROM s),
    r AS (SELECT o_orderkey, rtrim(rtrim(t, '0'), '.') || x AS t FROM f)
    SELECT o_orderkey, CASE WHEN t = '100M' THEN '0.1B' ELSE t END AS shown FROM r""")
def round_short_numbers(spark, folder):
    scaled = F.col("o_totalprice") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 9 - 6).cast("double"))
    return table(spark, folder, "orders").select("o_orderkey", round_short(scaled).alias("shown"))


@query("""
    WITH d AS (SELECT event_type, min(v) AS lo, max(v) AS hi FROM (
                 SELECT event_type, CAST(round(value * 100) AS DOUBLE) AS v FROM events) GROUP BY ALL)
    SELECT event_type, lo AS data_min, hi AS data_max, lo * 0.5 AS axis_min, hi * 1.25 AS axis_max, i AS tick_no,
           CASE WHEN i = 4 THEN hi * 1.25 ELSE lo * 0.5 + i * ((hi * 1.25 - lo * 0.5) / 4) END AS tick
    FROM d, (SELECT unnest(range(5)) AS i)""")
def axis_limits(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_type", "round(value * 100) as v")
    out = layout.axis_limits(df, ["event_type"], F.col("v"), F.col("v"), {"data_min_scaler": 0.5},
                             {"data_max_scaler": 1.25}, 5)
    return out.select("event_type", "data_min", "data_max", "axis_min", "axis_max",
                      F.posexplode("ticks").alias("tick_no", "tick"))


@query("""
    SELECT p_partkey, coalesce(CASE p_brand WHEN 'Brand#1' THEN 'One' END, p_brand) || ': ' || p_type AS shown,
           replace(replace('p_brand=' || p_brand || '_p_type=' || p_type || '_p_retailprice=' || p_retailprice, '.', ''),
                   ' ', '') AS file,
           coalesce(CASE p_type WHEN 'ECONOMY' THEN 'eco' END, p_type) AS short_type
    FROM part""")
def label_template(spark, folder):
    df = table(spark, folder, "part")
    return df.select("p_partkey", label("{p_brand}: {p_type}", df.columns, {"Brand#1": "One"}).alias("shown"),
                     file_name(["p_brand", "p_type", "p_retailprice"]).alias("file"),
                     mapped(F.col("p_type"), {"ECONOMY": "eco"}).alias("short_type"))


@query("""
    WITH f AS (SELECT event_type, props, min(event_id) AS first FROM events GROUP BY ALL)
    SELECT event_type, props AS label, row_number() OVER (PARTITION BY event_type ORDER BY first DESC) - 1 AS legend_no
    FROM f""")
def legend_order(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_id", "event_type", "props as label")
    return layout.legend(df, ["event_type"], "label", "event_id", reverse=True)


@query(f"""
    WITH m AS (SELECT 'amount' AS "$metrics$", 'pcs' AS unit, l_returnflag, l_linestatus, s_nationkey,
                      CAST(q AS DOUBLE) AS value FROM {FLAGS}
               UNION ALL SELECT 'lines', NULL, l_returnflag, l_linestatus, s_nationkey, CAST(n AS DOUBLE) FROM {FLAGS}),
    k AS (SELECT * FROM m WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'F'))
    SELECT "$metrics$", unit AS "$metric_unit$", CAST(s_nationkey AS VARCHAR) AS s_nationkey, l_returnflag, l_linestatus,
           value, dense_rank() OVER (ORDER BY "$metrics$") - 1 AS fig_idx,
           dense_rank() OVER (PARTITION BY "$metrics$" ORDER BY CAST(s_nationkey AS VARCHAR)) - 1 AS col_idx,
           dense_rank() OVER (PARTITION BY "$metrics$", s_nationkey ORDER BY l_returnflag) - 1 AS group_idx,
           dense_rank() OVER (PARTITION BY "$metrics$", s_nationkey, l_returnflag ORDER BY l_linestatus) - 1 AS bar_idx,
           CAST(0 AS DOUBLE) AS bar_part_bottom, l_returnflag || '/' || l_linestatus AS bar_label
    FROM k""")
def nested_layout(spark, folder):
    df = flags(spark, folder)
    tables = layout.chart_tables(df, {
        "metrics": {"amount": {"value_cols": "q", "unit_label": "pcs"}, "lines": {"value_cols": "n"}},
        "fig_foreach": {"cols": ["$metrics$"]},
        "cum_plot_config": [{"subplot_grid": {"rows": [], "cols": ["s_nationkey"]}}],
        "cum_subplot_config": [{"chart": {
            "group_foreach": {"cols": ["l_returnflag"]},
            "bar_foreach": {"cols": ["l_linestatus"], "jp_except": "l_returnflag == 'R' && l_linestatus == 'F'",
                            "label": {"template": "{l_returnflag}/{l_linestatus}"}},
        }}],
    })
    return tables["bars"].select("$metrics$", "$metric_unit$", "s_nationkey", "l_returnflag", "l_linestatus", "value",
                                 "fig_idx", "col_idx", "group_idx", "bar_idx", "bar_part_bottom", "bar_label")


@query(f"""
    WITH m AS (SELECT 'amount' AS "$metrics$", l_returnflag, l_linestatus, s_nationkey, CAST(q AS DOUBLE) AS value FROM {FLAGS}
               UNION ALL SELECT 'lines', l_returnflag, l_linestatus, s_nationkey, CAST(n AS DOUBLE) FROM {FLAGS}),
    b AS (SELECT *, row_number() OVER s * 0.6 + dense_rank() OVER (PARTITION BY "$metrics$", s_nationkey ORDER BY l_returnflag) * 0.1
                    - 0.7 AS center
          FROM m WINDOW s AS (PARTITION BY "$metrics$", s_nationkey ORDER BY l_returnflag, l_linestatus)),
    a AS (SELECT "$metrics$", CAST(s_nationkey AS VARCHAR) AS s_nationkey, round(CAST(max(center) + 0.3 AS DOUBLE), 6) AS x_data_max,
                 max(value) AS y_data_max, max(value) * 1.25 AS y_max, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus DESC) AS legend
          FROM b GROUP BY ALL)
    SELECT "$metrics$", s_nationkey, x_data_max, CAST(0 AS DOUBLE) AS y_min, y_data_max, y_max, CAST(NULL AS DOUBLE) AS x_max,
           CASE WHEN "$metrics$" = 'amount' THEN y_max / 2 END AS middle_tick, legend FROM a""")
def chart_axes(spark, folder):
    """Limits, ticks and legends that follow from the bars of each subplot."""
    tables = layout.chart_tables(flags(spark, folder), {
        "metrics": {"amount": {"value_cols": "q"}, "lines": {"value_cols": "n"}},
        "fig_foreach": {"cols": ["$metrics$"]},
        "cum_plot_config": [{"subplot_grid": {"rows": [], "cols": ["s_nationkey"]}}],
        "cum_subplot_config": [
            {"jp_query": "`$metrics$` == 'amount'", "yaxis": {"ticks": 3}},
            {"yaxis": {"lim": {"max": {"data_max_scaler": 1.25}}}, "legend_ax": {"label": {"template": "{l_linestatus}"}},
             "chart": {"group_foreach": {"cols": ["l_returnflag"]}, "bar_foreach": {"cols": ["l_linestatus"]}}}],
    })
    place = ["fig_idx", "row_idx", "col_idx"]
    ordered = F.array_sort(F.collect_list(F.struct("legend_no", "label")))
    legends = tables["legend"].groupBy(*place).agg(F.array_join(F.transform(ordered, lambda x: x["label"]), ",").alias("legend"))
    return tables["axes"].join(legends, place).select(
        "$metrics$", "s_nationkey", F.round("x_data_max", 6).alias("x_data_max"), "y_min", "y_data_max", "y_max", "x_max",
        F.element_at("y_ticks", 2).alias("middle_tick"), "legend")


@query("""
    SELECT p_size AS x, p_type AS series, avg(c) AS mean, round(coalesce(stddev_samp(c), 0), 6) AS std
    FROM (SELECT p_size, p_type, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part) GROUP BY ALL""")
def error_bar_points(spark, folder):
    df = table(spark, folder, "part").selectExpr("p_size as x", "p_type as series",
                                                 "cast(round(p_retailprice * 100) as bigint) as c")
    stats = agg.group_aggregate(df, ["c"], ["x", "series"], ["mean", "std"])
    return error_bars(stats, "x", "series", "c_mean", "c_std").withColumn("std", F.round("std", 6))


@query("""
    SELECT l_partkey AS x, l_suppkey AS y, CASE WHEN l_returnflag = 'R' THEN 'red' ELSE 'black' END AS color
    FROM lineitem""")
def scatter_points(spark, folder):
    from trialframe.plans.flow import transform

    df = table(spark, folder, "lineitem").selectExpr("l_partkey as x", "l_suppkey as y", "l_returnflag")
    steps = [{"df.eval": {"expr": "color = 'black'"}},
             {"name": "ConditionalTransformer", "col": "l_returnflag", "dest": "color", "value": {"R": "red"}}]
    return scatter(transform(df, steps))


@query("""
    SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '==' ELSE '&&"' END AS name FROM orders
    WHERE name IN ('1-URGENT==', '2-HIGH&&"')""")
def predicate_literals(spark, folder):
    """Literals that hold operators and quotes keep them."""
    names = table(spark, folder, "orders").select("o_orderkey", F.concat(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "==").otherwise('&&"')).alias("name"))
    return names.filter(layout.predicate("""  "name" == '1-URGENT==' || (name == '2-HIGH&&"' && o_orderkey >= `0`)"""))
