"""Written outputs read back, and steps that come from nested configuration."""

from pyspark.sql import functions as F

from queries import query, table
from queries.charts import BOX
from trialframe.plans import flow, layout
from trialframe.session import new_shared_path
from trialframe.sinks import writers
from trialframe.sources import tree


@query("""
    SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer""")
def csv_summary(spark, folder):
    df = table(spark, folder, "customer").selectExpr(
        "c_custkey", "c_name", "c_acctbal", "case when c_acctbal >= 0 then c_mktsegment end as segment")
    path = new_shared_path(spark, "csv")
    writers.write_csv(df, path, order_by=["segment", "c_custkey"])
    return spark.read.schema(df.schema).option("header", True).csv(path)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def table_dump(spark, folder):
    path = new_shared_path(spark, "dump")
    writers.write_table(table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path,
                        partition_by=["o_orderstatus"])
    return spark.read.parquet(path)


@query(r"""
    SELECT p_partkey || ' & ' || replace(p_brand, '#', '\#') || ' & '
           || coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END, 'NaN') || ' \\' AS value FROM part
    UNION ALL SELECT unnest(['\begin{tabular}{lll}', '\toprule', 'p\_partkey & p\_brand & large \\', '\midrule', '\bottomrule',
                             '\end{tabular}'])""")
def latex_table(spark, folder):
    df = table(spark, folder, "part").selectExpr("p_partkey", "p_brand", "case when p_size > 25 then p_size end as large")
    path = new_shared_path(spark, "latex")
    writers.write_latex(df, path, "p_partkey")
    return spark.read.text(path)


@query("""
    SELECT c_mktsegment, '    <tr><td>' || c_custkey || '</td><td>&lt;' || c_name || '&gt;</td></tr>' AS value FROM customer
    UNION ALL SELECT c_mktsegment, unnest(['<table>', '  <thead><tr><th>c_custkey</th><th>name</th></tr></thead>', '  <tbody>',
                                           '  </tbody>', '</table>']) FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def html_tables(spark, folder):
    df = table(spark, folder, "customer").selectExpr("c_mktsegment", "c_custkey", "concat('<', c_name, '>') as name")
    path = new_shared_path(spark, "html")
    writers.write_html(df, path, "c_custkey", ["c_mktsegment"])
    return spark.read.text(path)


@query("""
    SELECT l_returnflag, l_linestatus, avg(c) AS cents_mean, count(*) AS cents_count, max(c) AS cents_max
    FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem) WHERE l_quantity >= 10 GROUP BY ALL""")
def configured_steps(spark, folder):
    """Included steps with variables, run up to a named one."""
    sources = {"template": {"common": {"$ETL$": {"large": {"transformers": [{"df.query": {"expr": "l_quantity >= [% LEAST %]"}}]}}}}}
    body = flow.resolve_variables(flow.resolve_includes({
        "$ETL_VARS$": {"LEAST": 10, "KEYS": "l_returnflag"},
        "transformers": [
            {"$INCLUDE_STEPS$": {"template": "common", "pipeline": "large"}},
            {"name": "GroupByAggTransformer", "data_columns": ["cents"], "groupby_columns": ["[% KEYS %]", "l_linestatus"],
             "agg_functions": ["mean", "count", "max"]},
            {"name": "FilterColumnTransformer", "filters": {"l_returnflag": "none"}},
        ]}, sources))
    df = table(spark, folder, "lineitem").selectExpr(
        "l_quantity", "l_returnflag", "l_linestatus", "cast(round(l_extendedprice * 100) as bigint) as cents")
    out = flow.transform(df, body["transformers"], until="FilterColumnTransformer")
    return out.select("l_returnflag", "l_linestatus", "cents_mean", "cents_count", "cents_max")


@query("""
    SELECT o_orderstatus AS status, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents FROM orders GROUP BY ALL""")
def own_steps(spark, folder):
    """A transformer and a loader of one's own, used by name."""
    own = flow.STANDARD.copy()
    own.add("transformer", "SumTransformer", lambda df, by, column: df.groupBy(by).agg(F.sum(column).alias(column)))
    own.add("loader", "RenamedLoader", lambda df, info, names: writers.write_table(df.withColumnsRenamed(names), info.folder))
    df = table(spark, folder, "orders").selectExpr("o_orderstatus", "cast(round(o_totalprice * 100) as bigint) as cents")
    out = flow.transform(df, [{"name": "SumTransformer", "by": "o_orderstatus", "column": "cents"}], own)
    path = new_shared_path(spark, "own")
    flow.load(out, {"RenamedLoader": {"names": {"o_orderstatus": "status"}}}, flow.LoadInfo("own", path), own)
    return spark.read.parquet(path)


@query("""
    SELECT '/r/my_suite_' || c_nationkey || '/' || c_mktsegment || '/run_' || c_custkey || '/rep_' || rep AS path,
           'my_suite' AS suite_name, CAST(c_nationkey AS VARCHAR) AS suite_id, c_mktsegment AS exp_name, c_custkey AS run, rep
    FROM customer, (SELECT unnest(range(2)) AS rep)""")
def job_paths(spark, folder):
    """Job keys to working directories and back."""
    jobs = table(spark, folder, "customer").selectExpr("*", "explode(array(0, 1)) as number")
    path = tree.job_path(F.lit("/r"), F.lit("my_suite"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"),
                         F.col("c_custkey"), F.col("number"))
    files = jobs.select(path.alias("path")).withColumn("file", F.concat("path", F.lit("/config.json")))
    return tree.with_job_keys(files, "file").drop("file")


@query(f"""
    WITH v AS {BOX}
    SELECT event_type, q1, median, q3, count(*) FILTER (v < lo OR v > hi) AS n_outliers,
           row_number() OVER (ORDER BY event_type) - 1 AS box_no, min(min(v)) OVER () AS y_data_min, max(max(v)) OVER () AS y_data_max
    FROM j GROUP BY event_type, q1, median, q3""")
def chart_boxes(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_type", "round(value * 100) as value")
    tables = layout.chart_tables(df, {
        "metrics": {"value": {"value_cols": "value"}}, "cum_subplot_config": [{"chart": {"box_foreach": {"cols": ["event_type"]}}}]})
    place = ["fig_idx", "row_idx", "col_idx"]
    axes = tables["axes"].select(*place, "y_data_min", "y_data_max")
    return tables["boxes"].join(axes, place).select("event_type", "q1", "median", "q3", "n_outliers", "box_no", "y_data_min", "y_data_max")
