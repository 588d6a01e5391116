"""Result trees, their configurations and catalogs, and streams over files.

Documents are derived from the tables by Spark: every order, event or customer becomes a result file, either as a
``(path, content)`` row or written out below the shared folder.
"""

from pyspark.sql import functions as F

from queries import query, table
from trialframe.functions.flatten import flatten_variant
from trialframe.session import new_shared_path
from trialframe.sources import catalog, formats, results, tree
from trialframe.streaming import incremental, views

JOB = "concat('file:/r/my_suite_17/', o_orderpriority, '/run_', o_custkey, '/rep_', o_orderkey, '/'"


def orders(spark, folder):
    return table(spark, folder, "orders").selectExpr("*", "cast(round(o_totalprice * 100) as bigint) as price")


@query("""
    SELECT 'my_suite' AS suite_name, '17' AS suite_id, o_orderpriority AS exp_name, o_custkey AS run, o_orderkey AS rep,
           'small' AS host_type, o_orderkey % 3 AS host_idx, 'out.json' AS source_file, o_orderkey % 2 + n AS record_no,
           CAST(round(o_totalprice * 100) AS BIGINT) + n AS price, o_orderstatus AS "info.status",
           CASE WHEN n = 1 THEN 'x' END AS "info.extra"
    FROM orders, (SELECT unnest(range(2)) AS n) WHERE n <= 1 - o_orderkey % 2""")
def tree_json(spark, folder):
    # an even key gives a list of two records, an odd key a null element and an object
    docs = orders(spark, folder).selectExpr(
        f"{JOB}, 'small/host_', o_orderkey % 3, '/out.json') as path",
        """case when o_orderkey % 2 = 1 then concat('[null, {"price": ', price, ', "info": {"status": "', o_orderstatus, '"}}]')
           else concat('[{"price": ', price, ', "info": {"status": "', o_orderstatus, '"}}, {"price": ', price + 1,
                       ', "info": {"extra": "x", "status": "', o_orderstatus, '"}}]') end as content""")
    records = formats.drop_empty(formats.json_records(tree.with_file_keys(docs)))
    return flatten_variant(records.drop("path"), "record")


@query("""
    SELECT conv_id AS run, turn AS rep, host_idx, role, n_words, flag, "load.mean", "load.unit" FROM (
      SELECT conv_id, turn, 0 AS host_idx, role, len(string_split(text, ' ')) AS n_words, turn % 2 = 0 AS flag,
             CAST(turn * 0.5 AS DOUBLE) AS "load.mean", 'ms' AS "load.unit" FROM conversations)""")
def tree_yaml(spark, folder):
    docs = table(spark, folder, "conversations").selectExpr(
        "concat('file:/r/chat_1/talk/run_', conv_id, '/rep_', turn, '/client/host_0/stats.yaml') as path",
        """concat('role: ', role, '\\nn_words: ', size(split(text, ' ', -1)), '\\nflag: ', turn % 2 = 0,
                  '\\nload: {mean: ', turn * 0.5D, ', unit: ms}\\n') as content""")
    keyed = tree.with_file_keys(docs).select("run", "rep", "host_idx", "content")
    return flatten_variant(formats.yaml_records(keyed).drop("record_no"), "record")


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, NULL AS s_name FROM customer
    UNION ALL SELECT NULL, NULL, NULL, s_name FROM supplier""")
def tree_csv(spark, folder):
    target = new_shared_path(spark, "csv")
    table(spark, folder, "customer").selectExpr("cast(c_custkey as string) as c_custkey", "c_name", "c_mktsegment").write.csv(
        f"{target}/customers", header=True, sep=";")
    table(spark, folder, "supplier").selectExpr("s_name").write.csv(f"{target}/suppliers", header=True, sep=";")
    rows = formats.csv_records(spark, [f"{target}/customers", f"{target}/suppliers"], formats.CsvFiles(delimiter=";"))
    return flatten_variant(rows.drop("path"), "record").select("c_custkey", "c_name", "c_mktsegment", "s_name")


@query("""
    SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_name AS name FROM part""")
def tree_csv_named(spark, folder):
    target = new_shared_path(spark, "csv")
    table(spark, folder, "part").selectExpr("p_partkey", "p_size", "p_name").write.csv(target, sep="|")
    spec = formats.CsvFiles(delimiter="|", has_header=False, fieldnames=["key", "size", "name"])
    rows = flatten_variant(formats.csv_records(spark, [target], spec).drop("path"), "record")
    return rows.select(F.col("key").cast("bigint").alias("p_partkey"), "size", "name")


@query("""
    SELECT CAST(p_partkey AS VARCHAR) AS key, p_name || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'second line' ELSE '' END AS name,
           CASE WHEN p_partkey % 2 = 0 THEN '["' || p_size || '"]' END AS extra
    FROM part""")
def tree_csv_ragged(spark, folder):
    """Rows with more values than names, and quoted line breaks."""
    target = new_shared_path(spark, "csv")
    name = F.concat(F.lit('"'), "p_name", F.when(F.col("p_partkey") % 3 == 0, "\nsecond line").otherwise(""), F.lit('"'))
    rest = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(","), F.col("p_size").cast("string"))).otherwise("")
    rows = table(spark, folder, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(","), name, rest).alias("value"))
    rows.write.text(target)
    found = formats.csv_records(spark, [target], formats.CsvFiles(file_regex=r".*\.txt$", fieldnames=["key", "name"]))
    return flatten_variant(found.drop("path"), "record").select("key", "name", F.col("_extra").alias("extra"))


@query("""
    SELECT o_orderkey AS rep, kind, n FROM (
      SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'ignored' WHEN 2 THEN 'errors' WHEN 3 THEN 'json'
               END AS kind, CASE o_orderkey % 5 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS n FROM orders)""")
def file_coverage(spark, folder):
    names = "array('out.json', 'stdout.log', 'stderr.log', 'out.json.yml', 'core.bin')"
    files = orders(spark, folder).selectExpr(f"{JOB}, 'small/host_0/', element_at({names}, cast(o_orderkey % 5 + 1 as int))) as path")
    spec = {"json": formats.JsonFiles(r"out\.json"), "yaml": formats.YamlFiles(), "errors": formats.ErrorFiles(),
            "ignored": formats.IgnoredFiles()}
    found = formats.coverage(tree.with_file_keys(files), spec)
    return found.selectExpr("rep", "extractor as kind", "cast(n_extractors as bigint) as n")


@query("""
    SELECT o_orderkey AS rep, 'oops ' || o_orderpriority || ' second' AS message FROM orders WHERE o_orderstatus = 'F'""")
def error_files(spark, folder):
    docs = orders(spark, folder).selectExpr(
        f"{JOB}, 'small/host_0/stderr.log') as path",
        "case o_orderstatus when 'F' then concat('oops ', o_orderpriority, '\\nsecond\\n') when 'O' then ' \\n' else '' end as content")
    return formats.error_report(tree.with_file_keys(docs)).select("rep", "message")


@query("""
    SELECT l_orderkey AS rep, o_custkey AS run, l_linenumber AS line, l_quantity AS q, o_orderstatus AS status,
           o_orderpriority AS "set.prio", CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE l_suppkey END AS size
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority <> '5-LOW'""")
def config_join(spark, folder):
    configs = orders(spark, folder).filter("o_orderpriority <> '5-LOW'").selectExpr(
        "concat('file:/r/s_1/e/run_', o_custkey, '/rep_', o_orderkey, '/config.json') as path",
        """concat('{"status": "', o_orderstatus, '", "set": {"prio": "', o_orderpriority, '"}, "size": 1, "$FACTOR_LEVEL": {"a": 1}}')
           as content""")
    keys = table(spark, folder, "orders").selectExpr("o_orderkey as rep", "o_custkey as run")
    items = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as rep", "l_linenumber as line", "l_quantity as q",
        """case when l_orderkey % 2 = 0 then parse_json('{}') else parse_json(concat('{"size": ', l_suppkey, '}')) end as record""")
    records = items.join(keys, "rep").selectExpr("'s' as suite_name", "'1' as suite_id", "'e' as exp_name",
                                                 "cast(run as int) as run", "cast(rep as int) as rep", "line", "q", "record")
    merged = results.records_with_configs(records, results.run_configs(configs))
    return merged.select("rep", "run", "line", "q", "status", F.col("`set.prio`"), "size")


@query("""
    SELECT 'suite' || c_nationkey AS suite_name, CAST(c_custkey AS VARCHAR) AS suite_id, 'first' AS exp_name,
           'size,opt.' || lower(c_mktsegment) AS factors FROM customer
    UNION ALL SELECT 'suite' || c_nationkey, CAST(c_custkey AS VARCHAR), 'second', 'n' FROM customer WHERE c_acctbal > 0""")
def design_factors(spark, folder):
    docs = table(spark, folder, "customer").selectExpr(
        "concat('suite', c_nationkey) as suite_name", "cast(c_custkey as string) as suite_id",
        """concat('first:\\n  base_experiment:\\n    size: {$FACTOR$: [1, 2]}\\n    out: json\\n    opt: {', lower(c_mktsegment),
                  ': $FACTOR$, fixed: 3}\\n', case when c_acctbal > 0 then 'second: {base_experiment: {n: $FACTOR$}}\\n' else '' end,
                  '$ETL$: {}\\n') as content""")
    return catalog.design_factors(docs).select("suite_name", "suite_id", "exp_name",
                                               F.array_join("factor_columns", ",").alias("factors"))


@query("""
    SELECT 'big_' || c_mktsegment AS suite, CASE WHEN c_custkey % 9 = 0 THEN '$expected' ELSE CAST(c_nationkey AS VARCHAR) END
             AS suite_id, c_custkey % 9 <> 0 AS id_is_number, bool_or(c_acctbal < -900) AS etl_failed
    FROM customer GROUP BY ALL""")
def result_catalog(spark, folder):
    files = table(spark, folder, "customer").selectExpr(
        """concat('file:/r/big_', c_mktsegment, '_', case when c_custkey % 9 = 0 then '$expected' else cast(c_nationkey as string) end)
           as folder""", "c_acctbal")
    runs = catalog.suite_runs(files.selectExpr("concat(folder, '/suite_design.yml') as path"), r"suite_design\.yml")
    markers = files.filter("c_acctbal < -900").selectExpr("concat(folder, '/ETL_ERROR.log') as path")
    return catalog.mark_failed(runs, markers).drop("folder")


@query("""
    SELECT 's' || c_nationkey AS suite, CAST(c_custkey AS VARCHAR) AS suite_id, e AS exp_name FROM customer,
      (SELECT unnest(['one', 'two', 'lost']) AS e) WHERE e = 'one' OR (e = 'two' AND c_custkey % 2 = 0)""")
def known_experiments(spark, folder):
    runs = table(spark, folder, "customer").selectExpr("concat('s', c_nationkey) as suite", "cast(c_custkey as string) as suite_id", "c_custkey")
    docs = runs.selectExpr("suite", "suite_id", "concat('one: {}\\n', case when c_custkey % 2 = 0 then 'two: {}\\n' else '' end, '$ETL$: {}\\n') as content")
    folders = runs.select("suite", "suite_id", F.explode(F.array(*[F.lit(x) for x in ("one", "two", "lost")])).alias("exp_name"))
    return catalog.result_experiments(folders, catalog.design_experiments(docs))


@query("""
    SELECT 'all' AS state, c_mktsegment AS exp_name, c_custkey AS exp_run, c_nationkey AS exp_run_rep FROM customer
    UNION ALL SELECT CASE WHEN c_acctbal > 0 THEN 'finished' ELSE 'unfinished' END, c_mktsegment, c_custkey, c_nationkey FROM customer
    UNION ALL SELECT 'queued', c_mktsegment, c_custkey, c_nationkey FROM customer WHERE c_acctbal <= 0""")
def job_state_files(spark, folder):
    entry = """concat("[{'suite': 's', 'suite_id': '1', 'exp_name': '", c_mktsegment, "', 'exp_run': ", c_custkey, ", 'exp_run_rep': ", c_nationkey, "}]")"""
    docs = table(spark, folder, "customer").selectExpr(
        f"""concat('---\\nexp_job_ids: ', {entry}, '\\nexp_job_ids_unfinished: ', if(c_acctbal > 0, '[]', {entry}),
                   ' # not done\\nexp_job_ids_pending: []\\nexp_job_ids_queued: ', if(c_acctbal > 0, '[]', {entry}),
                   '\\nexp_job_ids_running: []\\nexp_job_ids_finished: ', if(c_acctbal > 0, {entry}, '[]'), '\\n') as content""")
    return catalog.job_states(docs).select("state", "exp_name", "exp_run", "exp_run_rep")


# ---------------------------------------------------------------- streams

@query("""
    SELECT event_type, count(v) AS v_count, avg(v) AS v_mean, max(v) AS v_max
    FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL""")
def events_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    events = incremental.file_stream(spark, folder, schema, "events.parquet").selectExpr(
        "event_type", "cast(round(value * 100) as bigint) as v")
    return incremental.run_available(incremental.aggregate_stream(events, ["event_type"], ["v"], ["count", "mean", "max"]))


@query("""
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS event_id_count
    FROM events GROUP BY ALL""")
def windowed_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    events = incremental.file_stream(spark, folder, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.run_available(
        incremental.windowed(events, "ts", "1 hour", ["event_type"], ["event_id"], ["count"]))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "event_id_count")


@query("""
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY ALL""")
def life_cycle_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    events = incremental.file_stream(spark, folder, schema, "events.parquet")
    return incremental.run_available(incremental.latest_states(events, ["user_id"], ["ts", "event_id"], "event_type")
                                     .withColumnRenamed("event_type", "state"))


@query("""
    WITH RECURSIVE e AS (
      SELECT user_id, epoch_us(ts) AS us, event_type AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
      FROM events WHERE ts IS NOT NULL),
    r AS (
      SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS us, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS before,
             false AS ok, CAST(NULL AS VARCHAR) AS cur, CAST(NULL AS BIGINT) AS since,
             CAST(NULL AS BIGINT) AS gone_at, CAST(NULL AS VARCHAR) AS gone
      FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT user_id, n, us, s, eff, ok, CASE WHEN ok THEN s ELSE eff END, CASE WHEN ok THEN us ELSE since END, gone_at, gone
      FROM (SELECT *, coalesce((eff IS NULL AND s = 'signup') OR (eff = 'signup' AND s IN ('view', 'click')) OR (eff = 'view' AND s = 'click')
                   OR (eff = 'click' AND s IN ('view', 'purchase')), false) AS ok
            FROM (SELECT e.user_id, e.n, e.us, e.s, r.since, CASE WHEN e.us > r.since + 172800000000 THEN NULL ELSE r.cur END AS eff,
                         CASE WHEN r.cur IS NOT NULL AND e.us > r.since + 172800000000 THEN r.since + 172800000000 END AS gone_at,
                         CASE WHEN e.us > r.since + 172800000000 THEN r.cur END AS gone
                  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))),
    steps AS (
      SELECT user_id, us, before, s AS state, CASE WHEN ok THEN 'moved' ELSE 'refused' END AS kind FROM r WHERE n > 0
      UNION ALL SELECT user_id, gone_at, gone, NULL, 'expired' FROM r WHERE gone_at IS NOT NULL
      UNION ALL
      SELECT user_id, since + 172800000000, cur, NULL, 'expired' FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
      WHERE cur IS NOT NULL AND (since + 172800000000) // 1000 < (SELECT max(us) // 1000 FROM e))
    SELECT user_id, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS "at", before, state, kind FROM steps""")
def life_cycle_machine_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    events = incremental.file_stream(spark, folder, schema, "events.parquet")
    moves = {None: ["signup"], "signup": ["view", "click"], "view": ["click"], "click": ["view", "purchase"]}
    steps = incremental.life_cycles(events, ["user_id"], "ts", moves, "2 days", order=["event_id"], state="event_type")
    out = incremental.run_available(steps, "append")
    return out.select("user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "before", "state", "kind")


@query("""
    SELECT event_type, user_id % 5 AS slot, count(v) AS v_count, avg(v) AS v_mean,
           CAST(min(v) AS DOUBLE) AS v_min, CAST(max(v) AS DOUBLE) AS v_max, round(stddev_samp(v), 6) AS v_std
    FROM (SELECT event_type, user_id, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL""")
def results_incremental(spark, folder):
    events = table(spark, folder, "events").selectExpr(
        "event_type", "user_id % 5 as slot", "cast(round(value * 100) as bigint) as v", "event_id % 12 as part")
    target, state = new_shared_path(spark, "results"), new_shared_path(spark, "view")
    functions = ["count", "mean", "min", "max", "std"]

    def update(rows):
        # files of the parts that are written again go, with all that they said
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)
        schema = rows.drop("part").schema
        return views.refresh(spark, target, state, views.parquet_rows(spark, schema), schema, ["event_type", "slot"], ["v"], functions, "*.parquet")

    # wrong values and groups in the first parts, then the last parts, then the first ones as they should be
    update(events.where("part < 8").selectExpr("if(part < 2, 'wrong', event_type) as event_type", "slot", "if(part < 3, v * 1000 - 7, v) as v", "part"))
    update(events.where("part >= 8"))
    return update(events.where("part < 3")).withColumn("v_std", F.round("v_std", 6))
