"""Run tables, defaults, schedules and templates, with levels that come from the tables."""

from pyspark.sql import functions as F

from queries import query, table
from trialframe.functions.text import fill_column, fill_template, rendered
from trialframe.operators import jobs
from trialframe.plans import design
from trialframe.sinks.writers import state_lists

LEVELS = """(SELECT DISTINCT l_returnflag FROM lineitem) f, (SELECT DISTINCT o_orderpriority FROM orders) p,
            (SELECT DISTINCT l_suppkey FROM lineitem) s"""


def product(spark, folder):
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return design.factor_product(spark, {
        "flag": (items.select("l_returnflag").distinct(), "l_returnflag"),
        "priority": (orders.select("o_orderpriority").distinct(), "o_orderpriority"),
        "supplier": (items.select("l_suppkey").distinct(), "l_suppkey"),
    })


@query(f"""
    SELECT l_returnflag, o_orderpriority, l_suppkey,
           row_number() OVER (ORDER BY l_returnflag, o_orderpriority, l_suppkey) - 1 AS run FROM {LEVELS}""")
def factor_cross(spark, folder):
    return product(spark, folder)


@query(f"""
    WITH e AS (SELECT 'R' AS l_returnflag, o_orderpriority, NULL AS l_suppkey FROM orders WHERE o_totalprice > 490000
               UNION SELECT NULL, NULL, s_suppkey FROM supplier WHERE s_acctbal < 0
               UNION SELECT 'A', NULL, s_suppkey FROM supplier WHERE s_nationkey = 3)
    SELECT l_returnflag, o_orderpriority, l_suppkey,
           row_number() OVER (ORDER BY l_returnflag, o_orderpriority, l_suppkey) - 1 AS run
    FROM {LEVELS} WHERE NOT EXISTS (SELECT 1 FROM e
      WHERE coalesce(e.l_returnflag, f.l_returnflag) = f.l_returnflag
        AND coalesce(e.o_orderpriority, p.o_orderpriority) = p.o_orderpriority
        AND coalesce(e.l_suppkey, s.l_suppkey) = s.l_suppkey)""")
def factor_except(spark, folder):
    suppliers = table(spark, folder, "supplier")
    names = ("l_returnflag", "o_orderpriority", "l_suppkey")
    some = table(spark, folder, "orders").filter("o_totalprice > 490000").selectExpr(
        "'R' as l_returnflag", "o_orderpriority", "cast(null as bigint) as l_suppkey")
    poor = suppliers.filter("s_acctbal < 0").selectExpr(
        "cast(null as string) as l_returnflag", "cast(null as string) as o_orderpriority", "s_suppkey as l_suppkey")
    near = suppliers.filter("s_nationkey = 3").selectExpr(
        "'A' as l_returnflag", "cast(null as string) as o_orderpriority", "s_suppkey as l_suppkey")
    entries = some.union(poor).union(near).distinct().select(*names)
    kept = design.exclude_rows(product(spark, folder).drop("run"), entries)
    return design.renumber(kept, list(names))


@query("""
    SELECT p_brand, p_size, l_linestatus, 'base' AS mode, 10 AS retries,
           row_number() OVER (ORDER BY p_brand, p_size, l_linestatus) - 1 AS run
    FROM (SELECT DISTINCT p_brand, p_size FROM part), (SELECT DISTINCT l_linestatus FROM lineitem)
    WHERE NOT (p_brand = 'Brand#1' AND p_size = 7)""")
def level_list(spark, folder):
    pairs = table(spark, folder, "part").select("p_brand", "p_size").distinct()
    status = table(spark, folder, "lineitem").select("l_linestatus").distinct()
    runs = design.factor_product(spark, {"pair": (pairs, ["p_brand", "p_size"]), "status": (status, "l_linestatus")})
    kept = design.exclude(runs, [{"p_brand": "Brand#1", "p_size": 7}])
    numbered = design.renumber(kept.withColumnRenamed("run", "all_runs"), "all_runs").drop("all_runs")
    return numbered.withColumns({"mode": F.lit("base"), "retries": F.lit(10)})


@query("""
    SELECT k, CASE WHEN own THEN value ELSE fallback END AS value FROM
      (SELECT c_custkey AS k, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS value, true AS own FROM customer)
    FULL JOIN (SELECT o_custkey + 100 AS k, max(o_orderpriority) AS fallback FROM orders GROUP BY ALL) USING (k)""")
def defaults_merge(spark, folder):
    own = table(spark, folder, "customer").selectExpr(
        "c_custkey as k", "case when c_acctbal >= 0 then c_mktsegment end as value")
    # other keys than the customers' own, so that some have a default only
    defaults = table(spark, folder, "orders").groupBy((F.col("o_custkey") + 100).alias("k")).agg(
        F.max("o_orderpriority").alias("value"))
    return design.merge_defaults(own, defaults, ["k"])


@query("""
    SELECT 'tpc__h' AS suite, '17' AS suite_id, c_mktsegment AS exp_name, CAST(c_custkey AS VARCHAR) AS exp_run,
           CAST(rep AS VARCHAR) AS exp_run_rep,
           'suite_tpc__h__suite_id_17__exp_name_' || c_mktsegment || '__exp_run_' || c_custkey || '__exp_run_rep_' || rep AS label
    FROM customer, (SELECT unnest(range(3)) AS rep)""")
def job_table(spark, folder):
    runs = table(spark, folder, "customer").selectExpr("c_mktsegment as exp_name", "c_custkey as run")
    labelled = design.job_table(runs, "tpc__h", "17", 3).select(jobs.job_label().alias("label"))
    return labelled.select("label", *[c.alias(n) for n, c in jobs.parse_label(F.col("label")).items()])


@query("""
    SELECT o_orderkey AS exp_run, h AS host, CAST(h % 3 AS INTEGER) AS host_no,
           CASE h % 3 WHEN 0 THEN 'serve ' || o_orderstatus WHEN 1 THEN 'load ' || o_orderpriority
                      ELSE 'runner 2' END AS exp_run_cmd
    FROM orders JOIN (SELECT c_custkey, unnest([c_custkey * 2, c_custkey * 2 + 1]) AS h FROM customer) ON c_custkey = o_custkey""")
def job_schedule(spark, folder):
    main, bg = F.lit("main"), F.lit("monitor")
    commands = F.array(
        F.create_map(main, F.concat(F.lit("serve "), "o_orderstatus")),
        F.create_map(main, F.concat(F.lit("load "), "o_orderpriority")),
        F.create_map(main, F.lit("client"), bg, F.lit("top")))
    runs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("exp_run"), F.col("o_custkey").alias("exp_name"), commands.alias("commands"))
    # two hosts of its own for each experiment, so the output grows with the jobs
    hosts = table(spark, folder, "customer").selectExpr(
        "c_custkey as exp_name", "explode(array(c_custkey * 2, c_custkey * 2 + 1)) as host").withColumn(
        "host_no", (F.col("host") % 3).cast("int"))
    return design.job_schedule(runs, hosts).drop("exp_name")


@query("""
    SELECT o_orderkey, 'run --key ' || o_orderkey || ' --big ' || CASE WHEN o_totalprice > 250000 THEN 'True' ELSE 'False' END
           AS command, 'p=' || o_orderpriority AS note, level
    FROM (SELECT *, unnest(range(10, 25, 5)) AS level FROM orders)""")
def template_fill(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_totalprice > 250000 as big", "o_orderpriority",
        "concat('p=', '[% my_run.priority %]') as note", "explode(sequence(10, 24, 5)) as level")
    values = {"my_run.key": rendered(F.col("o_orderkey"), "bigint"), "my_run.big": rendered(F.col("big"), "boolean"),
              "my_run.priority": rendered(F.col("o_orderpriority"), "string")}
    return df.select("o_orderkey", fill_template("run --key [% my_run.key %] --big [% my_run.big %]", values).alias("command"),
                     fill_column(F.col("note"), values).alias("note"), "level")


@query("""
    SELECT o_orderkey AS run, 'server' AS host_type, i AS host_idx, 'main' AS name, o_orderstatus || i AS command
    FROM orders, (SELECT unnest(range(2)) AS i)
    UNION ALL SELECT o_orderkey, 'client', 0, 'main', o_orderpriority FROM orders
    UNION ALL SELECT o_orderkey, 'client', 0, 'monitor', 'top' FROM orders""")
def command_list(spark, folder):
    main = F.lit("main")
    runs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run"),
        F.array(*[F.create_map(main, F.concat("o_orderstatus", F.lit(str(i)))) for i in range(2)]).alias("$CMD$.server"),
        F.array(F.create_map(main, F.col("o_orderpriority"), F.lit("monitor"), F.lit("top"))).alias("$CMD$.client"))
    return design.command_list(runs, ["server", "client"], ["run"])


@query("""
    SELECT s_nationkey AS exp_name, s_suppkey AS run, '{"balance":' || CAST(round(s_acctbal * 100) AS BIGINT) || ',"name":"'
           || s_name || '"}' AS config FROM supplier""")
def run_config_rows(spark, folder):
    runs = table(spark, folder, "supplier").selectExpr(
        "s_nationkey as exp_name", "s_suppkey as run", "s_name as name", "cast(round(s_acctbal * 100) as bigint) as balance")
    return design.run_configs_json(runs)


@query("""
    SELECT 'tpc/1/' || o_orderpriority || '/' || CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'running'
             ELSE 'pending' END AS list, count(*) AS n_ids, sum(o_orderkey)::BIGINT AS id_sum
    FROM orders GROUP BY ALL""")
def state_snapshot(spark, folder):
    states = table(spark, folder, "orders").selectExpr(
        "'tpc' as suite", "'1' as suite_id", "o_orderpriority as exp_name", "o_orderkey as exp_run", "0 as exp_run_rep",
        "case o_orderstatus when 'F' then 'finished' when 'O' then 'running' else 'pending' end as state")
    pages = state_lists(states, 500)
    ids = pages.select("list", F.explode("items").alias("id"))
    return ids.groupBy("list").agg(F.count(F.lit(1)).alias("n_ids"), F.sum("id.exp_run").alias("id_sum"))
