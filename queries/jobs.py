"""Job progress, queue snapshots, catalog selections and agreement checks."""

from pyspark.sql import functions as F

from queries import query, table
from trialframe.operators import jobs

STATE = "case o_orderstatus when 'F' then 'finished' when 'O' then 'running' else 'pending' end"


def states(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_custkey as suite", "year(o_orderdate) as suite_id", "o_orderpriority as exp_name", "o_orderkey as exp_run",
        f"{STATE} as state")


EXPERIMENTS = """(SELECT o_custkey AS suite, year(o_orderdate) AS suite_id, o_orderpriority AS exp_name, count(*) AS n_jobs,
                    count(*) FILTER (o_orderstatus <> 'F') AS n_jobs_unfinished,
                    count(*) FILTER (o_orderstatus = 'F') AS n_jobs_finished,
                    bool_and(o_orderstatus = 'F') AS is_complete FROM orders GROUP BY ALL)"""


@query(f"SELECT * FROM {EXPERIMENTS}")
def job_progress(spark, folder):
    return jobs.progress(states(spark, folder))


@query("""
    SELECT o_custkey AS suite, year(o_orderdate) AS suite_id,
           count(*) FILTER (o_orderpriority <> '1-URGENT') > 0
             AND bool_and(o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AS is_complete
    FROM orders GROUP BY ALL""")
def suite_completeness(spark, folder):
    every = states(spark, folder)
    known = jobs.progress(every.filter("exp_name <> '1-URGENT'"))
    return jobs.suite_complete(every.select("suite", "suite_id").distinct(), known)


@query("""
    SELECT c_custkey AS label, min(CASE WHEN o_orderstatus IS NULL OR o_orderstatus = 'F' THEN 'complete'
             WHEN o_orderstatus = 'O' THEN 'incomplete' ELSE 'error' END) AS status
    FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus
                             FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL) ON o_custkey = c_custkey
    GROUP BY ALL""")
def job_status_classify(spark, folder):
    changes = table(spark, folder, "orders").filter("o_orderpriority <> '1-URGENT'").selectExpr(
        "o_custkey as label", "o_orderdate", "o_orderkey",
        "case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'RUNNING' else 'FAILED' end as job_state")
    queue = jobs.latest_state(changes, ["label"], ["o_orderdate", "o_orderkey"], ["job_state"])
    known = table(spark, folder, "customer").selectExpr("c_custkey as label")
    return jobs.classify(known, queue).select("label", "status")


@query("""
    SELECT c_custkey AS label, 'gone' AS kind FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
    UNION ALL SELECT c_custkey, 'finished' FROM customer WHERE c_acctbal > 0
      AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT DISTINCT o_custkey, 'unknown' FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def queue_snapshots(spark, folder):
    customers = table(spark, folder, "customer")
    orders = table(spark, folder, "orders").selectExpr(
        "o_custkey as label", "case o_orderstatus when 'F' then 'finished' else o_orderstatus end as state")
    every, rich = customers.selectExpr("c_custkey as label"), customers.filter("c_acctbal > 0").selectExpr("c_custkey as label")
    parts = {"gone": jobs.no_longer_listed(every, orders.filter("state = 'O'")),
             "finished": jobs.finished_known(rich, orders),
             "unknown": jobs.unknown_tasks(rich, orders).select("label").distinct()}
    tagged = [df.select("label", F.lit(kind).alias("kind")) for kind, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("""
    SELECT 'last' AS kind, o_custkey AS suite, max(o_orderkey) AS id FROM orders GROUP BY ALL
    UNION ALL SELECT 'overall', arg_max(o_custkey, o_orderkey), max(o_orderkey) FROM orders
    UNION ALL SELECT 'old', o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'
      QUALIFY o_orderkey < max(o_orderkey) OVER (PARTITION BY o_custkey)""")
def latest_id(spark, folder):
    runs = table(spark, folder, "orders").selectExpr(
        "o_custkey as suite", "cast(o_orderkey as string) as suite_id", "o_orderstatus = 'F' as is_complete")
    noise = runs.select("suite", F.lit("$expected").alias("suite_id"), F.lit(True).alias("is_complete")).distinct()
    runs = runs.unionByName(noise)
    last = jobs.latest_ids(runs).selectExpr("'last' as kind", "suite", "last_id as id")
    overall = jobs.latest_suite(runs).selectExpr("'overall' as kind", "suite", "last_id as id")
    old = jobs.removable(runs).selectExpr("'old' as kind", "suite", "cast(suite_id as bigint) as id")
    return last.unionByName(overall).unionByName(old)


@query("""
    WITH l AS (SELECT o_orderkey AS id, o_orderkey % 50 <> 0 AS a, o_orderstatus <> 'F' AND o_orderkey % 70 <> 0 AS u,
                      o_orderstatus = 'F' AS f, o_orderstatus <> 'F' AS active,
                      o_orderstatus = 'P' AND o_orderkey % 90 = 0 AS twice FROM orders)
    SELECT id, 'all' AS rule FROM l WHERE a <> (u OR f)
    UNION ALL SELECT id, 'unfinished' FROM l WHERE u <> active
    UNION ALL SELECT id, 'disjoint' FROM l WHERE twice""")
def state_invariants(spark, folder):
    lists = F.array_compact(F.array(*[F.expr(f"case when {test} then '{name}' end") for name, test in (
        ("all", "o_orderkey % 50 <> 0"),
        ("unfinished", "o_orderstatus <> 'F' and o_orderkey % 70 <> 0"),
        ("finished", "o_orderstatus = 'F'"),
        ("running", "o_orderstatus = 'O'"),
        ("pending", "o_orderstatus = 'P'"),
        ("queued", "o_orderstatus = 'P' and o_orderkey % 90 = 0"),
    )]))
    listed = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.explode(lists).alias("state"))
    return jobs.state_violations(listed, ["id"])


@query("""
    SELECT o_custkey AS suite, o_orderpriority AS exp_name, count(*) AS n_runs,
           o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS has_etl
    FROM orders GROUP BY ALL""")
def run_counts(spark, folder):
    runs = table(spark, folder, "orders").selectExpr("o_custkey as suite", "o_orderpriority as exp_name")
    flows = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as suite", "1 as flow")
    return jobs.run_counts(runs, flows)


@query("""
    SELECT l_suppkey, CAST((n - 1) // 200 AS BIGINT) AS page, count(*) AS n_items,
           string_agg(l_orderkey || ':' || l_linenumber || ':' || l_partkey, ',' ORDER BY n) AS items
    FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
                                       l_extendedprice) AS n FROM lineitem) GROUP BY ALL""")
def collect_by_host(spark, folder):
    df = table(spark, folder, "lineitem")
    pages = jobs.collected(df, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"],
                           ["l_orderkey", "l_linenumber", "l_partkey"], page=200)
    text = F.transform("items", lambda i: F.concat_ws(":", i["l_orderkey"], i["l_linenumber"], i["l_partkey"]))
    return pages.select("l_suppkey", "page", "n_items", F.array_join(text, ",").alias("items"))


@query("""
    WITH s AS (SELECT DISTINCT p_type, l_suppkey, l_returnflag || l_linenumber AS label
               FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT p_type, label, n_with, n_hosts FROM (SELECT p_type, label, count(*) AS n_with FROM s GROUP BY ALL)
    JOIN (SELECT p_type, count(DISTINCT l_suppkey) AS n_hosts FROM s GROUP BY ALL) USING (p_type) WHERE n_with < n_hosts""")
def host_agreement(spark, folder):
    parts = table(spark, folder, "part").selectExpr("p_partkey as l_partkey", "p_type")
    seen = table(spark, folder, "lineitem").join(parts, "l_partkey").selectExpr(
        "p_type", "l_suppkey", "concat(l_returnflag, l_linenumber) as label")
    return jobs.disagreements(seen, "l_suppkey", "label", ["p_type"])


@query("""
    SELECT o_custkey, min(o_orderstatus) AS o_orderstatus, count(DISTINCT o_orderstatus) = 1 AS agrees
    FROM orders GROUP BY ALL""")
def runtime_agreement(spark, folder):
    return jobs.agreed_value(table(spark, folder, "orders"), ["o_custkey"], "o_orderstatus")


@query("""
    SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, folder):
    return jobs.duplicate_keys(table(spark, folder, "lineitem"), "l_orderkey")


@query("""
    SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'
      AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def pending_difference(spark, folder):
    orders = table(spark, folder, "orders").selectExpr("o_custkey as id", "o_orderstatus")
    pending = orders.filter("o_orderstatus = 'P'").select("id").distinct()
    return jobs.difference(pending, orders.filter("o_orderstatus = 'O'"), ["id"])


@query("""
    SELECT o_custkey AS job, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY ALL""")
def newest_state(spark, folder):
    changes = table(spark, folder, "orders").selectExpr("o_custkey as job", "o_orderstatus as state", "o_orderdate", "o_orderkey")
    return jobs.latest_state(changes, ["job"], ["o_orderdate", "o_orderkey"], ["state"])
