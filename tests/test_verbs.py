import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators import aggregate as agg
from trialframe.operators import transforms as tf
from trialframe.operators import verbs


@pytest.fixture
def df(spark):
    data = [(1, "a", 2.5, None), (2, "b", -3.5, "x"), (3, "a", None, "y"), (4, None, 0.5, "x"), (5, "b", 1.5, "x")]
    return spark.createDataFrame(data, "id bigint, k string, v double, s string")


def values(df, *names):
    return [tuple(r) for r in df.orderBy("id").select(*names or df.columns).collect()]


def test_column_verbs(df):
    out = verbs.chain(df, [{"df.add_suffix": {"suffix": "_x"}}, {"df.rename": {"columns": {"id_x": "id"}}},
                           {"df.drop": {"columns": ["s_x"]}}, {"df.reindex": {"columns": ["v_x", "id", "new"]}}])
    assert out.columns == ["v_x", "id", "new"]
    assert verbs.call(df, "select_dtypes", {"include": "number"}).columns == ["id", "v"]
    assert verbs.call(df, "select_dtypes", {"exclude": ["object"]}).columns == ["id", "v"]
    assert verbs.call(df, "pop", {"item": "k"}).columns == ["k"]
    assert dict(verbs.call(df, "astype", {"dtype": {"id": "str"}}).dtypes)["id"] == "string"
    assert verbs.call(df, "filter", {"like": "i"}).columns == ["id"]
    with pytest.raises(ValueError):
        verbs.call(df, "drop", {"columns": "nope"})
    with pytest.raises(ValueError):
        verbs.call(df, "no_such_verb")


def test_round_half_even_and_clip(df):
    assert values(verbs.call(df, "round", {"decimals": 0}), "v") == [(2.0,), (-4.0,), (None,), (0.0,), (2.0,)]
    assert values(verbs.call(df, "clip", {"lower": -1, "upper": 1, "columns": "v"}), "v") == [
        (1.0,), (-1.0,), (None,), (0.5,), (1.0,)]
    assert values(verbs.call(df, "abs", {"columns": "v"}), "v")[1] == (3.5,)


def test_arithmetic_matches_pandas(spark):
    p = pd.DataFrame({"id": range(6), "v": [7.0, -7.0, 0.0, 2.5, -2.5, 9.0]})
    df = spark.createDataFrame(p)
    for name, other in [("add", 2), ("rsub", 1), ("mul", 3), ("div", 2), ("floordiv", 2), ("mod", 3), ("pow", 2),
                        ("radd", 4), ("rdiv", 1), ("subtract", 5)]:
        if name == "rdiv":
            sel = df.filter("v <> 0")
            want = 1 / p.loc[p.v != 0, "v"]
        else:
            sel, want = df, getattr(p["v"], name)(other)
        got = [r["v"] for r in verbs.call(sel, name, {"other": other, "columns": "v"}).orderBy("id").collect()]
        np.testing.assert_allclose(got, want)
    assert [r["v"] for r in verbs.call(df, "lt", {"other": 1, "columns": "v"}).orderBy("id").collect()] == (p["v"] < 1).tolist()


def test_missing_values(df):
    assert values(verbs.call(df, "fillna", {"value": 0}), "v", "k")[2] == (0.0, "a")
    assert values(verbs.call(df, "fillna", {"value": {"k": "?"}}), "k")[3] == ("?",)
    assert len(values(verbs.call(df, "dropna"))) == 2
    assert len(values(verbs.call(df, "dropna", {"how": "all", "subset": ["k", "v"]}))) == 5
    assert verbs.call(df, "isna").filter("s").count() == 1
    assert verbs.call(df, "notnull").filter("v").count() == 4


def test_replace(df):
    assert values(verbs.call(df, "replace", {"to_replace": {"a": "A"}}), "k")[0] == ("A",)
    assert values(verbs.call(df, "replace", {"to_replace": {"v": {2.5: 9.0}}}), "v")[0] == (9.0,)
    assert values(verbs.call(df, "replace", {"to_replace": ["x", "y"], "value": "z"}), "s")[1:3] == [("z",), ("z",)]


def test_duplicates(df):
    first = verbs.call(df, "drop_duplicates", {"subset": "k", "order_by": "id"})
    assert [r["id"] for r in first.orderBy("id").collect()] == [1, 2, 4]
    last = verbs.call(df, "drop_duplicates", {"subset": "k", "keep": "last", "order_by": "id"})
    assert [r["id"] for r in last.orderBy("id").collect()] == [3, 4, 5]
    none = verbs.call(df, "drop_duplicates", {"subset": "k", "keep": False})
    assert [r["id"] for r in none.collect()] == [4]
    marks = verbs.call(df, "duplicated", {"subset": "k", "keep": "last", "order_by": "id"})
    assert values(marks, "duplicated") == [(True,), (True,), (False,), (False,), (False,)]


def test_limits(df):
    assert [r["id"] for r in verbs.call(df, "head", {"n": 2, "order_by": "-id"}).collect()] == [5, 4]
    assert {r["id"] for r in verbs.call(df, "tail", {"n": 2, "order_by": "id"}).collect()} == {4, 5}
    assert [r["id"] for r in verbs.call(df, "nsmallest", {"n": 1, "columns": "v"}).collect()] == [2]
    assert {r["id"] for r in verbs.call(df, "take", {"indices": [0, -1], "order_by": "id"}).collect()} == {1, 5}
    assert verbs.call(df, "truncate", {"on": "id", "before": 2, "after": 4}).count() == 3
    one = verbs.call(df, "sample", {"n": 3, "random_state": 1}).collect()
    assert len(one) == 3 and sorted(one) == sorted(verbs.call(df.repartition(5), "sample", {"n": 3, "random_state": 1}).collect())
    grouped = verbs.chain(df, [{"df.groupby": {"by": "k"}}, {"df.head": {"n": 1, "order_by": "id"}}])
    assert {r["id"] for r in grouped.collect()} == {1, 2}


def test_reshape(spark):
    wide = spark.createDataFrame([(1, 2.0, 3), (2, None, 5)], "id bigint, a double, b bigint")
    assert verbs.call(wide, "melt", {"id_vars": "id"}).count() == 4
    assert verbs.call(wide, "stack", {"id_vars": "id"}).count() == 3
    long = verbs.call(wide, "melt", {"id_vars": "id"})
    back = verbs.call(long, "pivot", {"index": "id", "columns": "variable", "values": "value"})
    assert sorted(tuple(r) for r in back.select("id", "b").collect()) == [(1, 3.0), (2, 5.0)]
    with pytest.raises(Exception, match="several values"):
        verbs.call(long.union(long), "pivot", {"index": "id", "columns": "variable", "values": "value"}).collect()
    lists = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "id bigint, w array<string>")
    assert sorted(tuple(r) for r in verbs.call(lists, "explode", {"column": "w"}).collect()[:2]) == [(1, "x"), (1, "y")]
    assert verbs.call(lists, "explode", {"column": "w"}).filter("w is null").count() == 1


def test_summaries_match_pandas(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"x": rng.normal(size=50), "y": rng.integers(0, 9, 50)})
    df = spark.createDataFrame(p)
    d = {r["statistic"]: r for r in agg.describe(df).collect()}
    for s, row in p.describe().iterrows():
        assert d[s]["x"] == pytest.approx(row["x"]) and d[s]["y"] == pytest.approx(row["y"])
    for f in ("sum", "mean", "median", "var", "sem", "skew", "kurt", "prod", "nunique"):
        got = verbs.call(df, f).first()
        assert got["x"] == pytest.approx(getattr(p, f)()["x"]), f
    c = {r["column"]: r["x"] for r in agg.corr(df).collect()}
    assert c["y"] == pytest.approx(p.corr().loc["y", "x"])
    assert {r["y"] for r in agg.mode(df, "y").collect()} == set(p["y"].mode())
    shares = agg.value_counts(df, ["y"], normalize=True).toPandas()
    assert shares["proportion"].sum() == pytest.approx(1)
    q = verbs.call(df, "quantile", {"q": [0.1, 0.5]}).toPandas().set_index("quantile")
    np.testing.assert_allclose(q.loc[0.1, "x"], p["x"].quantile(0.1))


def test_skew_of_few_or_equal_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 3.0), ("b", 3.0), ("b", 3.0)], "g string, v double")
    got = {r["g"]: (r["v_skew"], r["v_kurt"], r["v_std"]) for r in
           agg.aggregate(df, ["g"], ["v"], ["skew", "kurt", "std"]).collect()}
    assert got == {"a": (None, None, pytest.approx(0.7071, abs=1e-4)), "b": (0.0, 0.0, 0.0)}


def test_time_verbs(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id * 50,0) as ts, id as v from range(6)")
    got = verbs.chain(df, [{"df.resample": {"rule": "1h", "on": "ts"}}, {"df.sum": {}}]).orderBy("ts").collect()
    p = df.toPandas().set_index("ts").resample("1h").sum()["v"].tolist()
    assert [r["v"] for r in got] == p
    gap = df.filter("v in (0, 5)")
    means = verbs.chain(gap, [{"df.resample": {"rule": "1h", "on": "ts"}}, {"df.mean": {}}]).orderBy("ts").collect()
    assert [r["v"] for r in means] == [0.0, None, None, None, 5.0]
    assert verbs.call(df, "between_time", {"start_time": "1:00", "end_time": "2:40", "on": "ts"}).count() == 3
    assert verbs.call(df, "between_time", {"start_time": "4:00", "end_time": "0:30", "on": "ts"}).count() == 2
    assert verbs.call(df, "at_time", {"time": "01:00", "on": "ts"}).count() == 1
    ticks = verbs.call(df, "asfreq", {"freq": "1h", "on": "ts"})
    assert ticks.count() == 5 and ticks.filter("v is not null").count() == 1
    with pytest.raises(ValueError):
        verbs.rule_micros("3 parsecs")


def test_group_options(df):
    kept = verbs.chain(df, [{"df.groupby": {"by": "k", "dropna": False}}, {"df.agg": {"func": {"v": ["sum", "count"]}}}])
    assert {tuple(r) for r in kept.collect()} == {("a", 2.5, 1), ("b", -2.0, 2), (None, 0.5, 1)}
    dropped = verbs.chain(df, [{"df.groupby": {"by": "k", "sort": True}}, {"df.first": {"columns": "v", "order_by": "id"}}])
    assert [tuple(r) for r in dropped.collect()] == [("a", 2.5), ("b", -3.5)]
    top = verbs.call(df, "idxmax", {"by": "v", "keys": "k", "order_by": ["id"]})
    assert {(r["k"], r["id"]) for r in top.collect()} == {("a", 1), ("b", 5), (None, 4)}


def test_conditional_rules_run_in_sequence(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None)], "id int, x string")
    same = tf.conditional_replace(df, "x", "x", {"A": "B", "B": "C"})
    assert values(same, "x") == [("C",), ("C",), ("C",), (None,)]
    new = tf.conditional_replace(df, "x", "code", {"A": "1"})
    assert values(new, "code") == [("1",), (None,), (None,), (None,)]


def test_filter_guard(df):
    with pytest.raises(ValueError, match="no rows"):
        tf.filter_equal(df, {"k": "zzz"})
    assert tf.filter_equal(df, {"k": "zzz"}, allow_empty_result=True).count() == 0
    with pytest.raises(ValueError):
        tf.filter_equal(df, {"absent": 1})


def test_rep_aggregate_keys(spark):
    data = [("s", 1, 0, "1.5", [1]), ("s", 1, 1, "2.5", [1]), (None, 2, 0, "4", None), ("t", None, 0, "9", [2])]
    df = spark.createDataFrame(data, "name string, size int, rep int, lat string, tags array<int>")
    out = agg.rep_aggregate(df, ["lat"], agg_functions=["mean", "std", "count"])
    got = {tuple(r) for r in out.withColumn("lat_std", F.round("lat_std", 4)).collect()}
    assert got == {("s", 1, "[1]", 2.0, 0.7071, 2), (None, 2, None, 4.0, None, 1)}
    with pytest.raises(ValueError):
        agg.rep_aggregate(df, ["nope"])
    bad = spark.createDataFrame([("x", 0, "abc")], "name string, rep int, lat string")
    with pytest.raises(Exception, match="not numeric"):
        agg.rep_aggregate(bad, ["lat"]).collect()


def test_group_aggregate_rules(spark):
    df = spark.createDataFrame([("a", 1.0, ["k"]), ("b", 2.0, ["k", "z"])], "k string, v double, factor_columns array<string>")
    df = df.withColumn("z", F.lit(1))
    assert agg.expand_factors(df, ["$FACTORS$"]) == ["k", "z"]
    with pytest.raises(ValueError, match="twice"):
        agg.expand_factors(df, ["k", "$FACTORS$"])
    with pytest.warns(UserWarning):
        assert agg.group_aggregate(df, ["missing"], ["k"]).columns == df.columns
    with pytest.raises(ValueError):
        agg.group_aggregate(df, ["v"], ["missing"])
    with pytest.raises(ValueError, match="order_by"):
        agg.group_aggregate(df, ["v"], ["k"], ["custom_tail"])


def test_custom_aggregate(spark):
    name = "spread_for_test"
    agg.register_aggregate(name, lambda c: F.max(c) - F.min(c))
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0)], "k string, v double")
    assert agg.group_aggregate(df, ["v"], ["k"], [name]).first()[f"v_{name}"] == 3.0
    with pytest.raises(ValueError, match="exists"):
        agg.register_aggregate(name, F.max)


def test_union_widens_types(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2.5, 7)], "n double, s bigint")
    out = tf.union_by_name([a, b, spark.createDataFrame([(True,)], "extra boolean")])
    assert dict(out.dtypes) == {"n": "double", "s": "string", "extra": "boolean"} and out.count() == 3


def test_infer_objects(spark):
    df = spark.createDataFrame([("1", "1.5", "true", "x"), (None, "2", "false", "3")], "a string, b string, c string, d string")
    assert [t for _, t in verbs.call(df, "infer_objects").dtypes] == ["bigint", "double", "boolean", "string"]


def test_every_listed_verb_is_known():
    names = """sort_values sort_index drop rename add_prefix add_suffix reindex select_dtypes set_axis pop astype
        convert_dtypes infer_objects fillna dropna isna isnull notna notnull ffill pad bfill backfill interpolate replace
        clip round abs add sub mul div floordiv mod pow subtract multiply divide truediv radd rsub rmul rdiv rmod rpow
        rfloordiv rtruediv eq ne lt le gt ge isin drop_duplicates duplicated head tail nlargest nsmallest sample truncate
        take melt stack pivot pivot_table unstack explode transpose sum mean median min max std var sem skew kurt prod
        count nunique any all quantile mode agg describe value_counts corr cov groupby cumsum cumprod cummin cummax diff
        shift pct_change rank rolling expanding ewm resample asfreq reset_index set_index between_time at_time idxmax
        idxmin applymap map apply transform pipe filter eval query""".split()
    assert [n for n in names if n not in verbs.VERBS] == []


def times(spark, n=40, step="37 hours 30 minutes"):
    return spark.range(n).selectExpr(
        "id", "if(id % 3 = 0, 'a', 'b') as g", f"timestamp'2024-01-10 00:30:00' + cast(id as int) * interval '37' hour as ts",
        "if(id % 5 = 0, null, cast(id as double)) as v")


@pytest.mark.parametrize("rule", ["12h", "7D", "W", "ME", "MS", "QE", "YS", "500ms"])
def test_resample_like_pandas(spark, rule):
    df = times(spark, 3 if rule == "500ms" else 40)
    got = verbs.resample(df, rule, "ts").apply(["sum", "count"], ["v"]).toPandas().sort_values("ts").reset_index(drop=True)
    p = df.toPandas().set_index("ts")["v"].resample(rule, **({"origin": "epoch"} if rule in ("12h", "7D", "500ms") else {})).agg(["sum", "count"])
    assert got["ts"].tolist() == p.index.tolist()
    assert got["v_sum"].tolist() == p["sum"].tolist() and got["v_count"].tolist() == p["count"].tolist()


@pytest.mark.parametrize("rule", ["1D", "W", "ME"])
def test_resample_fills_groups(spark, rule):
    df = times(spark)
    got = verbs.resample(verbs.groupby(df, "g"), rule, "ts").apply("count", ["v"]).toPandas().sort_values(["g", "ts"])
    p = df.toPandas().set_index("ts").groupby("g")["v"].resample(rule).count().reset_index()
    assert got[["g", "ts", "v"]].values.tolist() == p[["g", "ts", "v"]].values.tolist()


def test_asfreq_starts_at_the_first_time(spark):
    df = times(spark, 5)
    got = verbs.asfreq(df, "1h", "ts").toPandas().sort_values("ts")
    p = df.toPandas().set_index("ts").asfreq("1h")
    assert got["ts"].tolist() == p.index.tolist() and got["id"].notna().sum() == 5


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_keeps_its_mean_over_long_gaps(spark, adjust):
    df = spark.range(1500).selectExpr("id", "if(id < 3 or id = 1200 or id > 1400, cast(id % 7 as double), null) as v", "id % 2 as g")
    got = verbs.ewm(df, "id", alpha=0.5, adjust=adjust).apply("mean", ["v"], "_m").toPandas().sort_values("id")["v_m"]
    want = df.toPandas()["v"].ewm(alpha=0.5, adjust=adjust).mean()
    # without adjustment pandas resets its weights at every value, which shows after a gap only
    rows = slice(0, 1500 if adjust else 1200)
    assert got.notna().all() and abs(got.to_numpy() - want.to_numpy())[rows].max() < 1e-9


def test_ewm_keeps_a_mean_from_both_sides_of_a_block_border(spark):
    # blocks have 288 rows
    df = spark.range(1300).selectExpr("id", "case when id = 287 then 0.0D when id in (288, 1200) then 10.0D when id = 290 then 4.0D end as v")
    got = verbs.ewm(df, "id", alpha=0.5).apply("mean", ["v"], "_m").toPandas().sort_values("id")["v_m"]
    want = df.toPandas()["v"].ewm(alpha=0.5).mean()
    assert got[287:].notna().all() and abs(got[287:].to_numpy() - want[287:].to_numpy()).max() < 1e-9


@pytest.mark.parametrize("func", ["median", "first", "last", "max"])
def test_pivot_table_functions(spark, func):
    df = times(spark).selectExpr("id", "id % 4 as k", "g", "v")
    got = verbs.pivot_table(df, "k", "g", "v", func, order_by="id").toPandas().sort_values("k").set_index("k")
    want = df.toPandas().pivot_table(index="k", columns="g", values="v", aggfunc=func)
    assert got[["a", "b"]].to_numpy().tolist() == want[["a", "b"]].to_numpy().tolist()


def test_mapping_aggregates_scan_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = verbs.groupby(df, "l_returnflag").agg({"l_quantity": ["mean", "max"], "l_tax": "min"})
    assert out.columns == ["l_returnflag", "l_quantity_mean", "l_quantity_max", "l_tax_min"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_expressions_keep_quoted_text(spark):
    from trialframe.operators import transforms

    df = spark.createDataFrame([("a==b",), ("a&&b",), ('say "x"',)], "n string")
    assert transforms.keep_where(df, "n == 'a==b'").count() == 1
    assert transforms.add_expression(df, "m = n == 'a==b'").filter("m").count() == 1


def test_predicates_keep_quoted_text(spark):
    from trialframe.plans.layout import predicate

    df = spark.createDataFrame([("a==b", 1), ("a&&b", 2), ('say "x"', 3)], "`the name` string, k int")
    for text, k in ((""" "the name" == 'a==b' """, 1), (""" `the name` == 'a&&b' && k == `2` """, 2), (""" "the name" == 'say "x"' || k == 9 """, 3)):
        assert [r.k for r in df.filter(predicate(text)).collect()] == [k]


def test_sample_draws_equal_rows_one_by_one(spark, chunked):
    df = spark.sql("select if(id < 50, 0, id) as x from range(100)")
    drawn = [verbs.sample(df, n=50, random_state=seed).filter("x = 0").count() for seed in range(6)]
    # fair draws have a mean of 25 and a deviation of 2.5
    assert all(13 <= n <= 37 for n in drawn) and 20 <= sum(drawn) / 6 <= 30
    assert verbs.sample(df, frac=1.0).count() == 100
    assert verbs.sample(df, n=0).count() == 0


def test_sample_by_weight(spark, chunked):
    df = spark.sql("select id, case when id < 100 then 9.0D when id < 200 then 1.0D when id < 210 then 0.0D end as w from range(220)")
    once = [r["id"] for r in verbs.sample(df, n=60, weights="w").collect()]
    assert len(set(once)) == 60 and max(once) < 200
    assert sum(i < 100 for i in once) > 40
    assert verbs.sample(df, n=220, weights="w").count() == 200
    many = [r["id"] for r in verbs.sample(df, n=2000, weights="w", replace=True, random_state=3).collect()]
    # 90 % of 2,000 draws, deviation 13.4
    assert len(many) == 2000 and max(many) < 200 and 1740 <= sum(i < 100 for i in many) <= 1860
    assert verbs.sample(df.limit(0), n=5, replace=True).count() == 0
    with pytest.raises(ValueError):
        verbs.sample(df.withColumn("w", F.lit(-1.0)), n=1, weights="w")
