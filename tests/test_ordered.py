"""Ordered computations against pandas, with one group that holds a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trialframe.operators import verbs
from trialframe.operators.ordered import (
    chunk_rows,
    column_quantiles,
    edge_rows,
    positions,
    quantiles,
    running,
    Scan,
    with_chunks,
)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 600
    group = np.where(np.arange(n) % 3 == 0, "hot", np.char.add("g", rng.integers(0, 20, n).astype(str)))
    value = np.where(rng.random(n) < 0.15, np.nan, np.round(rng.normal(10, 4, n), 2))
    return pd.DataFrame({"id": np.arange(n), "t": rng.integers(0, 40, n), "g": group, "v": value})


def load(spark, frame):
    df = spark.createDataFrame(frame.astype({"id": "int64", "t": "int64"}))
    from pyspark.sql import functions as F

    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def ordered(frame):
    return frame.sort_values(["t", "id"]).reset_index(drop=True)


def result(df, name):
    p = df.toPandas().sort_values(["t", "id"]).reset_index(drop=True)
    return p[name].astype(float)


ORDER = ["t", "id"]


@pytest.mark.parametrize("verb", ["cumsum", "cummin", "cummax", "cumprod"])
def test_cumulative(spark, chunked, frame, verb):
    got = result(verbs.call(verbs.groupby(load(spark, frame), "g"), verb, {"order_by": ORDER, "columns": "v"}), "v")
    want = getattr(ordered(frame).groupby("g")["v"], verb)()
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("verb,periods", [("shift", 1), ("shift", -2), ("diff", 3), ("pct_change", 1)])
def test_offsets(spark, chunked, frame, verb, periods):
    got = result(verbs.call(verbs.groupby(load(spark, frame), "g"), verb,
                            {"order_by": ORDER, "columns": "v", "periods": periods}), "v")
    p = ordered(frame).groupby("g")["v"]
    want = p.pct_change(periods, fill_method=None) if verb == "pct_change" else getattr(p, verb)(periods)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("func", ["mean", "sum", "min", "max", "std", "median"])
def test_rolling(spark, chunked, frame, func):
    got = result(verbs.rolling(verbs.groupby(load(spark, frame), "g"), 5, ORDER, min_periods=2).apply(func, ["v"]), "v")
    want = getattr(ordered(frame).groupby("g")["v"].rolling(5, min_periods=2), func)().reset_index(0, drop=True).sort_index()
    np.testing.assert_allclose(got, want, rtol=1e-7, atol=1e-9)


def test_rolling_centered(spark, chunked, frame):
    got = result(verbs.rolling(load(spark, frame), 5, ORDER, min_periods=1, center=True).apply("sum", ["v"]), "v")
    want = ordered(frame)["v"].rolling(5, min_periods=1, center=True).sum()
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("func", ["sum", "mean", "max", "std", "count"])
def test_expanding(spark, chunked, frame, func):
    got = result(verbs.expanding(load(spark, frame), ORDER, min_periods=2).apply(func, ["v"]), "v")
    want = getattr(ordered(frame)["v"].expanding(min_periods=2), func)()
    np.testing.assert_allclose(got, want, rtol=1e-7)


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm(spark, chunked, frame, adjust):
    full = frame.assign(v=frame["v"].fillna(3.0))
    got = result(verbs.ewm(load(spark, full), ORDER, span=6, adjust=adjust).apply("mean", ["v"]), "v")
    np.testing.assert_allclose(got, ordered(full)["v"].ewm(span=6, adjust=adjust).mean(), rtol=1e-9)


def test_ewm_missing(spark, chunked, frame):
    got = result(verbs.ewm(load(spark, frame), ORDER, halflife=3).apply("mean", ["v"]), "v")
    np.testing.assert_allclose(got, ordered(frame)["v"].ewm(halflife=3).mean(), rtol=1e-9)


def test_fill_and_interpolate(spark, chunked, frame):
    df, p = load(spark, frame), ordered(frame)
    np.testing.assert_allclose(result(verbs.ffill(df, ORDER, ["v"], ["g"]), "v"), p.groupby("g")["v"].ffill())
    np.testing.assert_allclose(result(verbs.bfill(df, ORDER, ["v"], ["g"]), "v"), p.groupby("g")["v"].bfill())
    np.testing.assert_allclose(result(verbs.ffill(df, ORDER, ["v"], limit=1), "v"), p["v"].ffill(limit=1))
    np.testing.assert_allclose(result(verbs.interpolate(df, ORDER, ["v"]), "v"), p["v"].interpolate(), rtol=1e-9)


@pytest.mark.parametrize("method", ["average", "min", "max", "dense"])
@pytest.mark.parametrize("pct", [False, True])
def test_rank(spark, chunked, frame, method, pct):
    coarse = frame.assign(v=frame["v"].round(0))
    got = result(verbs.rank(verbs.groupby(load(spark, coarse), "g"), ["v"], method, ascending=False, pct=pct), "v")
    want = ordered(coarse).groupby("g")["v"].rank(method=method, ascending=False, pct=pct)
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_quantiles(spark, chunked, frame):
    df = load(spark, frame)
    got = quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.75}).toPandas().set_index("g").sort_index()
    want = frame.groupby("g")["v"].quantile([0.1, 0.75]).unstack()
    np.testing.assert_allclose(got[["a", "b"]], want, rtol=1e-12)
    both = column_quantiles(df, [], ["v", "id"], [0.5, 0.9], lambda c, q: f"{c}{q}").first()
    assert both["v0.5"] == pytest.approx(frame["v"].median()) and both["id0.9"] == pytest.approx(frame["id"].quantile(0.9))


def test_edge_rows(spark, chunked, frame):
    df = load(spark, frame)
    for n in (3, 1001):
        got = {r["id"] for r in edge_rows(df, ["g"], ORDER, n, last=True).collect()}
        assert got == set(ordered(frame).groupby("g").tail(n)["id"])


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "id"], ["g", "-id"], ["v", "id"], ["-v", "-id"]])
def test_positions_are_the_order(spark, chunked, frame, order):
    df = positions(load(spark, frame), [], order)
    by = [o.lstrip("-") for o in order]
    up = [not o.startswith("-") for o in order]
    want = frame.sort_values(by, ascending=up, na_position="last", kind="stable")["id"].tolist()
    got = [r["id"] for r in df.orderBy("__place").collect()]
    assert got == want


def test_chunks_split_heavy_ties(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).withColumn("x", F.when(F.col("id") % 3 == 0, F.lit("same text for many rows")).otherwise(
        F.concat(F.lit("t"), F.col("id").cast("string"))))
    df = df.withColumn("n", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")))
    parts = with_chunks(df, ["n", "id"], 3000, 100).groupBy("__chunk").count().toPandas()
    assert parts["count"].max() <= 250


def test_long_texts_with_one_beginning_are_split(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000).select(
        F.concat(F.lit("https://host.example/some/long/path/"), F.xxhash64("id").cast("string")).alias("url"),
        F.lit("same").alias("t"), "id")
    for order in ("url", ["t", "id"], ["t", "-url"], "t"):
        parts = with_chunks(df, order, 20000, 1000).groupBy("__chunk").count().toPandas()
        assert parts["count"].max() <= 2500 and len(parts) > 10


@pytest.mark.parametrize("column", ["b", "d", "x", "t"])
def test_any_sortable_order_splits_a_group(spark, column):
    spark.conf.set("spark.trialframe.chunkRows", "50")
    try:
        df = spark.range(900).selectExpr(
            "id", "if(id % 3 = 0, 1, 0) as g", "cast(hex(id + 5000) as binary) as b", "cast(id as decimal(30, 2)) / 7 as d",
            "named_struct('a', id % 2, 'b', id) as x", "concat('a common beginning of thirty bytes', lpad(id, 9, '0')) as t")
        done = running(df, ["g"], column, {"n": Scan("count"), "s": Scan("sum", "id")}).toPandas()
    finally:
        spark.conf.unset("spark.trialframe.chunkRows")
    plain = done.assign(k=done["id"] % 2 * (column == "x")).sort_values(["g", "k", "id"])
    assert (plain.groupby("g").cumcount() + 1 == plain["n"]).all() and (plain.groupby("g")["id"].cumsum() == plain["s"]).all()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=60))
def test_running_sum_any_data(spark, data):
    rows = [(i, g, v) for i, (g, v) in enumerate(data)]
    df = spark.createDataFrame(rows, "i bigint, g string, v bigint")
    spark.conf.set("spark.trialframe.chunkRows", "7")
    try:
        assert chunk_rows(df) == 7
        done = running(df, ["g"], "i", {"s": Scan("sum", "v"), "e": Scan("sum", "v", exclusive=True), "l": Scan("last", "v")})
        got = {r["i"]: (r["s"], r["e"], r["l"]) for r in done.collect()}
    finally:
        spark.conf.unset("spark.trialframe.chunkRows")
    seen: dict = {}
    for i, g, v in rows:
        total, last = seen.get(g, (None, None))
        after = v if total is None else total if v is None else total + v
        assert got[i] == (after, total, v if v is not None else last)
        seen[g] = (after, v if v is not None else last)


@pytest.fixture(scope="module")
def timed(spark):
    rng = np.random.default_rng(5)
    seconds = np.sort(rng.integers(0, 900, 400))
    frame = pd.DataFrame({"id": range(400), "g": rng.choice(["a", "a", "a", "b"], 400), "s": seconds,
                          "v": np.where(rng.random(400) < 0.1, np.nan, rng.integers(0, 50, 400))})
    return frame


@pytest.mark.parametrize("func, closed", [("sum", "right"), ("var", "right"), ("max", "left"), ("mean", "both"), ("min", "both"),
                                          ("count", "neither")])
def test_rolling_by_time(spark, chunked, timed, func, closed):
    # cells of 300 seconds hold more rows than a chunk, some times have many rows
    df = spark.createDataFrame(timed).selectExpr("id", "g", "timestamp_seconds(s) as ts", "nullif(v, double('nan')) as v")
    got = verbs.rolling(verbs.groupby(df, "g"), "300s", on="ts", closed=closed).apply(func, ["v"], "_w")
    got = {r["id"]: r["v_w"] for r in got.collect()}
    assert len(got) == len(timed)
    for r in timed.itertuples():
        age = r.s - timed.s
        inside = (age >= 0 if closed in ("right", "both") else age > 0) & (age <= 300 if closed in ("left", "both") else age < 300)
        seen = timed.v[inside & (timed.g == r.g)].dropna()
        want = len(seen) if func == "count" else None if len(seen) == 0 else getattr(seen, func)() if func != "var" or len(seen) > 1 else None
        assert got[r.id] == (want if want is None else pytest.approx(want)), (r.id, closed)


def test_rolling_by_time_edges(spark, chunked):
    df = spark.sql("select id, if(id < 3, null, timestamp_seconds(0)) as ts, 1.0D as v from range(120)")
    got = {r["id"]: r["v_n"] for r in verbs.rolling(df, "1min", on="ts").apply("sum", ["v"], "_n").collect()}
    assert got == {i: None if i < 3 else 117.0 for i in range(120)}
    assert verbs.rolling(df.limit(0), "1min", on="ts").apply("sum", ["v"], "_n").collect() == []
    for wrong in ({"window": "1min"}, {"window": "1min", "on": "ts", "closed": "up"}):
        with pytest.raises(ValueError):
            verbs.rolling(df, **wrong)


def test_groups_of_long_texts_are_split_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trialframe.operators import ordered

    pieces, real = [], ordered.with_chunks

    def chunks(df, order, rows, target, keys=()):
        done = real(df, order, rows, target, keys)
        sizes = done.groupBy("__chunk").agg(F.sum(F.octet_length("t"))).collect()
        pieces.append(max(r[1] for r in sizes))
        return done

    monkeypatch.setattr(ordered, "with_chunks", chunks)
    df = spark.range(6000).select("id", (F.col("id") % 10 == 0).cast("int").alias("g"), F.concat(
        F.lit("a common beginning "), F.lpad(F.xxhash64("id").cast("string"), 20, "0"), F.repeat(F.lit("x"), 960)).alias("t"))
    spark.conf.set("spark.trialframe.chunkRows", "1000000")
    spark.conf.set("spark.trialframe.chunkBytes", "600000")
    try:
        whole = positions(df, [], ["t", "id"], "n").select("id", "g", "n").toPandas().sort_values("n")
        assert pieces and max(pieces) < 1_500_000
        parts = positions(df, ["g"], ["t", "id"], "n").select("id", "g", "n").toPandas().sort_values("n")
        # 600 rows hold less than the bound, 5,400 do not
        assert len(pieces) == 2 and max(pieces) < 1_500_000
    finally:
        spark.conf.unset("spark.trialframe.chunkRows")
        spark.conf.unset("spark.trialframe.chunkBytes")
    want = df.toPandas().sort_values(["t", "id"])
    assert whole["id"].tolist() == want["id"].tolist() and whole["n"].tolist() == list(range(6000))
    for g in (0, 1):
        own = parts[parts["g"] == g]
        assert own["id"].tolist() == want[want["g"] == g]["id"].tolist() and own["n"].tolist() == list(range(len(own)))
