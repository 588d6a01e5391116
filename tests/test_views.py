import math
import os
import statistics

import pandas as pd
import pytest

from trialframe.streaming import views

FUNCTIONS = ["count", "sum", "mean", "min", "max", "var", "std", "sem"]


class Folder:
    """Result files on disk, the view over them, and the paths that each refresh read."""

    def __init__(self, spark, base):
        self.spark, self.files, self.at = spark, {}, 0
        self.folder, self.state = str(base / "results"), str(base / "state")
        os.makedirs(self.folder + "/deep er")
        self.schema = spark.createDataFrame([], "exp string, v double").schema

    def put(self, name, *rows):
        path = f"{self.folder}/{name}.parquet"
        pd.DataFrame(rows, columns=["exp", "v"]).astype({"exp": "string", "v": "float64"}).to_parquet(path)
        self.at += 1  # times of their own, however fast the test runs
        os.utime(path, (1_700_000_000 + self.at, 1_700_000_000 + self.at))
        self.files[name] = rows

    def drop(self, name):
        os.remove(f"{self.folder}/{name}.parquet")
        del self.files[name]

    def refresh(self, fails=False):
        read = views.parquet_rows(self.spark, self.schema)
        seen = []

        def counted(paths):
            seen.extend(p.rsplit("/", 1)[1].removesuffix(".parquet").replace("\\", "") for p in paths)
            if fails:
                raise OSError("lost")
            return read(paths)

        out = views.refresh(self.spark, self.folder, self.state, counted, self.schema, ["exp"], ["v"], FUNCTIONS, "*.parquet")
        return sorted(seen), {r["exp"]: tuple(r)[1:] for r in out.collect()}

    def plain(self):
        groups = {}
        for rows in self.files.values():
            for exp, v in rows:
                groups.setdefault(exp, []).append(v)
        out = {}
        for exp, values in groups.items():
            x = [v for v in values if v is not None]
            var = statistics.variance(x) if len(x) > 1 else None
            out[exp] = (len(x), math.fsum(x), math.fsum(x) / len(x) if x else None, min(x, default=None), max(x, default=None),
                        var, var and math.sqrt(var), var and math.sqrt(var / len(x)))
        return out

    def check(self, *read):
        seen, got = self.refresh()
        assert seen == sorted(read)
        want = self.plain()
        assert got.keys() == want.keys()
        for exp, row in want.items():
            assert [x is None for x in got[exp]] == [x is None for x in row], exp
            assert [x for x in got[exp] if x is not None] == pytest.approx([x for x in row if x is not None], rel=1e-9), exp


@pytest.fixture
def results(spark, tmp_path):
    return Folder(spark, tmp_path)


def test_only_changed_files_are_read(results):
    results.check()
    results.put("a", ("x", 1.0), ("x", 5.0), ("y", 2.0), (None, 3.0))
    results.put("deep er/b[1]", ("x", 1e9), ("y", None), ("z", None))
    assert results.refresh()[0] == ["a", "b[1]"]
    results.check()
    # a new file only adds
    results.put("c", ("x", -4.0), ("w", 1.0))
    results.check("c")
    # the file with the greatest value comes again without it, and far fewer digits are left to lose
    results.put("deep er/b[1]", ("x", 2.5), ("y", 7.0))
    results.check("b[1]")
    # a file goes: its groups lose rows, one of them all
    results.drop("c")
    results.check()
    assert "w" not in results.plain()
    results.check()
    # what was empty comes back, also under the name of a file that had gone
    results.put("c", ("w", 8.0), (None, None))
    results.put("a", ("y", 2.0))
    results.check("a", "c")


def test_failed_refresh_changes_nothing(results):
    results.put("a", ("x", 1.0))
    results.check("a")
    results.put("a", ("x", 3.0))
    results.put("b", ("y", 4.0))
    with pytest.raises(OSError):
        results.refresh(fails=True)
    results.check("a", "b")


def test_views_are_folded(results, monkeypatch):
    monkeypatch.setattr(views, "FOLD", 2)
    for i in range(4):
        results.put(f"f{i}", ("x", float(i)), (f"own{i}", 1.0))
        results.check(f"f{i}")
    results.drop("f0")
    results.check()


def test_unknown_function(spark, tmp_path):
    schema = spark.createDataFrame([], "exp string, v double").schema
    with pytest.raises(ValueError, match="median"):
        views.refresh(spark, str(tmp_path), str(tmp_path / "s"), views.parquet_rows(spark, schema), schema, ["exp"], ["v"], ["median"])
