"""Measure the scan of generated result trees and the expansion of a run table; prints one JSON line."""

import json
import sys
import tempfile
import time
import warnings
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
warnings.filterwarnings("ignore")

from trialframe.plans.design import run_table  # noqa: E402
from trialframe.session import local_session  # noqa: E402
from trialframe.sources import formats, results  # noqa: E402


def make_tree(root: Path, jobs: int) -> None:
    for run in range(jobs):
        base = root / f"s_1/e/run_{run}/rep_0"
        (base / "h/host_0").mkdir(parents=True)
        (base / "config.json").write_text(json.dumps({"size": run % 10, "opt": {"fast": run % 2 == 0}}))
        (base / "h/host_0/out.json").write_text(json.dumps([{"lat": run / 7, "n": i} for i in range(5)]))


def main() -> None:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    out = {}
    for jobs in (100, 1000, 10000):
        root = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        make_tree(root, jobs)
        begin = time.perf_counter()
        df = results.extract(spark, str(root), "s", "1", ["e"], {"json": formats.JsonFiles()}, {"e": ["size"]})
        df.write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - begin
        out[f"tree_{jobs}_jobs"] = {"seconds": round(seconds, 2), "result_files_per_second": round(jobs / seconds)}
    factors = {f"f{i}": {"$FACTOR$": list(range(10))} for i in range(6)}
    begin = time.perf_counter()
    run_table(spark, "e", {"base_experiment": factors}).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - begin
    out["run_table_1e6"] = {"seconds": round(seconds, 2), "rows_per_second": round(1e6 / seconds)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
