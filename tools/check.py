"""Run registered queries against their SQL on DuckDB and compare columns and values."""

import argparse
import math
import sys
import time
import warnings
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
warnings.filterwarnings("ignore")

from queries import load_all  # noqa: E402
from trialframe.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat(" ")
    if isinstance(v, float):
        return v
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__ in ("int", "float", "bool")), x if not isinstance(x, bool) else int(x))
                 if x is not None else (True, "", 0) for x in row)


def compare(got, want):
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    worst = 0.0
    for a, b in zip(sorted(got, key=lambda r: repr(shape(r))), sorted(want, key=lambda r: repr(shape(r)))):
        for x, y in zip(a, b):
            if x == y:
                continue
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                err = abs(x - y) / max(abs(x), abs(y), 1e-300)
                worst = max(worst, err)
                if err < 1e-9:
                    continue
            return f"values differ: {a} != {b}"
    return f"approx (max rel err {worst:.1e})" if worst else "ok"


def shape(row):
    return tuple(float(f"{x:.9g}") if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in row)


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--chunk", default=None)
    args = parser.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    if args.chunk:
        spark.conf.set("spark.trialframe.chunkRows", args.chunk)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = []
    for name, q in load_all().items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        begin = time.time()
        try:
            df = q.run(spark, args.sf)
            rows = [tuple(r) for r in df.collect()]
            seconds = time.time() - begin
            cols = df.columns
            status = f"no sql ({len(rows)} rows)"
            if q.sql:
                cur = con.execute(q.sql)
                names = [d[0] for d in cur.description]
                if sorted(names) != sorted(cols):
                    status = f"columns differ: {sorted(cols)} != {sorted(names)}"
                else:
                    order = sorted(cols)
                    got = [tuple(plain(r[cols.index(c)]) for c in order) for r in rows]
                    want = [tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()]
                    status = f"{compare(got, want)} ({len(got)} rows)"
        except Exception as e:
            seconds = time.time() - begin
            status = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if not status.startswith(("ok", "no sql")):
            bad.append(name)
        print(f"{name:26s} {seconds:6.2f}s  {status[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
