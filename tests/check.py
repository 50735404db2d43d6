"""Run queries next to their SQL in DuckDB: python tests/check.py [sf] [name ...]."""
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import duckdb
import pandas as pd

import __spark_entry__ as entry
from barloom.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and hasattr(v, "dtype") and v.dtype.kind in "iuf":
        f = float(v)
        return "NULL" if math.isnan(f) else repr(f + 0.0 if f else 0.0)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None))


def compare(spark, con, name, sf_dir):
    t = time.time()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    took = time.time() - t
    text = entry.oracle_sql().get(name)
    if text is None:
        return True, f"{took:6.2f}s {len(got)} rows, no SQL"
    want = con.execute(text).fetchdf()
    gc, g = rows(got)
    wc, w = rows(want)
    if gc != wc:
        return False, f"columns {set(gc) ^ set(wc)}"
    if g != w:
        bad = [(a, b) for a, b in zip(g, w) if a != b]
        return False, f"{len(g)} vs {len(w)} rows, {len(bad)} differ, e.g. {gc} {bad[:1]}"
    return True, f"{took:6.2f}s {len(g)} rows equal"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), duck(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    failed = 0
    for n in names:
        try:
            ok, note = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:400]}"
        failed += not ok
        print(("ok  " if ok else "BAD ") + n, note, flush=True)
    print("failed", failed, "of", len(names))
