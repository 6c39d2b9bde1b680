"""Run registered queries beside their oracle SQL and compare every value.

    python tests/compare.py [--sf 0.01] [pattern ...]
"""

from __future__ import annotations

import math
import re
import sys
import tempfile
import time
from pathlib import Path

import duckdb
import pandas

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(v):
    if v is None or v is pandas.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return f"{v:.1f}" if not (v == 0 and math.copysign(1, v) < 0) else "-0.0"
    return repr(v)


def normal(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    kinds = [frame[n].dtype.kind for n in names]
    data = sorted(tuple(_plain(v) for v in row) for row in frame[names].itertuples(index=False))
    return list(zip(names, kinds)), data


def _same_nullable(frame, other):
    """Longs with nulls are floats in one frame and nullable integers in the other: take the integers."""
    for n in set(frame.columns) & set(other.columns):
        if frame[n].dtype == "float64" and pandas.api.types.is_integer_dtype(other[n].dtype) and pandas.api.types.is_extension_array_dtype(other[n].dtype):
            frame = frame.assign(**{n: frame[n].astype("Int64")})
    return frame


def differences(spark_frame, oracle_frame) -> list[str]:
    spark_frame = _same_nullable(spark_frame, oracle_frame)
    left, ldata = normal(spark_frame)
    right, rdata = normal(oracle_frame)
    out = []
    if [n for n, _ in left] != [n for n, _ in right]:
        return [f"columns {[n for n, _ in left]} != {[n for n, _ in right]}"]
    if left != right and len(ldata):
        out.append(f"kinds {[(a, b[1]) for a, b in zip(left, right) if a != b]}")
    if len(ldata) != len(rdata):
        out.append(f"rows {len(ldata)} != {len(rdata)}")
    if ldata != rdata:
        a, b = set(ldata) - set(rdata), set(rdata) - set(ldata)
        out.append(f"{len(a)} rows only here {sorted(a)[:2]}, {len(b)} only there {sorted(b)[:2]}")
    return out


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tickloom.session import local_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("compare")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-compare-"))
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(re.search(p, n) for p in argv)]
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"{'rows' if len(got) else 'EMPTY'}  {name:44s} {len(got):7d} {t1 - t0:6.1f}s", flush=True)
                continue
            con = oracle_connection(folder)
            diff = differences(got, con.execute(oracles[name]).df())
            if not len(got):
                diff.append("EMPTY")
            bad += bool(diff)
            print(f"{'FAIL' if diff else 'ok  '}  {name:44s} {len(got):7d} {t1 - t0:6.1f}s "
                  f"{time.time() - t1:5.1f}s {'; '.join(diff)[:700]}", flush=True)
        except Exception as error:  # report and go on
            bad += 1
            print(f"ERROR {name:44s} {type(error).__name__}: {str(error)[:900]}", flush=True)
    print(f"{bad} of {len(names)} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
