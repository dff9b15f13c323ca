"""Run every registered query on Spark and its oracle SQL on DuckDB; compare.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of the
values (floats rounded to 6 digits), as the correctness gate does.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from embdrift.plans.catalog import registry, runner  # noqa: E402
from embdrift.session import get_spark  # noqa: E402
from embdrift.sources.tables import TABLES, table_path  # noqa: E402


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        r = round(v, 6)
        return repr(0.0 if r == 0 else r)
    if isinstance(v, (pd.Timestamp,)):
        return str(v.tz_localize(None) if v.tzinfo else v)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest(), rows


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark(os.environ.get("EMBDRIFT_MASTER", "local[8]"), shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    reg = registry()
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = runner(q)(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"rows {name}: {len(sdf)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            odf = con.sql(q.sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        n1, c1, h1, r1 = digest(sdf)
        n2, c2, h2, r2 = digest(odf)
        ok = (n1, c1, h1) == (n2, c2, h2)
        print(f"{'ok  ' if ok else 'FAIL'} {name}: rows {n1}/{n2} cols {'=' if c1 == c2 else (c1, c2)} "
              f"hash {'=' if h1 == h2 else '!='} {ts:.1f}s")
        if not ok:
            bad += 1
            d1 = [r for r in r1 if r not in set(r2)][:3]
            d2 = [r for r in r2 if r not in set(r1)][:3]
            print("   spark-only:", d1)
            print("   oracle-only:", d2)
            print("   spark dtypes:", dict(sdf.dtypes.astype(str)), " oracle dtypes:", dict(odf.dtypes.astype(str)))
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
