"""Runs registered queries against their oracle SQL in DuckDB and compares all values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (int, str)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return float(value) if hasattr(value, "as_integer_ratio") else str(value)


def order_key(row):
    return tuple((v is None, str(type(v)), str(round(v, 6)) if isinstance(v, float) else str(v)) for v in row)


def same(a, b, exact: bool) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
        return a == b if exact else math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    return names, kinds, cursor.fetchall()


def compare(spark, con, name: str, build, sql: str | None, sf_dir: str, exact: bool = True) -> tuple[bool, str]:
    """Whether the query equals its oracle, and a note; without SQL only that it runs."""
    start = time.time()
    df = build(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(([plain(row[c]) for c in names] for row in df.collect()), key=order_key)
    seconds = time.time() - start
    if sql is None:
        return bool(got), f"{len(got)} rows, no oracle, {seconds:.1f}s"
    duck_names, _, rows = duck_rows(con, sql)
    if sorted(duck_names) != names:
        return False, f"columns {names} against {sorted(duck_names)}"
    at = [duck_names.index(c) for c in names]
    want = sorted(([plain(row[i]) for i in at] for row in rows), key=order_key)
    if len(got) != len(want):
        return False, f"{len(got)} rows against {len(want)}"
    for g, w in zip(got, want):
        for c, a, b in zip(names, g, w):
            if not same(a, b, exact):
                return False, f"{c}: {a!r} against {b!r} in {dict(zip(names, g))} / {dict(zip(names, w))}"
    return True, f"{len(got)} rows, {seconds:.1f}s"


def main() -> int:
    import __spark_entry__ as entry_point
    from rivermeld.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session(os.environ.get("CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    builds, sqls = entry_point.queries(), entry_point.oracle_sql()
    bad = 0
    for name, build in builds.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, build, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, note[:1200], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
