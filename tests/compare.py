"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return f"{float(value):.9g}"
    return value


def rows_of(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, fn, sql, sf) -> tuple[str, float]:
    begun = time.time()
    df = fn(spark, sf)
    got = df.collect()
    took = time.time() - begun
    if sql is None:
        return f"rows {len(got)} (no SQL)", took
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"DIFF columns {sorted(df.columns)} vs {sorted(names)}", took
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return f"ok {len(got)}", took
    only_a, only_b = list((a - b).items())[:2], list((b - a).items())[:2]
    return (f"DIFF spark {len(got)} sql {len(want)}, differing {sum((a - b).values())}\n"
            f"    {sorted(df.columns)}\n"
            f"    spark {str(only_a)[:700]}\n    sql   {str(only_b)[:700]}"), took


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import make_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    spark, con = make_session(), connect(sf)
    oracle = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        try:
            text, took = compare(spark, con, fn, oracle.get(name), sf)
        except Exception as problem:  # noqa: BLE001
            text, took = f"FAIL {type(problem).__name__}: {str(problem)[:900]}", 0.0
        if not text.startswith(("ok", "rows")):
            bad.append(name)
        if not text.startswith("ok") or only or took > 2.5:
            print(f"{name}: {text} [{took:.1f}s]", flush=True)
    print(f"{len(bad)} bad of {len(entry.queries())}: {bad}")


if __name__ == "__main__":
    main()
