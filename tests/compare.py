"""Runs registered queries next to their SQL and compares the results as sets of rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return f"{type(value).__name__}:{value}" if value is not None else "null"


def difference(df, con, sql: str) -> str | None:
    """What differs between a result and that of its SQL; None if nothing does."""
    names = sorted(df.columns)
    got = sorted(tuple(_plain(row[n]) for n in names) for row in df.collect())
    cursor = con.execute(sql)
    sql_names = [d[0] for d in cursor.description]
    if sorted(sql_names) != names:
        return f"columns {names} against {sorted(sql_names)}"
    places = [sql_names.index(n) for n in names]
    want = sorted(tuple(_plain(row[p]) for p in places) for row in cursor.fetchall())
    if got == want:
        return None
    ours, theirs = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} rows against {len(want)}; ours {sorted(ours)[:2]} theirs {sorted(theirs)[:2]}"


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from duskwatch.session import build_session

    spark = build_session(
        "compare", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = database(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            found = difference(df, con, oracle[name]) if name in oracle else f"no SQL ({df.count()} rows)"
            rows = df.count() if found is None else ""
        except Exception as exc:
            found, rows = f"{type(exc).__name__}: {exc}"[:600], ""
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {rows} {time.time() - start:.1f}s {found or ''}"[:900], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
