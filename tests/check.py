"""Run every registered query next to its SQL: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty when equal, else what differs."""
    got = query(spark, sf_dir)
    want = con.execute(sql).to_arrow_table()
    if sorted(got.columns) != sorted(want.column_names):
        return f"columns {sorted(got.columns)} != {sorted(want.column_names)}"
    got_arrow = got.toArrow()
    kinds = [(c, str(got_arrow.schema.field(c).type), str(want.schema.field(c).type)) for c in got.columns]
    odd = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]

    def lists(tab):
        return {c: tab.column(c).to_pylist() for c in sorted(got.columns)}

    def tuples(tab):
        d = lists(tab)
        return sorted(zip(*d.values()), key=lambda r: tuple((v is None, str(v)) for v in r))

    g, w = tuples(got_arrow), tuples(want)
    if len(g) != len(w):
        return f"{len(g)} rows, expected {len(w)}"
    for x, y in zip(g, w):
        if x != y:
            return f"cols {sorted(got.columns)}\n   got  {str(x)[:700]}\n   want {str(y)[:700]}"
    return f"types {odd}" if odd else ""


def main() -> int:
    import __spark_entry__ as entry
    from pageloom.session import build

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build(
        spark__master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, oracles, bad = database(sf_dir), entry.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            diff = compare(spark, con, sf_dir, entry.queries()[name], oracles[name])
        except Exception as error:  # report and go on with the next query
            diff = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(diff)
        print(f"{'ok ' if not diff else 'BAD'} {name} {time.time() - start:.1f}s {diff}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
