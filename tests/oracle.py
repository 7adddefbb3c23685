"""Run registered queries beside their SQL oracle: python -m tests.oracle [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(None if r[i] is None else str(r[i]) for i in order) for r in rows), key=repr)


def mismatch(spark_frame: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str | None]:
    """Row count, and None if both hold the same rows, else what differs first."""
    got = [tuple(r) for r in spark_frame.collect()]
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    expected = answer.fetchall()
    if sorted(spark_frame.columns) != sorted(names):
        return len(got), f"columns {sorted(spark_frame.columns)} != {sorted(names)}"
    left, right = _normal(spark_frame.columns, got), _normal(names, expected)
    if len(left) != len(right):
        return len(got), f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return len(got), f"{a} != {b}"
    return len(got), None


def main() -> None:
    from tests.session import session
    from workload import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = session(), duck(sf)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            frame = QUERIES[name](spark, sf)
            if name in ORACLES:
                size, verdict = mismatch(frame, con, ORACLES[name])
                verdict = verdict or "ok"
            else:
                size, verdict = frame.count(), "rows only"
        except Exception as error:  # noqa: BLE001
            verdict, size = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += verdict not in ("ok", "rows only")
        print(f"{name:32s} {size:8d} rows {time.time() - begin:6.1f}s  {verdict[:1500]}", flush=True)
    print(f"{bad} bad of {len(names)}")


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    main()
