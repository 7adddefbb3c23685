"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs whole into a
no-op sink, after one warm-up query; its time includes building the plan. Tables are dealt into
as many files as cores before the clock starts."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "decode_transfer",
    "decode_static_types",
    "decode_dynamic",
    "decode_votes",
    "decode_wide_signed",
    "unknown_events",
    "filter_topics",
    "blocks_dim",
    "insert_ignore",
    "list_events",
    "query_range",
    "query_order_page",
    "query_wide_int_range",
    "raw_top_receivers",
    "votes_with_time",
    "proposal_state",
    "proposal_state_one_pass",
    "sum_u256_total",
    "sum_signed_by_key",
    "balances",
    "total_supply",
    "contiguous_frontier",
    "abi_catalog",
    "stream_index",
]


def decode_rates(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Logs per second from staged raw logs to decoded rows."""
    from logweave.operators.routing import decode
    from logweave.sources.logs import stage_logs
    from logweave.sources.store import scratch_dir
    from workload import adapters as Z

    rates = {}
    for name, logs, event in (
        ("transfer", Z.token_logs, Z.TRANSFER),
        ("proposal_created", Z.proposal_logs, Z.CREATED),
        ("vote_with_tuple_array", Z.vote_logs, Z.VOTE),
        ("transfer_of_2^192", Z.wide_logs, Z.TRANSFER),
        ("document_text", Z.document_logs, Z.POSTED),
    ):
        path = scratch_dir(spark, f"bench-{event.name.lower()}")
        stage_logs(logs(spark, sf_dir), path, partitions=spark.sparkContext.defaultParallelism)
        rows = decode(spark.read.parquet(path), event)
        count = rows.count()
        begin = time.perf_counter()
        rows.write.format("noop").mode("overwrite").save()
        rates[name] = round(count / (time.perf_counter() - begin))
    return rates


def staged_tables(spark: SparkSession, sf_dir: str, parts: int) -> str:
    """The tables in as many files as there are cores. A table of one row group would be one task;
    writing it anew is no part of a query, and stands outside the clock."""
    from logweave.sources.store import scratch_dir

    root = scratch_dir(spark, "bench-tables")
    for name in ("events", "orders", "lineitem", "documents", "part", "customer", "supplier", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(parts).write.parquet(f"{root}/{name}.parquet")
    return root


def main() -> None:
    from workload import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    tables = staged_tables(spark, sf_dir, int(cpus))

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    run("raw_count")
    names = sys.argv[1:] or HEADLINE
    times = {name: run(name) for name in names}
    rates = {} if sys.argv[1:] else decode_rates(spark, tables)
    spark.stop()
    print(
        json.dumps(
            {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus), "decoded_rows_per_sec": rates}
        )
    )


if __name__ == "__main__":
    main()
