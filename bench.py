"""Time the queries; prints one JSON line.

Every query is read to the end (``noop`` sink) twice in one session and the
faster run counts. ``BENCH_QUERIES`` names a subset, ``all`` or nothing the
default set.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from credtrail.queries import QUERIES

HEADLINE = (
    "extract_kv document_scan page_scan keyword_counts pickaxe_commits findings_dedup "
    "values_agg secrets_agg secret_timeline stats_entry_authors stats_secret_authors "
    "scan_both_merge findings_union values_longest_first pattern_batches redact_lines "
    "redact_documents_fold redact_documents_anchor redact_residual secrets_csv_view "
    "report_secrets git_log_secrets jsonl_roundtrip json_roundtrip stream_findings"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").split()
    names = list(QUERIES) if wanted == ["all"] else wanted or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("credtrail-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
