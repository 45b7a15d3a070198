"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "redacted_documents", "document_redaction", "document_identifiers", "line_units", "contact_plan", "contact_redaction",
    "markdown_units", "mined_candidates", "mining_counts", "document_noise", "clean_text", "word_tfidf", "cell_items",
    "guide_items_pdf", "confusion_matrix", "feedback_groups", "stratified_split",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        # Small local files would otherwise be one partition each and use one core.
        .config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from veilspark_checks.queries import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(size(split(text, '\n')))").first()[0]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "spark": spark.version,
        "lines_per_sec_detect_plan_apply": round(lines / times["redacted_documents"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
