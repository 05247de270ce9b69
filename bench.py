"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line with seconds by query."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from papyrion.plans.catalogue import QUERIES

HEADLINE = (
    "doc_stats_by_lang", "sheet_type", "segments", "keywords_topk", "clean_path", "pdf_lines", "row_profile", "column_profile", "transition_groups", "region_types",
    "classify_rows", "sql_indexable", "flat_records", "totals", "group_ranges", "content_asof_heading", "chunk_tree_dfs", "prompt_tiers", "event_fold",
)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            began = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
