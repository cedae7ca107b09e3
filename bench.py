"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import importlib.util
import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

HEADLINE = [
    "flagship_domain_report", "F1_unified_records", "B1_normalize_url", "B5_classify", "B8_link_cleanup",
    "C1_parse_dom", "C2_basic_extract", "C4_json_ld", "C5_main_text", "C6_selector_chain", "C17_fingerprint",
    "C16_instagram_post", "C16_facebook_post", "C16_youtube_video", "E1_is_public", "E5_content_classifier",
    "F7_fallback_resolution", "F8_strategy_choice", "G1_domain_rollup", "G3_best_selector", "G4_selector_health",
    "H1_drift_alerts", "H4_pacing_factor", "H6_polite_schedule", "H7_budget_gate", "H8_cached_reuse",
    "M1_request_table", "M2_response_table", "A5_archive", "I9_entity_pairs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="webgrain-bench-"))
        .config("spark.sql.shuffle.partitions", cpus).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).with_name("__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    found = entry.queries()
    import webgrain
    # Start the JVM's code paths and the Python workers before the clock.
    found["C1_parse_dom"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name, "pages_per_sec_parse": round(pages / times["C1_parse_dom"], 1),
    }))
    webgrain.clean_up(spark)
    spark.stop()


if __name__ == "__main__":
    main()
