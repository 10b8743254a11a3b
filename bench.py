"""Wall-clock per query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

BENCH_QUERIES may name queries (comma separated) or be "all". Each query is planned and run over its whole input
with results discarded, after one run on the smallest folder has started the session: the median of three runs, or one
run where that takes long.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from quirework import session
from quirework.plans import catalog

HEADLINE = [
    "q_flagship_ownership", "q_a03_event_scan", "q_a07_joined_text", "q_b06_decide", "q_b08_signature", "q_b09_image_eligibility", "q_b24_claims_without_negation",
    "q_c03_image_placement", "q_c06_phrase_hits_body", "q_c06_phrase_hits_anchor_join", "q_c07_used_not_defined", "q_c13_reachable", "q_c14_outline_levels", "q_c18_page_to_part",
    "q_d01_placement_rollup", "q_d02_document_rollup", "q_d03_upper_median", "q_d07_recognition_summary", "q_d12_host_summary", "q_d15_egress", "q_d17_size_labels", "q_d19_orientation_minority",
    "q_d27_validity", "q_d28_size_search", "q_d29_quality_estimate", "q_e01_unique_names", "q_e05_describe_ranges", "q_e06_merge_offsets", "q_e07_reorder", "q_e08_range_pages", "q_e09_latest_status",
    "q_e13_marker_balance", "q_e16_unknown_phrasings", "q_g02_merged_pages", "q_h09_word_placement", "q_h13_normalise", "q_i01_stream_status", "q_i01_stream_ledger", "q_i02_stream_upsert",
    "q_i03_once_per_event", "q_i04_stream_answers", "q_i05_stream_egress", "q_i05_stream_third_party", "q_i06_stash_claims", "q_i06_stream_claims", "q_i07_stream_pending", "q_i08_stream_timeline",
]
RUNS = 3
LONG_S = 4.0  # a query that takes longer is run once: its fixed costs no longer blur it


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    spark = session.configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(folder), "sf0.001")
    catalog.QUERIES["q_flagship_ownership"](spark, warm if os.path.isdir(warm) else folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        took = []
        while len(took) < RUNS and not (took and took[0] > LONG_S):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
