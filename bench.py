"""Headline queries at one data folder; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridlocus.session import build_session  # noqa: E402
from gridlocus.workload import QUERIES, runnable  # noqa: E402

HEADLINE = [
    "flagship_electric_by_provider", "j1_point_in_territory", "v4_resolve_overlap_electric", "j8_gas_zip_join",
    "j11_zip_dominance_join", "j7_correction_near_point", "v2_dedupe_and_boost", "v10_primary_with_alternatives",
    "c6_accuracy_by_type", "g3_top_mismatch_pairs", "g8_coverage_by_type", "q2_build_review_queue",
    "w5_rolling_24h_count", "w7_consecutive_failures", "n1_match_name",
    "n6_match_catalog", "c1_compare_providers", "g24_territory_overlap", "v17_lookup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    runnable(QUERIES["k2_most_common"])(spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        start = time.time()
        runnable(QUERIES[name])(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
