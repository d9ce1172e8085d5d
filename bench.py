"""Time the headline queries and print one JSON line.

Each query is run once to warm up (files, generated code) and then timed as the median of three
full materialisations into a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelspark import build_session
from panelspark.queries import QUERIES

HEADLINE = (
    "unit_profile_flat", "history_snapshot", "type_summary", "month_profile", "type_breakdown",
    "annual_region_avg", "annual_series", "peer_benchmark_events", "melt_panel", "panel_silver",
    "panel_snapshot", "panel_change", "peer_benchmark_panel", "group_quantiles", "stability_quantiles",
    "typed_copy_diff", "quality_report", "release_impact", "parity_report", "evidence_attribution",
    "mention_join", "name_normalise", "link_harvest", "first_seen_dedup", "profile_json", "pack_shards",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    wanted = os.environ.get("BENCH_QUERIES")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    spark.stop()
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
