"""Headline queries at one scale; prints one JSON line.

One query warms the session up; then each is timed once, its result written to Spark's no-op sink."""

from __future__ import annotations

import json
import os
import time

from seriesloom import plans
from seriesloom.session import local_session

HEADLINE = (
    "weekly_smoothed", "weekly_smoothed_suppliers", "asof_alignment", "mixed_frequency_sources", "series_quartiles", "cleaned_panel",
    "validation_report", "tiered_lags", "moving_averages", "moving_quantiles", "recursive_indicators", "interpolated_days", "embargo_split",
    "forecast_metrics", "run_comparison", "stationarity_by_version", "without_redundant_features", "chunk_table", "bm25_top", "nearest_vectors",
    "search_mixed", "trimmed_conversations", "markdown_tables", "assembled_messages_batch", "moving_averages_with_gaps", "tree_predictions",
    "assembled_messages",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "seriesloom-bench", os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = plans.queries(), {}

    def run(name: str) -> None:
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    run("weekly_smoothed")
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
