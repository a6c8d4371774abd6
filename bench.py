"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query runs once to warm up, then the median of the timed runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bellwire.session import local_session  # noqa: E402

HEADLINE = [
    "prepare_headlines",
    "aggregate_daily",
    "daily_sentiment_by_source",
    "lm_sentiment",
    "reindex_by_column",
    "corr_matrix",
    "stream_score",
    "pre_market_filter",
    "session_gap_join",
    "dedup_keep_first",
    "merge_sources",
    "ingest_articles",
    "clean_titles",
    "collect_by_day",
    "vector_pool",
    "attention_pool",
    "auc_rank",
    "lag_returns",
    "feature_frame",
    "keyed_update",
    "score_batches",
    "lr_baseline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "16g")
    from bellwire.registry import ENTRIES

    def once(name: str) -> float:
        start = time.perf_counter()
        ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        first = once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name}: first {first:.2f} median {seconds[name]:.2f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
