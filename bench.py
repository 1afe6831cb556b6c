"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleaner.plans import QUERIES  # noqa: E402
from gleaner.session import build_session  # noqa: E402

HEADLINE = [
    "balanced_quality", "variant_catalog", "text_quality_rci", "topic_keyword", "encode_fixed", "perplexity",
    "ngram_novelty", "ngram_novelty_ordered", "exact_dedup", "bloom_dedup", "signal_centroid", "grad_alignment",
    "strategy_profiles", "min_dist_recent", "knn_diversity", "greedy_kcenter", "greedy_weighted", "forgetting",
    "staleness", "run_state_vector", "zscore_sigmoid", "phase_detect", "phase_segments", "grad_alignment_ema",
    "timing_stats", "trial_top_decile", "robustness_pivot", "sweep_evaluate", "corrupt_grid", "corrupt_motion_blur",
    "stream_metrics_windows", "stream_phase_detect",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
