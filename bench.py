"""Run the headline queries on one data folder and print one JSON line with the seconds."""

from __future__ import annotations

import json
import os
import sys
import time

from tracegrove.plans.catalog import QUERIES
from tracegrove.session import build_session

HEADLINE = [
    "yield_report",
    "pass_counts_capped",
    "value_weights",
    "group_advantages",
    "greedy_diverse",
    "mine_positives",
    "mine_weighted_negatives",
    "step_negatives",
    "corrections",
    "preference_pairs",
    "merge_corpus",
    "merge_by_category",
    "corpus_report",
    "mixture_resample",
    "longest_per_category",
    "segments",
    "loss_per_token",
    "comparison_metrics",
    "diff_percentiles",
    "weighted_diff_percentiles",
    "review_state",
    "stratified_batches",
    "solve_linear",
    "solve_bits",
    "infer_numeric_ops",
    "substitution_maps",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    # Start-up and the first compilation are not part of any query's time.
    QUERIES["pass_counts_capped"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
