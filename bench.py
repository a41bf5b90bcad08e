"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR: one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import time

from quartzgate import session
from quartzgate.plans import registry

HEADLINE = (
    "operating_curve operating_curve_by_task misroute_summary cumulative_gain per_task_decisions roc_auc_by_task macro_f1 spearman "
    "paired_win_rate bootstrap_ci gate_thresholds cost_per_1k route_rates latency_p50_p95 request_windows sessions pii_regex_spans "
    "span_scores knn_similarity pricing_summary revenue_by_nation"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.local(memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["pricing_summary"](spark, folder).count()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
