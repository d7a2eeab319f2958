"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
Each query runs in full into Spark's ``noop`` sink, once to warm up and then BENCH_RUNS times (default
2); the best time counts. ``BENCH_ONLY=a,b`` limits the run to named queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from evenkeel import plans  # noqa: E402
from evenkeel.session import build_session  # noqa: E402

HEADLINE = [
    "exact_sum_by_flag", "stable_stats_by_type", "quantity_variance", "softmax_by_user", "softmax_schedule", "logsumexp_by_label",
    "sample_categorical", "minibatch_per_user", "lineitem_fingerprint", "grouped_fingerprint", "snapshot_diff", "clamped_fold",
    "clamped_fold_blocks", "level_fold", "level_history", "running_stats", "pre_post_pairs", "sequence_features", "tail_lines",
    "run_metrics", "leak_scan", "invariants", "stream_monitor", "stream_fold"]


def double_sum_by_flag(spark, sf_dir):
    """The same sums as ``exact_sum_by_flag`` in plain double, whose last bits depend on the layout."""
    sums = [F.sum(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg(F.count("l_quantity"), *sums)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    chosen = {n: plans.QUERIES[n] for n in HEADLINE}
    chosen["double_sum_by_flag"] = double_sum_by_flag
    if os.environ.get("BENCH_ONLY"):
        chosen = {n: chosen.get(n) or plans.QUERIES[n] for n in os.environ["BENCH_ONLY"].split(",")}
    best, cold = {}, {}
    for name, run in chosen.items():
        for turn in range(runs + 1):
            started = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            if turn == 0:
                cold[name] = round(took, 3)
            else:
                best[name] = round(min(took, best.get(name, took)), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(best.values()), 3), "unit": "sec", "queries": best,
                      "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
