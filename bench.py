"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built and fully executed with the ``noop`` sink (all rows
produced, nothing shipped to the driver), three times, and the median is reported; one that takes over ``ONCE`` seconds
runs once.  Every time is written to stderr when it is known.  ``BENCH_BUDGET`` seconds after the start (1500) the JSON
line is printed with the queries done by then; the two with full forests come last.  ``compare`` holds two A/B timings
leaf, and the grouped top-N reduction versus the global-window form.
"""

from __future__ import annotations

import json
import os
import signal
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from segrules.operators.reduce import reduce_topn_multi  # noqa: E402
from segrules.operators.rules import leaf_rules, rule_predicate  # noqa: E402
from segrules.operators.report import coverage_counts  # noqa: E402
from segrules.plans.catalog import QUERIES, _tree  # noqa: E402
from segrules.session import cut_lineage, local_session  # noqa: E402
from segrules.sources.tables import funnel_fixture  # noqa: E402

HEADLINE = [
    "rule_report",
    "reduce_topn_multi",
    "value_rank",
    "value_counts_window",
    "split_search",
    "clean_path_column",
    "category_index",
    "score_rows",
    "rule_coverage",
    "tree_nodes",
    "feature_importance",
    "segment_report",
]


REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))  # the median of so many runs is reported
ONCE = 60.0
BUDGET = int(os.environ.get("BENCH_BUDGET", "1500"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    began = time.perf_counter()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    event_log = os.environ.get("BENCH_EVENT_LOG")  # read back by tools/job_times.py
    extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_log} if event_log else None
    spark = local_session(cpus, partitions=int(os.environ.get("BENCH_PARTITIONS", "16")), app="segrules-bench", extra=extra)
    # Warm the JVM once, outside the timings: parquet readers on the bench
    # data, and the ML code paths on the smallest data set.
    run(funnel_fixture(spark, sf_dir))
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        run(QUERIES["rule_report"](spark, warm_dir))

    times: dict[str, float] = {}
    compare: dict[str, float] = {}

    def report() -> None:
        out = {
            "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "compare": compare,
            "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": cpus, "missing": [k for k in HEADLINE if k not in times],
        }
        print(json.dumps(out), flush=True)

    def at_deadline(*_: object) -> None:
        report()
        os._exit(0)

    signal.signal(signal.SIGALRM, at_deadline)
    signal.alarm(max(1, BUDGET - int(time.perf_counter() - began)))
    tree = _tree(spark, sf_dir)
    spark.sparkContext.setJobGroup("compare", "compare")
    data = cut_lineage(tree.fm.data)
    rules = leaf_rules(tree).collect()
    preds = [(r["node"], rule_predicate(r["rule_list"])) for r in rules]
    compare["coverage_one_aggregation"] = timed(lambda: coverage_counts(data, preds).collect())
    compare["coverage_count_per_leaf"] = timed(lambda: [data.where(p).count() for _, p in preds] + [data.count()])

    fx = cut_lineage(funnel_fixture(spark, sf_dir).select("l_orderkey", "first_page"))
    compare["topn_grouped"] = timed(lambda: run(reduce_topn_multi(fx, {"first_page": 15})))

    def window_form():
        c = "first_page"
        ranked = fx.withColumn("cnt", F.count(c).over(Window.partitionBy(c))).withColumn(
            "rk", F.dense_rank().over(Window.orderBy(F.desc("cnt"), F.desc(c)))
        )
        run(ranked.select("l_orderkey", F.when(F.col("rk") > 15, "Other").when(F.col(c) == "", "Unknown").otherwise(F.col(c))))

    compare["topn_global_window"] = timed(window_form)

    for k in HEADLINE:
        spark.sparkContext.setJobGroup(k, k)
        runs: list[float] = []
        while len(runs) < REPEATS and (not runs or max(runs) <= ONCE):
            runs.append(timed(lambda: run(QUERIES[k](spark, sf_dir))))
        times[k] = statistics.median(runs)
        print(k, runs, file=sys.stderr, flush=True)
    signal.alarm(0)
    report()


if __name__ == "__main__":
    main()
