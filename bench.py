"""Exact against approximate on one machine; prints one JSON line.

Seconds are medians of warm runs, from building the frame to its last row on the driver. The
sample layout is written before, as an import would do, and timed apart. ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_RUNS`` choose the data, the cores and the runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline import AggregateSpec, Comparison  # noqa: E402
from plumbline.functions.order import SampleOrder  # noqa: E402
from plumbline.operators import adaptive, exact, sampling, sketch, textmatch  # noqa: E402
from plumbline.plans.progressive import progressive  # noqa: E402
from plumbline.session import local_session, scratch_path  # noqa: E402
from plumbline.sources import layout  # noqa: E402
from suite import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

TOTAL = AggregateSpec("sum", "l_extendedprice", scale=2)
FILTERED = AggregateSpec(
    "avg", "l_extendedprice", (Comparison("l_returnflag", "=", "R"),), scale=2
)
GROUPED = AggregateSpec("sum", "l_extendedprice", group_by="l_returnflag", scale=2)
ORDERS_SEEN = AggregateSpec("count", "l_orderkey", distinct=True)
ORDERS_BY_FLAG = AggregateSpec("count", "l_orderkey", group_by="l_returnflag", distinct=True)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")

    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = SampleOrder(keys, ties=("l_extendedprice",)).for_rows(lineitem.count())

    began = time.perf_counter()
    path = scratch_path(spark, "bench-layout")
    layout.write_sample_layout(lineitem, path, order)
    layout_seconds = time.perf_counter() - began
    stored = layout.open_sample_layout(spark, path)

    def run_to_target(spec: AggregateSpec):
        return lambda: list(progressive(stored, spec, 0.05))

    cases = {
        "exact_count": lambda: exact.exact(lineitem, AggregateSpec("count")).collect(),
        "exact_sum": lambda: exact.exact(lineitem, TOTAL).collect(),
        "progressive_sum_5pct": run_to_target(TOTAL),
        "trace_sum_5pct": lambda: adaptive.adaptive_trace(lineitem, TOTAL, order).collect(),
        "exact_avg_filtered": lambda: exact.exact(lineitem, FILTERED).collect(),
        "progressive_avg_filtered_5pct": run_to_target(FILTERED),
        "exact_sum_grouped": lambda: exact.exact(lineitem, GROUPED).collect(),
        "progressive_sum_grouped_5pct": run_to_target(GROUPED),
        "trace_sum_grouped_5pct": lambda: adaptive.grouped_trace(lineitem, GROUPED, order).collect(),
        "exact_distinct": lambda: exact.exact(lineitem, ORDERS_SEEN).collect(),
        "hll_distinct_5pct": lambda: sketch.distinct_trace(lineitem, ORDERS_SEEN).collect(),
        "exact_distinct_grouped": lambda: exact.exact(lineitem, ORDERS_BY_FLAG).collect(),
        "hll_distinct_grouped_5pct": lambda: sketch.grouped_distinct_trace(
            lineitem, ORDERS_BY_FLAG
        ).collect(),
        "reservoir_1000": lambda: sampling.draw(lineitem, order, 1000).collect(),
        "strata_draw_1000": lambda: sampling.draw_per_stratum(
            lineitem, order, "l_returnflag", 1000
        ).collect(),
        "intent_counts": lambda: textmatch.intent_counts(documents, "text").collect(),
    }
    for name in ("token_match", "value_mentions", "column_profile", "slot_reservoir"):
        cases[name] = lambda name=name: QUERIES[name](spark, SF_DIR).collect()

    seconds, results = {}, {}
    for name, run in cases.items():
        results[name] = run()
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 3)

    distinct = results["exact_distinct"][0][0]

    def outcome(run: str, truth: dict) -> dict:
        """What a progressive run used, and how far its last estimates are off."""
        last = results[run][-1]
        off = [abs(e["estimate"] / truth[e["group_value"]] - 1) for e in last.estimates]
        return {
            "steps": last.iteration,
            "sample_rows": last.sample_rows,
            "total_rows": last.total_rows,
            "files_read": last.files_read,
            "bytes_read_pct": round(100 * last.bytes_read / last.bytes_total, 3),
            "estimated_error": round(last.overall_error, 6),
            "realised_error": round(max(off), 6),
        }

    report = {
        "metric": "sum of median seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": CPUS,
        "layout_write_seconds": round(layout_seconds, 3),
        "sum_5pct": outcome("progressive_sum_5pct", {None: results["exact_sum"][0][0]}),
        "avg_filtered_5pct": outcome(
            "progressive_avg_filtered_5pct", {None: results["exact_avg_filtered"][0][0]}
        ),
        "sum_grouped_5pct": outcome(
            "progressive_sum_grouped_5pct", {r[0]: r[1] for r in results["exact_sum_grouped"]}
        ),
        "distinct_5pct": {
            "exact": distinct,
            "realised_error": round(
                abs(results["hll_distinct_5pct"][0]["estimate"] / distinct - 1), 6
            ),
        },
    }
    print(json.dumps(report), flush=True)


if __name__ == "__main__":
    main()
