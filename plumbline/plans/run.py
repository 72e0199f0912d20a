"""A whole run over a sample layout: method, steps, exact answer, comparison, latencies, and its record."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.adaptive import count_trace_of, exact_count_trace, final_answer, with_progress
from plumbline.operators.compare import compare_grouped, compare_scalar, speedup
from plumbline.operators.exact import exact, ordered
from plumbline.operators.method import MOST_GROUPS, verdict
from plumbline.operators.sketch import distinct_trace, grouped_distinct_trace
from plumbline.plans.progressive import as_trace, group_sizes, progressive
from plumbline.sources import runlog
from plumbline.sources.layout import SampleLayout
from plumbline.spec import AggregateSpec


@dataclass(frozen=True)
class Run:
    """What a run found. ``trace`` and ``comparison`` are None where the question was answered exactly.

    ``approx_ms`` and ``exact_ms`` are the seconds that the approximate and the exact answer took, in
    milliseconds, the group sizes counted with the approximate one.
    """

    spec: AggregateSpec
    method: str
    reason: str
    verdict: DataFrame
    trace: DataFrame | None
    exact: DataFrame
    comparison: DataFrame | None
    approx_ms: float | None
    exact_ms: float | None
    integral: bool


def run(
    layout: SampleLayout,
    spec: AggregateSpec,
    target_error: float = 0.05,
    confidence: float = 0.95,
    integral: bool = False,
) -> Run:
    """Answers a question from as few steps of the layout as it takes, then exactly, and compares.

    Group sizes come from the statistics of the layout where it has them. Only steps, sums and answers
    of at most 16 groups come to the driver; a question with more is answered exactly and stays a frame.
    """
    began = time.perf_counter()
    spark, table = layout.frame.sparkSession, layout.frame.drop("sample_step")
    sizes, opened = group_sizes(layout, spec)
    groups = len(sizes) if spec.group_by else 0
    found = spark.createDataFrame([(groups, sum(sizes.values()))], "group_count long, filtered_rows long")
    decided = verdict(found, spec)
    line = decided.first()
    truth = exact(table, spec)
    if line["method"] == "exact":
        return Run(spec, "exact", line["reason"], decided, None, ordered(truth, spec), None, None, None, integral)
    if line["method"] == "hyperloglog":
        build = grouped_distinct_trace if spec.group_by else distinct_trace
        trace = _kept(build(table, spec, target_error))
    elif spec.agg == "count" and spec.column is None and not spec.where:
        trace = count_trace_of(spark.createDataFrame([(layout.rows,)], "row_count long"))
    elif spec.agg == "count":
        trace = _kept(exact_count_trace(table, spec))
    else:
        trace = as_trace(layout, spec, list(progressive(layout, spec, target_error, confidence, sizes, opened, began)))
    approx_ms = (time.perf_counter() - began) * 1000
    began = time.perf_counter()
    truth = _kept(truth)
    exact_ms = (time.perf_counter() - began) * 1000
    compare = compare_grouped if spec.group_by else compare_scalar
    times = [F.lit(approx_ms).alias("approx_latency_ms"), F.lit(exact_ms).alias("exact_latency_ms")]
    comparison = compare(final_answer(trace), truth, spec, integral).select(
        "*", *times, speedup(F.lit(exact_ms), F.lit(approx_ms)).alias("speedup")
    )
    return Run(
        spec, line["method"], line["reason"], decided, trace, ordered(truth, spec), comparison, approx_ms, exact_ms, integral
    )


def _kept(answer: DataFrame) -> DataFrame:
    """The lines of an answer or trace of at most ``MOST_GROUPS`` groups, computed once."""
    rows = answer.limit(100 * MOST_GROUPS).collect()
    return answer.sparkSession.createDataFrame(rows, answer.schema)


def record(
    done: Run,
    path: str,
    session_id: str,
    prompt: str,
    dataset_id: str,
    dataset_label: str,
    target_error: float = 0.05,
    confidence: float = 0.95,
    created_at: datetime | None = None,
) -> None:
    """Writes the events of a run under ``path/events`` and its line of the history under ``path/history``.

    A run that is told again under its id, after a failure, replaces what it told before.
    """
    spark = done.exact.sparkSession
    question = spark.createDataFrame([(prompt, dataset_id, done.spec.name)], "prompt string, dataset_id string, answer string")
    if done.trace is None:
        nothing = spark.createDataFrame([], "iteration int, is_final boolean")
        answered = done.exact.limit(100 * MOST_GROUPS).select(F.to_json(F.struct("*")).alias("line"))
        events = runlog.event_log(session_id, question, done.verdict, nothing, answered.agg(F.collect_list("line").alias("rows")))
    else:
        progress = with_progress(done.trace, done.spec, done.integral, bool(done.spec.group_by))
        events = runlog.event_log(session_id, question, done.verdict, progress, done.comparison)
    runlog.write_events(events, f"{path}/events", session_id)
    runlog.append_run(
        spark, f"{path}/history", session_id, prompt, dataset_id, dataset_label,
        error_tolerance=target_error, confidence_level=confidence, created_at=created_at,
    )
