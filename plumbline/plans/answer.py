"""From a question to approximate, exact and compared answers."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.functions.order import SampleOrder
from plumbline.operators.adaptive import adaptive_trace, final_answer, grouped_trace
from plumbline.operators.compare import compare_grouped, compare_scalar
from plumbline.operators.exact import exact, ordered
from plumbline.operators.method import choose_method
from plumbline.operators.sketch import distinct_trace, grouped_distinct_trace
from plumbline.spec import AggregateSpec


@dataclass(frozen=True)
class Answer:
    """Lazy frames of a question; ``trace`` and ``comparison`` are None if answered exactly."""

    spec: AggregateSpec
    method: str
    reason: str
    trace: DataFrame | None
    exact: DataFrame
    comparison: DataFrame | None


def answer(
    df: DataFrame,
    spec: AggregateSpec,
    order: SampleOrder,
    target_error: float = 0.05,
    confidence: float = 0.95,
    integral: bool = False,
) -> Answer:
    """Chooses the method from the group sizes (one row), then builds the frames.

    A question that cannot be approximated is answered exactly, with the reason.
    """
    verdict = choose_method(df, spec).first()
    sized = order.for_rows(verdict["filtered_rows"])
    exact_frame = ordered(exact(df, spec), spec)
    method = verdict["method"]
    if method == "exact":
        return Answer(spec, method, verdict["reason"], None, exact_frame, None)
    if method == "hyperloglog":
        build = grouped_distinct_trace if spec.group_by else distinct_trace
        trace = build(df, spec, target_error)
    elif method == "stratified_sampling":
        trace = grouped_trace(df, spec, sized, target_error, confidence)
    else:
        trace = adaptive_trace(df, spec, sized, target_error, confidence)
    compare = compare_grouped if spec.group_by else compare_scalar
    comparison = compare(final_answer(trace), exact(df, spec), spec, integral)
    return Answer(spec, method, verdict["reason"], trace, exact_frame, comparison)


def timed(df: DataFrame) -> float:
    """Milliseconds to compute every row of a frame, on the executors."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) * 1000
