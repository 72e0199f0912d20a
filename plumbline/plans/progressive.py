"""Approximate answers that stop reading: a few jobs over the steps of a sample layout."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from plumbline.operators.adaptive import with_estimates
from plumbline.operators.method import MOST_GROUPS
from plumbline.operators.sampling import STEP, SUM_COLUMNS, first_sums, value_columns
from plumbline.plans.scans import Scanned, collected
from plumbline.sources.layout import SampleLayout
from plumbline.spec import AggregateSpec

#: the first job reads the steps of up to 2,048 rows, the second up to 16,384, later ones a step
SHARED_READ_ROWS = (2_048, 16_384)


@dataclass(frozen=True)
class StepResult:
    """Where a run stands after a step; ``estimates`` has one row per group, or just one.

    Groups are named by their value as text, and None where there is none.

    Files and bytes are those that all jobs so far have opened, that for the group sizes included, as
    their executed plans report them.
    """

    iteration: int
    estimates: tuple[Row, ...]
    overall_error: float
    sample_rows: int
    total_rows: int
    files_read: int
    bytes_read: int
    bytes_total: int
    target_met: bool
    is_final: bool
    stopped_reason: str | None
    elapsed_ms: float


def group_sizes(layout: SampleLayout, spec: AggregateSpec) -> tuple[dict[str | None, int], Scanned]:
    """Filtered rows of every group, and what was opened to count them.

    They come from the statistics of the layout where it has them; else the filter and group columns of
    all steps are read.
    """
    known = layout.sizes(spec)
    if known is not None:
        return known, Scanned()
    label = F.col(spec.group_by).cast("string") if spec.group_by else F.lit(None).cast("string")
    counted = spec.filtered(layout.frame).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # one more than allowed is enough to refuse
    lines, opened = collected(counted.limit(MOST_GROUPS + 1))
    sizes = {r["label"]: r["n"] for r in lines}
    return sizes if spec.group_by or sizes else {None: 0}, opened


def _chunks(layout: SampleLayout) -> list[list[int]]:
    """Steps by the job that reads them: small steps share a job, large ones have their own."""
    chunks: list[list[int]] = []
    rows, limits = 0, list(SHARED_READ_ROWS)
    for step in layout.sampled:
        rows += layout.steps[step]["rows"]
        fresh = not chunks or not limits or rows > limits[0]
        while limits and rows > limits[0]:
            limits.pop(0)
        if fresh:
            chunks.append([])
        chunks[-1].append(step)
    return chunks


def _sum_types(spec: AggregateSpec) -> dict[str, str]:
    whole, scale = "bigint", spec.scale
    kinds = ("double", "double") if scale is None else (
        f"decimal(38,{scale})", f"decimal(38,{2 * scale})",
    )
    return dict(zip(SUM_COLUMNS, (whole, *kinds, whole)))


def _estimates(
    layout: SampleLayout,
    spec: AggregateSpec,
    chunk: list[int],
    sizes: dict,
    before: dict,
    confidence: float,
) -> tuple[list[Row], Scanned]:
    """Estimates and running sums after each step of the chunk, in one job, and what it opened.

    ``before`` has the sums of the steps read earlier. They join the new sums as one line per
    step and group, at most 65 x 16, so that no combination is missing.
    """
    frame, labels, types = layout.frame, list(sizes), _sum_types(spec)
    drawn = spec.projected(frame.where(F.col(STEP).isin(chunk)), STEP)
    if spec.group_by:
        label = F.col(spec.group_by).cast("string")
        known = F.array_position(F.array(*map(F.lit, labels)).cast("array<string>"), label) - 1
        absent = labels.index(None) if None in labels else -1
        at = F.when(label.isNull(), absent).otherwise(known).cast("int").alias("at")
    else:
        at = F.lit(0).alias("at")
    values = drawn.select(F.col(STEP).alias("step"), at, *[F.expr(v) for v in value_columns(spec)])
    new = values.groupBy("step", "at").agg(*first_sums())
    new = new.selectExpr(
        "step", "at", *[f"cast({c} as {t}) as {c}" for c, t in types.items()], "0L as population_rows"
    )
    lines = []
    for step in chunk:
        for place, label in enumerate(labels):
            sums = before[label] if step == chunk[0] else [0] * len(types)
            cells = [f"cast('{v}' as {t}) as {c}" for v, (c, t) in zip(sums, types.items())]
            lines.append(
                f"struct({step} as step, {place} as at, {', '.join(cells)}, "
                f"{sizes[label]}L as population_rows)"
            )
    known = frame.sparkSession.range(0, 1, 1, 1).selectExpr(f"inline(array({', '.join(lines)}))")
    running = "over (partition by at order by step) as"
    summed = (
        new.unionByName(known)
        .groupBy("step", "at")
        .agg(*[F.expr(f"sum({c}) as {c}") for c in (*SUM_COLUMNS, "population_rows")])
        .selectExpr("step", "at", *[f"sum({c}) {running} {c}" for c in SUM_COLUMNS], "population_rows")
        .selectExpr("*", "sum_x as sum_xx", "sum_y as sum_xy")
    )
    rows, opened = collected(with_estimates(summed, spec, confidence))
    return sorted(rows, key=lambda r: (r["step"], r["at"])), opened


def progressive(
    layout: SampleLayout,
    spec: AggregateSpec,
    target_error: float = 0.05,
    confidence: float = 0.95,
    sizes: dict[str | None, int] | None = None,
    opened: Scanned = Scanned(),
    began: float | None = None,
) -> Iterator[StepResult]:
    """Reads more steps of the layout until the error target is met.

    Yields after every step, so a caller can show progress or leave early. The steps are those
    of the layout: with filters a step has fewer rows, still a simple random sample of the
    filtered table. Only sums of at most 16 groups come to the driver. ``sizes`` are the group sizes of
    ``group_sizes``, if the caller has them, ``opened`` what was opened for them and ``began`` when.
    """
    if not spec.is_approximable_total:
        raise ValueError("only sum and avg are sampled; counts are answered exactly")
    began = time.perf_counter() if began is None else began
    if sizes is None:
        sizes, opened = group_sizes(layout, spec)
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: answer exactly instead")
    labels, total = list(sizes), sum(sizes.values())
    sums = {label: [0] * len(SUM_COLUMNS) for label in sizes}
    for chunk in _chunks(layout) if sizes else []:
        lines, scanned = _estimates(layout, spec, chunk, sizes, sums, confidence)
        opened += scanned
        for step in chunk:
            estimates = tuple(
                Row(
                    group_value=labels[e["at"]],
                    estimate=e["estimate"],
                    relative_error=e["relative_error"],
                    ci_low=e["ci_low"],
                    ci_high=e["ci_high"],
                    sample_rows=e["sample_rows"],
                    population_rows=e["population_rows"],
                )
                for e in lines
                if e["step"] == step
            )
            worst = max(e["relative_error"] for e in estimates)
            met = worst <= target_error
            last = met or step == layout.sampled[-1]
            yield StepResult(
                iteration=layout.sampled.index(step) + 1,
                estimates=estimates,
                overall_error=worst,
                sample_rows=sum(e["sample_rows"] for e in estimates),
                total_rows=total,
                files_read=opened.files,
                bytes_read=opened.bytes,
                bytes_total=sum(s["bytes"] for s in layout.steps.values()),
                target_met=met,
                is_final=last,
                stopped_reason=("target_reached" if met else "sample_cap") if last else None,
                elapsed_ms=(time.perf_counter() - began) * 1000,
            )
            if last:
                return
        sums = {
            labels[e["at"]]: [e[c] for c in SUM_COLUMNS] for e in lines if e["step"] == chunk[-1]
        }


_TRACE = (
    "iteration int, group_value string, estimate double, relative_error double, ci_low double, "
    "ci_high double, sample_rows long, population_rows long, overall_error double, "
    "scanned_rows long, total_rows long, files_read long, bytes_read long, bytes_total long, "
    "target_met boolean, is_final boolean, stopped_reason string, elapsed_ms double"
)


def progressive_trace(
    layout: SampleLayout,
    spec: AggregateSpec,
    target_error: float = 0.05,
    confidence: float = 0.95,
) -> DataFrame:
    """The whole run as a frame: one row per step (and group)."""
    return as_trace(layout, spec, list(progressive(layout, spec, target_error, confidence)))


def as_trace(layout: SampleLayout, spec: AggregateSpec, results: list[StepResult]) -> DataFrame:
    """The steps of a run as a frame."""
    rows = [
        (
            r.iteration, e["group_value"], e["estimate"], e["relative_error"],
            e["ci_low"], e["ci_high"], e["sample_rows"], e["population_rows"], r.overall_error,
            r.sample_rows, r.total_rows, r.files_read, r.bytes_read, r.bytes_total, r.target_met,
            r.is_final, r.stopped_reason, r.elapsed_ms,
        )
        for r in results
        for e in r.estimates
    ]
    trace = layout.frame.sparkSession.createDataFrame(rows, _TRACE)
    return trace if spec.group_by else trace.drop("group_value", "scanned_rows", "overall_error")
