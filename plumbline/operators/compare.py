"""Approximate beside exact, and how a run converged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import display
from plumbline.functions.estimators import NEAR_ZERO
from plumbline.spec import AggregateSpec


def _delta_pct(delta: Column, exact: Column) -> Column:
    size = F.abs(exact)
    return F.when(size <= NEAR_ZERO, 0.0).otherwise(delta / F.nullif(size, F.lit(0.0)))


def compare_scalar(
    approx: DataFrame, exact: DataFrame, spec: AggregateSpec, integral: bool = False
) -> DataFrame:
    """``estimate`` of a final trace row beside the exact answer, as one row.

    The two one-row frames meet in an aggregate; no join is needed.
    """
    both = approx.select(
        F.col("estimate").cast("double").alias("approx"), F.lit(None).cast("double").alias("truth")
    ).unionByName(
        exact.select(
            F.lit(None).cast("double").alias("approx"),
            F.col(spec.name).cast("double").alias("truth"),
        )
    )
    return (
        both.agg(
            display.rounded(F.max("approx"), spec, integral).alias("estimate"),
            display.rounded(F.max("truth"), spec, integral).alias("exact_value"),
        )
        .withColumn("_delta", F.abs(F.col("exact_value") - F.col("estimate")))
        .select(
            "estimate",
            "exact_value",
            display.display(F.col("estimate"), spec, integral).alias("approx_display_value"),
            display.display(F.col("exact_value"), spec, integral).alias("exact_display_value"),
            display.rounded(F.col("_delta"), spec, integral).alias("delta"),
            F.bround(_delta_pct(F.col("_delta"), F.col("exact_value")), 6).alias("delta_pct"),
        )
    )


def _grouped_deltas(
    approx: DataFrame, exact: DataFrame, spec: AggregateSpec, integral: bool
) -> DataFrame:
    # groups meet by value, so that no value and the text NULL stay apart; labels come after
    approx_side = approx.select(
        F.col("group_value").cast("string").alias("_met"),
        display.rounded(F.col("estimate"), spec, integral).alias("approx_estimate"),
    )
    truth = F.coalesce(F.col(spec.name).cast("double"), F.lit(0.0))
    exact_side = exact.select(
        F.col(spec.group_by).cast("string").alias("_group"),
        display.rounded(truth, spec, integral).alias("exact_value"),
    )
    return (
        exact_side.join(approx_side, F.col("_group").eqNullSafe(F.col("_met")), "left")
        .withColumn("group_value", display.group_label(F.col("_group")))
        .withColumn("approx_estimate", F.coalesce("approx_estimate", F.lit(0.0)))
        .withColumn("_delta", F.abs(F.col("exact_value") - F.col("approx_estimate")))
        .withColumn("_delta_pct", _delta_pct(F.col("_delta"), F.col("exact_value")))
    )


def compare_grouped(
    approx: DataFrame, exact: DataFrame, spec: AggregateSpec, integral: bool = False
) -> DataFrame:
    """One row per exact group; a group that the sample never met has estimate 0."""
    return _grouped_deltas(approx, exact, spec, integral).select(
        "group_value",
        "approx_estimate",
        display.display(F.col("approx_estimate"), spec, integral).alias("approx_display_value"),
        "exact_value",
        display.display(F.col("exact_value"), spec, integral).alias("exact_display_value"),
        display.rounded(F.col("_delta"), spec, integral).alias("delta"),
        F.bround("_delta_pct", 6).alias("delta_pct"),
    )


def delta_roll_up(
    approx: DataFrame, exact: DataFrame, spec: AggregateSpec, integral: bool = False
) -> DataFrame:
    """Largest and mean deviation over the groups; 0 when there are none."""
    return _grouped_deltas(approx, exact, spec, integral).agg(
        F.count(F.lit(1)).alias("group_count"),
        F.bround(F.coalesce(F.max("_delta_pct"), F.lit(0.0)), 6).alias("max_delta_pct"),
        F.bround(F.coalesce(F.avg("_delta_pct"), F.lit(0.0)), 6).alias("mean_delta_pct"),
    )


def speedup(exact_ms: Column, approx_ms: Column) -> Column:
    """Exact over approximate latency; 0 when the approximate one was not measured."""
    ratio = exact_ms.cast("double") / F.nullif(approx_ms.cast("double"), F.lit(0.0))
    return F.when(approx_ms > 0, F.bround(ratio, 2)).otherwise(0.0)


def convergence(progress: DataFrame) -> DataFrame:
    """(iteration, scanned share, error) of a trace with progress columns."""
    error = "overall_error" if "overall_error" in progress.columns else "relative_error"
    elapsed = ["elapsed_ms"] if "elapsed_ms" in progress.columns else []
    points = progress.select(
        "iteration", "data_scanned_pct", F.bround(error, 6).alias("relative_error"), *elapsed
    )
    return points.distinct() if "group_value" in progress.columns else points


def first_points(points: DataFrame, run: tuple[str, ...] = (), arrival: str = "sequence") -> DataFrame:
    """The first point to arrive of every (run, iteration), its error in per cent."""
    earliest_first = Window.partitionBy(*run, "iteration").orderBy(arrival)
    return (
        points.withColumn("_nth", F.row_number().over(earliest_first))
        .where(F.col("_nth") == 1)
        .drop("_nth")
        .withColumn("relative_error", F.col("relative_error") * 100)
    )


def milestones(
    points: DataFrame, thresholds: list[float], run: tuple[str, ...] = (), error: str = "relative_error"
) -> DataFrame:
    """Per run and threshold the first iteration whose error is no larger; NULL if unmet.

    All thresholds are answered in one aggregate over the points, without a join.
    """
    wanted = sorted(set(thresholds))
    firsts = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.min(F.when(F.col(error) <= t, F.col("iteration"))).alias("first_iteration"),
        )
        for t in wanted
    ]
    return (
        points.groupBy(*run)
        .agg(F.array(*firsts).alias("_met"))
        .select(*run, F.inline("_met"))
    )


def replay(trace: DataFrame, tolerances: list[float], error: str = "relative_error") -> DataFrame:
    """A stored trace judged anew under every tolerance.

    A status that was only ``target_met`` under the old target becomes ``converging``; the last
    step is either ``target_met`` or ``converging``.
    """
    again = trace.withColumn(
        "tolerance", F.explode(F.array(*[F.lit(float(t)) for t in sorted(set(tolerances))]))
    ).withColumn("target_met", F.col(error) <= F.col("tolerance"))
    demoted = F.when(F.col("is_final") | (F.col("status") == "target_met"), "converging")
    return again.withColumn(
        "status",
        F.when(F.col("target_met"), "target_met").otherwise(F.coalesce(demoted, F.col("status"))),
    )
