"""Progressive answers: one row per sample step, until the error target is met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import display
from plumbline.functions.estimators import MEAN, SUMS, TOTAL, interval
from plumbline.functions.order import SampleOrder
from plumbline.operators.exact import aggregate_column
from plumbline.operators.sampling import step_moments
from plumbline.spec import AggregateSpec


def with_estimates(sums: DataFrame, spec: AggregateSpec, confidence: float) -> DataFrame:
    """Adds ``estimate``, ``relative_error``, ``ci_low`` and ``ci_high`` to sample sums."""
    estimator = MEAN if spec.agg == "avg" else TOTAL
    worked = sums.selectExpr("*", *SUMS, *estimator, *interval(confidence))
    return worked.select(*sums.columns, "estimate", "relative_error", "ci_low", "ci_high")


def _until_met(levels: DataFrame, target_error: float) -> DataFrame:
    """Keeps the steps up to the first that meets the target; names the reason to stop.

    ``levels`` has ``iteration`` and ``overall_error``. There are at most about 65 steps, so the
    window over all of them is small.
    """
    if not 0 < target_error <= 0.5:
        raise ValueError("target error must lie in (0, 0.5]")
    return (
        levels.selectExpr(
            "*",
            f"overall_error <= {target_error!r}D as target_met",
            f"min(case when overall_error <= {target_error!r}D then iteration end) over () as met_at",
            "max(iteration) over () as last",
        )
        .where("iteration <= coalesce(met_at, last)")
        .selectExpr(
            *levels.columns,
            "target_met",
            "iteration = coalesce(met_at, last) as is_final",
            "case when not is_final then null when target_met then 'target_reached' "
            "else 'sample_cap' end as stopped_reason",
        )
    )


def adaptive_trace(
    df: DataFrame,
    spec: AggregateSpec,
    order: SampleOrder,
    target_error: float = 0.05,
    confidence: float = 0.95,
) -> DataFrame:
    """Growing-sample estimates of a sum or mean; counts come exact in a single step.

    One pass over the table computes every step, so the trace says how many rows an answer
    *uses*. To read no more rows than that, run over a sample layout (``plans.progressive``).
    """
    if spec.group_by is not None:
        raise ValueError("use grouped_trace for a grouped question")
    if spec.agg == "count":
        return exact_count_trace(df, spec)
    levels = with_estimates(step_moments(df, spec, order), spec, confidence)
    return _until_met(levels.selectExpr("*", "relative_error as overall_error"), target_error).select(
        "iteration",
        "estimate",
        "relative_error",
        "ci_low",
        "ci_high",
        "sample_rows",
        "total_rows",
        "target_met",
        "is_final",
        "stopped_reason",
    )


def footer_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of Parquet files as one row ``row_count``, pushed down to the footers: no data is read.

    The plan belongs to a session of its own, which reads Parquet through the source that aggregates are
    pushed to, so that other queries are planned as before.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(*paths).agg(F.count(F.lit(1)).alias("row_count"))


def count_trace_of(rows: DataFrame) -> DataFrame:
    """The trace of a ``COUNT(*)`` that is known: one step without rows or error. ``rows`` is ``row_count``."""
    count = F.col("row_count")
    return rows.select(
        F.lit(1).alias("iteration"),
        count.cast("double").alias("estimate"),
        F.lit(0.0).alias("relative_error"),
        count.cast("double").alias("ci_low"),
        count.cast("double").alias("ci_high"),
        F.lit(0).cast("long").alias("sample_rows"),
        count.alias("total_rows"),
        F.lit(True).alias("target_met"),
        F.lit(True).alias("is_final"),
        F.lit("target_reached").alias("stopped_reason"),
    )


def exact_count_trace(df: DataFrame, spec: AggregateSpec) -> DataFrame:
    """A count as a one-step trace without error.

    ``COUNT(*)`` of an unfiltered table uses no column and no rows; any other count reads what it
    counts. For a table of Parquet files ``footer_rows`` answers from the footers alone.
    """
    from_metadata = spec.column is None and not spec.where
    counted = spec.filtered(df).agg(aggregate_column(spec).cast("double").alias("estimate"))
    rows = F.col("estimate").cast("long")
    total = rows if from_metadata else F.greatest(F.lit(1).cast("long"), rows)
    return counted.select(
        F.lit(1).alias("iteration"),
        "estimate",
        F.lit(0.0).alias("relative_error"),
        F.col("estimate").alias("ci_low"),
        F.col("estimate").alias("ci_high"),
        (F.lit(0).cast("long") if from_metadata else total).alias("sample_rows"),
        total.alias("total_rows"),
        F.lit(True).alias("target_met"),
        F.lit(True).alias("is_final"),
        F.lit("target_reached").alias("stopped_reason"),
    )


def grouped_estimates(
    df: DataFrame, spec: AggregateSpec, order: SampleOrder, confidence: float = 0.95
) -> DataFrame:
    """Every step and group of one shared sample, each group with its own known size."""
    if spec.group_by is None:
        raise ValueError("name a group column")
    return with_estimates(step_moments(df, spec, order), spec, confidence)


def roll_up(estimates: DataFrame) -> DataFrame:
    """Per step the error of the worst group; a group not seen yet counts as 1."""
    return estimates.groupBy("iteration").agg(
        F.max("relative_error").alias("overall_error"),
        F.max("scanned_rows").alias("scanned_rows"),
        F.max("total_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("group_count"),
    )


def grouped_trace(
    df: DataFrame,
    spec: AggregateSpec,
    order: SampleOrder,
    target_error: float = 0.05,
    confidence: float = 0.95,
) -> DataFrame:
    """Per step and group the estimate; stops when the worst group meets the target."""
    estimates = grouped_estimates(df, spec, order, confidence)
    # At most about 65 steps, so this side is small however many groups there are. Both sides
    # read the same columns of the sums, which Spark therefore computes once.
    stops = _until_met(roll_up(estimates).drop("group_count", "total_rows"), target_error)
    return (
        estimates.drop("scanned_rows")
        .join(F.broadcast(stops), "iteration")
        .select(
            "iteration",
            "group_value",
            "estimate",
            "relative_error",
            "ci_low",
            "ci_high",
            "sample_rows",
            "population_rows",
            "scanned_rows",
            "total_rows",
            "overall_error",
            "target_met",
            "is_final",
            "stopped_reason",
        )
    )


def with_progress(
    trace: DataFrame, spec: AggregateSpec, integral: bool = False, grouped: bool = False
) -> DataFrame:
    """Adds rounded estimate, display text, share of rows used and status to a trace."""
    used = F.col("scanned_rows" if grouped else "sample_rows")
    total = F.col("total_rows")
    shown = display.rounded(F.col("estimate"), spec, integral)
    return (
        trace.withColumn("estimate", shown)
        .withColumn("display_value", display.display(F.col("estimate"), spec, integral))
        .withColumn("sample_fraction", display.sample_fraction(used, total))
        .withColumn("data_scanned_pct", display.scanned_pct(used, total))
        .withColumn("compute_saved_pct", display.saved_pct(F.col("data_scanned_pct")))
        .withColumn("status", display.status(F.col("target_met"), F.col("iteration")))
    )


def final_answer(trace: DataFrame) -> DataFrame:
    """The rows of the last step."""
    return trace.where(F.col("is_final"))
