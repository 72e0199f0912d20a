"""Approximate distinct counts from HyperLogLog registers kept as plain rows.

A register is a row (group, index, rank), so building is a ``max`` with partial aggregation on
the map side, merging is another ``max``, and a stored sketch is an ordinary table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import registers as hll
from plumbline.spec import AggregateSpec


def registers(
    df: DataFrame, column: str, by: tuple[str, ...] = (), precision: int = 11, method: str = "xxhash64"
) -> DataFrame:
    """``by`` columns, ``register_index``, ``register_rank`` of the non-empty registers."""
    value = F.col(column)
    index, rank = hll.register_and_rank(value, precision, method)
    return (
        df.where(value.isNotNull())
        .groupBy(*by, index.alias("register_index"))
        .agg(F.max(rank).alias("register_rank"))
    )


def merge(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Union of stored sketches, kept apart by ``by``."""
    return sketches.groupBy(*by, "register_index").agg(
        F.max("register_rank").alias("register_rank")
    )


def cardinality(sketches: DataFrame, precision: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` columns and ``estimate``; without ``by`` always one row."""
    harmonic = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("register_rank"))), F.lit(0.0))
    return sketches.groupBy(*by).agg(
        hll.estimate(harmonic, F.count(F.lit(1)), precision).alias("estimate")
    )


def _verdict(target_error: float, precision: int) -> dict:
    error = hll.standard_error(precision)
    met = error <= target_error
    return {
        "iteration": F.lit(1),
        "relative_error": F.lit(error),
        "target_met": F.lit(met),
        "is_final": F.lit(True),
        "stopped_reason": F.lit("target_reached" if met else "sample_cap"),
    }


def distinct_trace(
    df: DataFrame, spec: AggregateSpec, target_error: float = 0.05, method: str = "xxhash64"
) -> DataFrame:
    """One-step trace of a distinct count; the error is one standard error of the sketch.

    ``sample_rows`` and ``total_rows`` are the rows of the whole table, filtered or not.
    """
    p = hll.precision_for(target_error)
    filtered = registers(spec.filtered(df), spec.column, (), p, method)
    total = df.agg(F.count(F.lit(1))).scalar()
    verdict = _verdict(target_error, p)
    # an empty table is known exactly
    nothing = F.col("total_rows") == 0
    return (
        cardinality(filtered, p)
        .withColumn("total_rows", total)
        .select(
            verdict["iteration"].alias("iteration"),
            "estimate",
            F.when(nothing, 0.0).otherwise(verdict["relative_error"]).alias("relative_error"),
            F.col("total_rows").alias("sample_rows"),
            "total_rows",
            (nothing | verdict["target_met"]).alias("target_met"),
            verdict["is_final"].alias("is_final"),
            F.when(nothing, "target_reached")
            .otherwise(verdict["stopped_reason"])
            .alias("stopped_reason"),
        )
    )


def grouped_distinct_trace(
    df: DataFrame, spec: AggregateSpec, target_error: float = 0.05, method: str = "xxhash64"
) -> DataFrame:
    """Distinct count per group; a group whose values are all NULL counts 0.

    One scan: rows of a group are counted per register, with NULL values in a register of
    their own, and the group sizes are summed from there.
    """
    p = hll.precision_for(target_error)
    index, rank = hll.register_and_rank(F.col(spec.column), p, method)
    has_value = F.col(spec.column).isNotNull()
    cells = (
        spec.projected(df)
        .groupBy(
            F.col(spec.group_by).alias("group_value"), F.when(has_value, index).alias("register_index")
        )
        .agg(F.max(F.when(has_value, rank)).alias("register_rank"), F.count(F.lit(1)).alias("rows"))
    )
    harmonic = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("register_rank"))), F.lit(0.0))
    verdict = _verdict(target_error, p)
    return (
        cells.groupBy("group_value")
        .agg(
            hll.estimate(harmonic, F.count("register_rank"), p).alias("estimate"),
            F.sum("rows").alias("population_rows"),
        )
        .select(
            verdict["iteration"].alias("iteration"),
            "group_value",
            "estimate",
            verdict["relative_error"].alias("relative_error"),
            F.col("population_rows").alias("sample_rows"),
            "population_rows",
            verdict["target_met"].alias("target_met"),
            verdict["is_final"].alias("is_final"),
            verdict["stopped_reason"].alias("stopped_reason"),
        )
    )


def builtin_sketches(df: DataFrame, column: str, by: tuple[str, ...] = (), precision: int = 12) -> DataFrame:
    """Spark's own binary sketches, one per ``by`` value; merge with ``builtin_distinct``."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, precision).alias("sketch"))


def builtin_distinct(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return sketches.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")
    )
