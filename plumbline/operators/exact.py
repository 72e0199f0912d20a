"""Exact answers: counts, sums, means and distinct counts, overall or per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.display import group_label
from plumbline.functions.numbers import exact_total
from plumbline.spec import AggregateSpec


def aggregate_column(spec: AggregateSpec) -> Column:
    """The aggregate; a sum or mean of nothing is 0."""
    if spec.agg == "count":
        if spec.distinct:
            return F.countDistinct(spec.column)
        return F.count(F.lit(1) if spec.column is None else F.col(spec.column))
    total = exact_total(spec.column, spec.scale)
    if spec.agg == "sum":
        return F.coalesce(total, F.lit(0.0))
    # from sum and count, so that a decimal mean keeps every digit
    count = F.nullif(F.count(spec.column), F.lit(0))
    return F.coalesce(total / count, F.lit(0.0))


def exact(df: DataFrame, spec: AggregateSpec) -> DataFrame:
    """One row named after the spec, or one row per group (NULL is a group)."""
    rows = spec.projected(df)
    if spec.group_by is None:
        return rows.agg(aggregate_column(spec).alias(spec.name))
    return rows.groupBy(spec.group_by).agg(aggregate_column(spec).alias(spec.name))


def ordered(answer: DataFrame, spec: AggregateSpec, value: str | None = None) -> DataFrame:
    """Grouped answer in the order asked for; by label text when none was asked for."""
    if spec.group_by is None:
        return answer
    by_value = spec.order_by is not None and spec.order_by != spec.group_by
    label = group_label(F.col(spec.group_by))
    key = F.col(value or spec.name) if by_value else label
    # labels settle equal values, so that the order is the same in every run
    return answer.orderBy(key.desc() if spec.descending else key.asc(), label.asc())


def population(df: DataFrame, spec: AggregateSpec) -> DataFrame:
    """Rows that pass the filters, as one row ``population_rows``.

    Without filters no column is read: Spark takes the row counts of the Parquet footers.
    """
    return spec.filtered(df).agg(F.count(F.lit(1)).alias("population_rows"))


def strata_profile(df: DataFrame, spec: AggregateSpec) -> DataFrame:
    """``group_value``, ``population_rows`` of every group after the filters, unordered."""
    if spec.group_by is None:
        raise ValueError("a strata profile needs a group column")
    return (
        spec.projected(df)
        .groupBy(F.col(spec.group_by).alias("group_value"))
        .agg(F.count(F.lit(1)).alias("population_rows"))
    )


def largest_first(profile: DataFrame) -> DataFrame:
    return profile.orderBy(
        F.col("population_rows").desc(), group_label(F.col("group_value")).asc()
    )
