"""Which way to answer: sample, sketch or exact, from the sizes of the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.exact import population, strata_profile
from plumbline.spec import AggregateSpec

# The most groups, and the fewest filtered rows, of a grouped approximation.
MOST_GROUPS = 16
FEWEST_ROWS = 5_000


def choose_method(
    df: DataFrame,
    spec: AggregateSpec,
    most_groups: int = MOST_GROUPS,
    fewest_rows: int = FEWEST_ROWS,
) -> DataFrame:
    """One row: ``method``, ``reason``, ``group_count``, ``filtered_rows``.

    Methods: ``adaptive_sampling``, ``stratified_sampling``, ``hyperloglog``, ``exact``. More than
    ``most_groups`` groups, or sums and means over fewer than ``fewest_rows`` filtered rows, are
    answered exactly.
    """
    if spec.group_by is None:
        sizes = population(df, spec).select(
            F.lit(0).cast("long").alias("group_count"), F.col("population_rows").alias("filtered_rows")
        )
    else:
        sizes = strata_profile(df, spec).agg(
            F.count(F.lit(1)).alias("group_count"),
            F.coalesce(F.sum("population_rows"), F.lit(0)).alias("filtered_rows"),
        )
    return verdict(sizes, spec, most_groups, fewest_rows)


def verdict(
    sizes: DataFrame,
    spec: AggregateSpec,
    most_groups: int = MOST_GROUPS,
    fewest_rows: int = FEWEST_ROWS,
) -> DataFrame:
    """``choose_method`` for known sizes: a row of ``group_count`` and ``filtered_rows``."""
    if spec.group_by is None:
        method, reason = (
            ("hyperloglog", "distinct counts use registers")
            if spec.distinct
            else ("adaptive_sampling", "no groups")
        )
        return sizes.select(
            F.lit(method).alias("method"), F.lit(reason).alias("reason"), "group_count", "filtered_rows"
        )
    obstacles = [
        (F.lit(spec.agg == "count" and not spec.distinct), "grouped counts are answered exactly"),
        (F.col("group_count") == 0, "no rows pass the filters"),
        (F.col("group_count") > most_groups, f"more than {most_groups} groups"),
        (
            F.lit(not spec.distinct) & (F.col("filtered_rows") < fewest_rows),
            f"fewer than {fewest_rows} filtered rows",
        ),
    ]
    obstacle = F.coalesce(*[F.when(holds, F.lit(text)) for holds, text in obstacles])
    approximate = "hyperloglog" if spec.distinct else "stratified_sampling"
    return sizes.select(
        F.when(obstacle.isNull(), approximate).otherwise("exact").alias("method"),
        F.coalesce(obstacle, F.lit("groups are few and large enough")).alias("reason"),
        "group_count",
        "filtered_rows",
    )
