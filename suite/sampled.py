"""Sample ladder, random prefixes and progressive sums and means."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import AggregateSpec, Comparison
from plumbline.operators import adaptive, sampling
from plumbline.operators.exact import population
from suite import sql
from suite.registry import (
    CUSTOMER_ORDER,
    EVENTS_ORDER,
    LINEITEM_KEYS,
    LINEITEM_ORDER,
    ORDERS_ORDER,
    query,
    sized,
    table,
)

PRICE_SUM = AggregateSpec("sum", "l_extendedprice", scale=2)
PRICE_AVG = AggregateSpec("avg", "l_extendedprice", scale=2)
RETURNED = Comparison("l_returnflag", "=", "R")

_LINEITEM = ("lineitem", LINEITEM_KEYS)
_PRICE = {"tie": "l_extendedprice"}


def lineitem(spark, sf):
    df = table(spark, sf, "lineitem")
    return df, sized(LINEITEM_ORDER, df)


def orders(spark, sf):
    df = table(spark, sf, "orders")
    return df, sized(ORDERS_ORDER, df)


@query(
    "sample_ladder",
    f"""WITH RECURSIVE pop AS (SELECT count(*) AS n FROM lineitem), {sql.ladder("pop")}
        SELECT it AS iteration, size AS sample_rows, n AS population_rows FROM ladder""",
)
def sample_ladder(spark, sf):
    return sampling.ladder(population(table(spark, sf, "lineitem"), AggregateSpec("count")))


@query(
    "random_prefix",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
        FROM (SELECT *, row_number() OVER
                (ORDER BY {sql.priority(LINEITEM_KEYS)}, l_extendedprice) AS rk FROM lineitem)
        WHERE rk <= 1024""",
)
def random_prefix(spark, sf):
    df, order = lineitem(spark, sf)
    return sampling.draw(df.select(*order.columns), order, 1024)


@query(
    "random_prefix_steps",
    f"""WITH RECURSIVE base AS (SELECT o_orderkey,
              row_number() OVER (ORDER BY {sql.priority(("o_orderkey",))}) AS rk FROM orders),
        pop AS (SELECT count(*) AS n FROM orders), {sql.ladder("pop")}
        SELECT o_orderkey, CAST(min(it) AS INTEGER) AS step
        FROM base JOIN ladder ON rk <= size GROUP BY o_orderkey""",
)
def random_prefix_steps(spark, sf):
    df, order = orders(spark, sf)
    rows = sampling.sample_rows(df.select("o_orderkey"), order)
    return rows.select("o_orderkey", F.col(sampling.STEP).alias("step"))


def _moment_columns(grouped: bool) -> str:
    group = "g AS group_value, " if grouped else ""
    return f"""
SELECT it AS iteration, scanned AS scanned_rows, total AS total_rows, {group}
       n AS sample_rows, CAST(sy AS DOUBLE) AS sum_y, CAST(syy AS DOUBLE) AS sum_yy,
       CAST(sx AS BIGINT) AS sum_x, CAST(sx AS BIGINT) AS sum_xx, CAST(sy AS DOUBLE) AS sum_xy,
       pop_rows AS population_rows FROM moments"""


def _as_doubles(moments):
    for c in ("sum_y", "sum_yy", "sum_xy"):
        moments = moments.withColumn(c, F.col(c).cast("double"))
    return moments


@query(
    "sample_moments", sql.moments(*_LINEITEM, "l_extendedprice", **_PRICE) + _moment_columns(False)
)
def sample_moments(spark, sf):
    df, order = lineitem(spark, sf)
    return _as_doubles(sampling.step_moments(df, PRICE_SUM, order))


@query(
    "sample_moments_grouped",
    sql.moments(
        *_LINEITEM, "nullif(l_quantity, 1)", mean=True, group="l_returnflag", tie="l_extendedprice"
    )
    + _moment_columns(True),
)
def sample_moments_grouped(spark, sf):
    df, order = lineitem(spark, sf)
    df = df.withColumn("q", F.nullif("l_quantity", F.lit(1.0)))
    spec = AggregateSpec("avg", "q", group_by="l_returnflag", scale=2)
    return _as_doubles(sampling.step_moments(df, spec, order))


@query(
    "adaptive_sum_trace",
    sql.scalar_trace(0.05, *_LINEITEM, "l_extendedprice", **_PRICE) + sql.SCALAR_COLUMNS,
)
def adaptive_sum_trace(spark, sf):
    df, order = lineitem(spark, sf)
    return adaptive.adaptive_trace(df, PRICE_SUM, order, 0.05)


@query(
    "adaptive_sum_trace_tight",
    sql.scalar_trace(0.001, *_LINEITEM, "l_extendedprice", **_PRICE) + sql.SCALAR_COLUMNS,
)
def adaptive_sum_trace_tight(spark, sf):
    df, order = lineitem(spark, sf)
    return adaptive.adaptive_trace(df, PRICE_SUM, order, 0.001)


@query(
    "adaptive_avg_trace",
    sql.scalar_trace(0.01, *_LINEITEM, "l_extendedprice", mean=True, **_PRICE)
    + sql.SCALAR_COLUMNS,
)
def adaptive_avg_trace(spark, sf):
    df, order = lineitem(spark, sf)
    return adaptive.adaptive_trace(df, PRICE_AVG, order, 0.01)


@query(
    "adaptive_avg_with_nulls",
    sql.scalar_trace(
        0.01, *_LINEITEM, "nullif(l_quantity, 1)", mean=True, tie="l_extendedprice"
    )
    + sql.SCALAR_COLUMNS,
)
def adaptive_avg_with_nulls(spark, sf):
    df, order = lineitem(spark, sf)
    df = df.withColumn("q", F.nullif("l_quantity", F.lit(1.0)))
    return adaptive.adaptive_trace(df, AggregateSpec("avg", "q", scale=2), order, 0.01)


@query(
    "adaptive_sum_with_nulls",
    sql.scalar_trace(0.02, *_LINEITEM, "nullif(l_quantity, 1)", tie="l_extendedprice")
    + sql.SCALAR_COLUMNS,
)
def adaptive_sum_with_nulls(spark, sf):
    df, order = lineitem(spark, sf)
    df = df.withColumn("q", F.nullif("l_quantity", F.lit(1.0)))
    return adaptive.adaptive_trace(df, AggregateSpec("sum", "q", scale=2), order, 0.02)


@query(
    "adaptive_sum_small_table",
    sql.scalar_trace(0.0001, "customer", ("c_custkey",), "c_acctbal") + sql.SCALAR_COLUMNS,
)
def adaptive_sum_small_table(spark, sf):
    df = table(spark, sf, "customer")
    spec = AggregateSpec("sum", "c_acctbal", scale=2)
    return adaptive.adaptive_trace(df, spec, sized(CUSTOMER_ORDER, df), 0.0001)


@query(
    "filtered_sum_trace",
    sql.scalar_trace(
        0.02, *_LINEITEM, "l_extendedprice", where="l_returnflag = 'R'", **_PRICE
    )
    + sql.SCALAR_COLUMNS,
)
def filtered_sum_trace(spark, sf):
    df, order = lineitem(spark, sf)
    spec = AggregateSpec("sum", "l_extendedprice", (RETURNED,), scale=2)
    return adaptive.adaptive_trace(df, spec, order, 0.02)


@query(
    "filtered_avg_trace",
    sql.scalar_trace(
        0.02, "orders", ("o_orderkey",), "o_totalprice", mean=True, where="o_totalprice >= 100000"
    )
    + sql.SCALAR_COLUMNS,
)
def filtered_avg_trace(spark, sf):
    df, order = orders(spark, sf)
    spec = AggregateSpec(
        "avg", "o_totalprice", (Comparison("o_totalprice", ">=", 100000.0),), scale=2
    )
    return adaptive.adaptive_trace(df, spec, order, 0.02)


@query(
    "empty_population_trace",
    """SELECT 1 AS iteration, CAST(0 AS DOUBLE) AS estimate, CAST(0 AS DOUBLE) AS relative_error,
              CAST(NULL AS DOUBLE) AS ci_low, CAST(NULL AS DOUBLE) AS ci_high,
              count(*) AS sample_rows, count(*) AS total_rows, TRUE AS target_met,
              TRUE AS is_final, 'target_reached' AS stopped_reason
       FROM orders WHERE o_totalprice < 0""",
)
def empty_population_trace(spark, sf):
    df, order = orders(spark, sf)
    spec = AggregateSpec("sum", "o_totalprice", (Comparison("o_totalprice", "<", 0.0),), scale=2)
    return adaptive.adaptive_trace(df, spec, order)


def _count_trace(value: str, sample: str, source: str) -> str:
    return f"""SELECT 1 AS iteration, CAST(v AS DOUBLE) AS estimate,
        CAST(0 AS DOUBLE) AS relative_error, CAST(v AS DOUBLE) AS ci_low,
        CAST(v AS DOUBLE) AS ci_high, CAST({sample} AS BIGINT) AS sample_rows, v AS total_rows,
        TRUE AS target_met, TRUE AS is_final, 'target_reached' AS stopped_reason
      FROM (SELECT {value} AS v FROM {source})"""


@query("metadata_count", _count_trace("count(*)", "0", "lineitem"))
def metadata_count(spark, sf):
    return adaptive.count_trace_of(adaptive.footer_rows(spark, f"{sf}/lineitem.parquet"))


@query("filtered_count", _count_trace("count(*)", "v", "lineitem WHERE l_returnflag = 'R'"))
def filtered_count(spark, sf):
    df, order = lineitem(spark, sf)
    return adaptive.adaptive_trace(df, AggregateSpec("count", where=(RETURNED,)), order)


@query("column_count", _count_trace("count(nullif(l_quantity, 1))", "v", "lineitem"))
def column_count(spark, sf):
    df, order = lineitem(spark, sf)
    df = df.withColumn("q", F.nullif("l_quantity", F.lit(1.0)))
    return adaptive.adaptive_trace(df, AggregateSpec("count", "q"), order)


@query(
    "grouped_sum_trace",
    sql.scalar_trace(0.05, *_LINEITEM, "l_extendedprice", group="l_returnflag", **_PRICE)
    + sql.GROUPED_COLUMNS,
)
def grouped_sum_trace(spark, sf):
    df, order = lineitem(spark, sf)
    spec = AggregateSpec("sum", "l_extendedprice", group_by="l_returnflag", scale=2)
    return adaptive.grouped_trace(df, spec, order, 0.05)


@query(
    "grouped_avg_trace",
    sql.scalar_trace(
        0.03, "orders", ("o_orderkey",), "o_totalprice", mean=True, group="o_orderpriority"
    )
    + sql.GROUPED_COLUMNS,
)
def grouped_avg_trace(spark, sf):
    df, order = orders(spark, sf)
    spec = AggregateSpec("avg", "o_totalprice", group_by="o_orderpriority", scale=2)
    return adaptive.grouped_trace(df, spec, order, 0.03)


@query(
    "grouped_trace_null_group",
    sql.scalar_trace(
        0.02,
        *_LINEITEM,
        "nullif(l_quantity, 1)",
        group="nullif(l_linenumber, 1)",
        tie="l_extendedprice",
        where="l_linestatus = 'F'",
    )
    + sql.GROUPED_COLUMNS,
)
def grouped_trace_null_group(spark, sf):
    df, order = lineitem(spark, sf)
    df = df.withColumn("q", F.nullif("l_quantity", F.lit(1.0))).withColumn(
        "g", F.nullif("l_linenumber", F.lit(1))
    )
    where = (Comparison("l_linestatus", "=", "F"),)
    spec = AggregateSpec("sum", "q", where, group_by="g", scale=2)
    return adaptive.grouped_trace(df, spec, order, 0.02)


@query(
    "grouped_roll_up",
    sql.moments(*_LINEITEM, "l_extendedprice", group="l_linestatus", **_PRICE)
    + sql.estimates(False)
    + """ SELECT it AS iteration, max(err) AS overall_error, max(scanned) AS scanned_rows,
                 max(total) AS total_rows, count(*) AS group_count FROM est GROUP BY it""",
)
def grouped_roll_up(spark, sf):
    df, order = lineitem(spark, sf)
    spec = AggregateSpec("sum", "l_extendedprice", group_by="l_linestatus", scale=2)
    return adaptive.roll_up(adaptive.grouped_estimates(df, spec, order))


@query(
    "progress_measures",
    sql.scalar_trace(0.02, *_LINEITEM, "l_extendedprice", **_PRICE)
    + """ SELECT it AS iteration, round_even(estimate, 2) AS estimate,
             format('{:,.2f}', round_even(estimate, 2)) AS display_value,
             round_even(CAST(sample_rows AS DOUBLE) / total, 4) AS sample_fraction,
             round_even(CAST(sample_rows AS DOUBLE) / total * 100, 2) AS data_scanned_pct,
             round_even(greatest(0, 100 - round_even(CAST(sample_rows AS DOUBLE) / total * 100, 2)), 2)
               AS compute_saved_pct,
             CASE WHEN target_met THEN 'target_met' WHEN it = 1 THEN 'warming_up'
                  ELSE 'converging' END AS status FROM tr""",
)
def progress_measures(spark, sf):
    df, order = lineitem(spark, sf)
    trace = adaptive.adaptive_trace(df, PRICE_SUM, order, 0.02)
    return adaptive.with_progress(trace, PRICE_SUM).select(
        "iteration",
        "estimate",
        "display_value",
        "sample_fraction",
        "data_scanned_pct",
        "compute_saved_pct",
        "status",
    )


@query(
    "stratified_draw",
    f"""SELECT o_orderkey, o_orderpriority FROM (
          SELECT *, row_number() OVER (PARTITION BY o_orderpriority
                      ORDER BY {sql.priority(("o_orderkey",))}) AS rk FROM orders)
        WHERE rk <= 100""",
)
def stratified_draw(spark, sf):
    df, order = orders(spark, sf)
    rows = df.select("o_orderkey", "o_orderpriority")
    return sampling.draw_per_stratum(rows, order, "o_orderpriority", 100)


@query(
    "reservoir",
    f"""SELECT event_id, user_id, event_type, value FROM (
          SELECT *, row_number() OVER (ORDER BY {sql.priority(("event_id",))}) AS rk FROM events)
        WHERE rk <= 500""",
)
def reservoir(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return sampling.draw(df, sized(EVENTS_ORDER, df), 500)


@query(
    "reservoir_grouped",
    f"""SELECT event_id, event_type, value FROM (
          SELECT *, row_number() OVER (PARTITION BY event_type
                      ORDER BY {sql.priority(("event_id",))}) AS rk FROM events)
        WHERE rk <= 64""",
)
def reservoir_grouped(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "value")
    return sampling.draw_per_stratum(df, sized(EVENTS_ORDER, df), "event_type", 64)
