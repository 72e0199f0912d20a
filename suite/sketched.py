"""Distinct counts from registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import AggregateSpec, Comparison
from plumbline.functions.registers import precision_for, standard_error
from plumbline.operators import sketch
from suite import sql
from suite.registry import query, table

def _six_digits(df):
    """Estimates to six decimals: the last bit of a logarithm depends on the engine."""
    return df.withColumn("estimate", F.round("estimate", 6))


CUSTOMERS = AggregateSpec("count", "o_custkey", distinct=True)
USERS_BY_TYPE = AggregateSpec("count", "user_id", group_by="event_type", distinct=True)
P = precision_for(0.05)
_HARMONIC = "CAST(coalesce(sum(pow(CAST(2 AS DOUBLE), -rnk)), 0) AS DOUBLE)"


@query(
    "hll_registers",
    f"""WITH {sql.hll_registers("orders", "o_custkey", P)}
        SELECT idx AS register_index, rnk AS register_rank FROM regs""",
)
def hll_registers(spark, sf):
    return sketch.registers(table(spark, sf, "orders"), "o_custkey", (), P, "md5")


def _distinct_sql(table_name: str, column: str, target: float, where: str = "TRUE") -> str:
    p = precision_for(target)
    return f"""WITH {sql.hll_registers(table_name, column, p, where=where)}
      SELECT 1 AS iteration, {sql.hll_estimate(_HARMONIC, "count(*)", p)} AS estimate,
             CAST({standard_error(p)!r} AS DOUBLE) AS relative_error,
             (SELECT count(*) FROM {table_name}) AS sample_rows,
             (SELECT count(*) FROM {table_name}) AS total_rows,
             {str(standard_error(p) <= target).lower()} AS target_met, TRUE AS is_final,
             '{"target_reached" if standard_error(p) <= target else "sample_cap"}' AS stopped_reason
      FROM regs"""


@query("hll_distinct", _distinct_sql("orders", "o_custkey", 0.05))
def hll_distinct(spark, sf):
    return _six_digits(sketch.distinct_trace(table(spark, sf, "orders"), CUSTOMERS, 0.05, "md5"))


@query("hll_distinct_coarse", _distinct_sql("lineitem", "l_orderkey", 0.2))
def hll_distinct_coarse(spark, sf):
    spec = AggregateSpec("count", "l_orderkey", distinct=True)
    return _six_digits(sketch.distinct_trace(table(spark, sf, "lineitem"), spec, 0.2, "md5"))


@query("hll_distinct_clamped", _distinct_sql("lineitem", "l_partkey", 0.001))
def hll_distinct_clamped(spark, sf):
    spec = AggregateSpec("count", "l_partkey", distinct=True)
    return _six_digits(sketch.distinct_trace(table(spark, sf, "lineitem"), spec, 0.001, "md5"))


@query(
    "hll_distinct_filtered",
    _distinct_sql("orders", "o_custkey", 0.05, "o_orderpriority = '1-URGENT'"),
)
def hll_distinct_filtered(spark, sf):
    where = (Comparison("o_orderpriority", "=", "1-URGENT"),)
    spec = AggregateSpec("count", "o_custkey", where, distinct=True)
    return _six_digits(sketch.distinct_trace(table(spark, sf, "orders"), spec, 0.05, "md5"))


_NULLED = "(SELECT event_type, CASE WHEN event_type <> 'error' THEN user_id END AS user_id FROM events)"


def _grouped_sql(source: str) -> str:
    error = standard_error(P)
    return f"""WITH {sql.hll_registers(source, "user_id", P, by="event_type")},
      sizes AS (SELECT event_type, count(*) AS n FROM {source} GROUP BY event_type),
      ests AS (SELECT s.event_type, s.n, {_HARMONIC} AS harmonic, count(rnk) AS filled
               FROM sizes s LEFT JOIN regs r ON r.event_type = s.event_type
               GROUP BY s.event_type, s.n)
      SELECT 1 AS iteration, event_type AS group_value,
             {sql.hll_estimate("harmonic", "filled", P)} AS estimate,
             CAST({error!r} AS DOUBLE) AS relative_error, n AS sample_rows, n AS population_rows,
             {str(error <= 0.05).lower()} AS target_met, TRUE AS is_final,
             'target_reached' AS stopped_reason
      FROM ests"""


@query("hll_distinct_grouped", _grouped_sql("events"))
def hll_distinct_grouped(spark, sf):
    return _six_digits(sketch.grouped_distinct_trace(table(spark, sf, "events"), USERS_BY_TYPE, 0.05, "md5"))


@query("hll_distinct_null_group", _grouped_sql(_NULLED))
def hll_distinct_null_group(spark, sf):
    df = table(spark, sf, "events").withColumn(
        "user_id", F.when(F.col("event_type") != "error", F.col("user_id"))
    )
    return _six_digits(sketch.grouped_distinct_trace(df, USERS_BY_TYPE, 0.05, "md5"))


@query(
    "hll_merge",
    f"""WITH {sql.hll_registers("events", "user_id", P)}
        SELECT {sql.hll_estimate(_HARMONIC, "count(*)", P)} AS estimate FROM regs""",
)
def hll_merge(spark, sf):
    df = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    daily = sketch.registers(df, "user_id", ("day",), P, "md5")
    return _six_digits(sketch.cardinality(sketch.merge(daily), P))


_MONTHS = """(SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey
              FROM orders)"""


@query(
    "hll_merge_monthly",
    f"""WITH {sql.hll_registers(_MONTHS, "o_custkey", P, by="month")}
        SELECT month, {sql.hll_estimate(_HARMONIC, "count(*)", P)} AS estimate
        FROM regs GROUP BY month""",
)
def hll_merge_monthly(spark, sf):
    df = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    daily = sketch.registers(df, "o_custkey", ("day",), P, "md5")
    monthly = daily.withColumn("month", F.trunc("day", "month"))
    return _six_digits(sketch.cardinality(sketch.merge(monthly, ("month",)), P, ("month",)))


@query(
    "builtin_sketch_merge",
    """SELECT 'all' AS of, count(DISTINCT user_id) AS users, TRUE AS near FROM events
       UNION ALL SELECT event_type, count(DISTINCT user_id), TRUE FROM events GROUP BY event_type""",
)
def builtin_sketch_merge(spark, sf):
    """Daily sketches merged for all events and per kind: within three standard errors of 2**12 registers."""
    df = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    sketches = sketch.builtin_sketches(df, "user_id", ("day", "event_type"))
    users = F.count_distinct("user_id").alias("users")
    merged = sketch.builtin_distinct(sketches).select(F.lit("all").alias("of"), "estimate").unionByName(
        sketch.builtin_distinct(sketches, ("event_type",)).select(F.col("event_type").alias("of"), "estimate")
    )
    truth = df.agg(users).select(F.lit("all").alias("of"), "users").unionByName(
        df.groupBy("event_type").agg(users).select(F.col("event_type").alias("of"), "users")
    )
    off = F.abs(F.col("estimate") - F.col("users"))
    near = off <= F.greatest(F.lit(0.5), 3 * 1.04 / 2**6 * F.col("users"))
    return merged.join(truth, "of").select("of", "users", near.alias("near"))
