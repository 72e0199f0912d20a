"""Approximate beside exact, convergence, replay, run records."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from plumbline import AggregateSpec
from plumbline.operators import adaptive, compare, exact
from plumbline.operators.method import choose_method
from plumbline.operators.sketch import grouped_distinct_trace
from plumbline.session import scratch_path
from plumbline.sources import runlog
from suite import sql
from suite.registry import LINEITEM_KEYS, query, table
from suite.sampled import PRICE_SUM, lineitem, orders
from suite.sketched import USERS_BY_TYPE, _grouped_sql

_PRICE_TRACE = sql.scalar_trace(
    0.005, "lineitem", LINEITEM_KEYS, "l_extendedprice", tie="l_extendedprice"
)
_EXACT_PRICE = """(SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v
                   FROM lineitem)"""

QTY = AggregateSpec("sum", "l_quantity", alias="quantity", scale=2)


@query(
    "compare_scalar",
    sql.scalar_trace(0.05, "lineitem", LINEITEM_KEYS, "l_extendedprice", tie="l_extendedprice")
    + f""" SELECT *, format('{{:,.2f}}', estimate) AS approx_display_value,
             format('{{:,.2f}}', exact_value) AS exact_display_value,
             round_even(abs(exact_value - estimate), 2) AS delta,
             round_even(CASE WHEN abs(exact_value) <= 1e-9 THEN 0
               ELSE abs(exact_value - estimate) / abs(exact_value) END, 6) AS delta_pct
           FROM (SELECT round_even((SELECT estimate FROM tr WHERE is_final), 2) AS estimate,
                        round_even((SELECT v FROM {_EXACT_PRICE}), 2) AS exact_value)""",
)
def compare_scalar(spark, sf):
    df, order = lineitem(spark, sf)
    final = adaptive.final_answer(adaptive.adaptive_trace(df, PRICE_SUM, order, 0.05))
    return compare.compare_scalar(final, exact.exact(df, PRICE_SUM), PRICE_SUM)


@query(
    "compare_scalar_integral",
    sql.scalar_trace(0.05, "lineitem", LINEITEM_KEYS, "l_quantity", tie="l_extendedprice")
    + """ SELECT *, format('{:,.0f}', estimate) AS approx_display_value,
             format('{:,.0f}', exact_value) AS exact_display_value,
             round_even(abs(exact_value - estimate), 0) AS delta,
             round_even(abs(exact_value - estimate) / abs(exact_value), 6) AS delta_pct
           FROM (SELECT round_even((SELECT estimate FROM tr WHERE is_final), 0) AS estimate,
             round_even((SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)
                         FROM lineitem), 0) AS exact_value)""",
)
def compare_scalar_integral(spark, sf):
    df, order = lineitem(spark, sf)
    final = adaptive.final_answer(adaptive.adaptive_trace(df, QTY, order, 0.05))
    return compare.compare_scalar(final, exact.exact(df, QTY), QTY, integral=True)


REVENUE = AggregateSpec(
    "sum", "o_totalprice", group_by="o_orderpriority", alias="revenue", scale=2
)
_REVENUE_DELTAS = (
    sql.scalar_trace(0.1, "orders", ("o_orderkey",), "o_totalprice", group="o_orderpriority")
    + """,
  final AS (SELECT coalesce(CAST(g AS VARCHAR), 'NULL') AS g, round_even(estimate, 2) AS a
            FROM tr WHERE is_final),
  truth AS (SELECT coalesce(CAST(o_orderpriority AS VARCHAR), 'NULL') AS g,
              round_even(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS v
            FROM orders GROUP BY 1),
  deltas AS (SELECT t.g, coalesce(f.a, 0) AS a, t.v, abs(t.v - coalesce(f.a, 0)) AS d,
               CASE WHEN abs(t.v) <= 1e-9 THEN 0
                    ELSE abs(t.v - coalesce(f.a, 0)) / abs(t.v) END AS dp
             FROM truth t LEFT JOIN final f ON f.g = t.g)"""
)


def _revenue(spark, sf):
    df, order = orders(spark, sf)
    final = adaptive.final_answer(adaptive.grouped_trace(df, REVENUE, order, 0.1))
    return final, exact.exact(df, REVENUE)


@query(
    "compare_grouped",
    _REVENUE_DELTAS
    + """ SELECT g AS group_value, a AS approx_estimate,
             '$' || format('{:,.2f}', a) AS approx_display_value, v AS exact_value,
             '$' || format('{:,.2f}', v) AS exact_display_value, round_even(d, 2) AS delta,
             round_even(dp, 6) AS delta_pct FROM deltas""",
)
def compare_grouped(spark, sf):
    return compare.compare_grouped(*_revenue(spark, sf), REVENUE)


@query(
    "delta_roll_up",
    _REVENUE_DELTAS
    + """ SELECT count(*) AS group_count, round_even(max(dp), 6) AS max_delta_pct,
                 round_even(avg(dp), 6) AS mean_delta_pct FROM deltas""",
)
def delta_roll_up(spark, sf):
    return compare.delta_roll_up(*_revenue(spark, sf), REVENUE)


@query(
    "compare_grouped_distinct",
    f"""SELECT t.event_type AS group_value, round_even(s.estimate, 0) AS approx_estimate,
          format('{{:,.0f}}', round_even(s.estimate, 0)) AS approx_display_value,
          CAST(t.n AS DOUBLE) AS exact_value,
          format('{{:,.0f}}', CAST(t.n AS DOUBLE)) AS exact_display_value,
          abs(t.n - round_even(s.estimate, 0)) AS delta,
          round_even(abs(t.n - round_even(s.estimate, 0)) / t.n, 6) AS delta_pct
        FROM (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type) t
        JOIN ({_grouped_sql("events")}) s ON s.group_value = t.event_type""",
)
def compare_grouped_distinct(spark, sf):
    df = table(spark, sf, "events")
    sketched = grouped_distinct_trace(df, USERS_BY_TYPE, 0.05, "md5")
    return compare.compare_grouped(sketched, exact.exact(df, USERS_BY_TYPE), USERS_BY_TYPE)


_PROGRESS = """,
  pts AS (SELECT it AS iteration,
            round_even(CAST(sample_rows AS DOUBLE) / total * 100, 2) AS data_scanned_pct,
            round_even(err, 6) AS relative_error, target_met, is_final,
            CASE WHEN target_met THEN 'target_met' WHEN it = 1 THEN 'warming_up'
                 ELSE 'converging' END AS status FROM tr)"""


def _price_progress(spark, sf):
    df, order = lineitem(spark, sf)
    return adaptive.with_progress(adaptive.adaptive_trace(df, PRICE_SUM, order, 0.005), PRICE_SUM)


@query(
    "convergence_trace",
    _PRICE_TRACE + _PROGRESS + " SELECT iteration, data_scanned_pct, relative_error FROM pts",
)
def convergence_trace(spark, sf):
    return compare.convergence(_price_progress(spark, sf))


@query(
    "convergence_first_points",
    """SELECT user_id AS run, iteration, arrival, relative_error * 100 AS relative_error FROM (
         SELECT user_id, CAST(hour(ts) AS INTEGER) AS iteration, event_id AS arrival,
                value AS relative_error,
                row_number() OVER (PARTITION BY user_id, hour(ts) ORDER BY event_id) AS nth
         FROM events) WHERE nth = 1""",
)
def convergence_first_points(spark, sf):
    points = table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        F.hour("ts").alias("iteration"),
        F.col("event_id").alias("arrival"),
        F.col("value").alias("relative_error"),
    )
    return compare.first_points(points, ("run",), "arrival")


@query(
    "milestones",
    _PRICE_TRACE
    + _PROGRESS
    + """ SELECT CAST(t AS DOUBLE) AS threshold, min(iteration) AS first_iteration
          FROM (VALUES (0.001), (0.01), (0.05), (0.1)) v(t)
          LEFT JOIN pts ON relative_error <= t GROUP BY t""",
)
def milestones(spark, sf):
    points = compare.convergence(_price_progress(spark, sf))
    return compare.milestones(points, [0.001, 0.01, 0.05, 0.1])


@query(
    "milestones_per_run",
    """SELECT user_id AS run, CAST(t AS DOUBLE) AS threshold, min(event_id) AS first_iteration
       FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES (1), (5), (10)) v(t)
       LEFT JOIN events e USING (user_id)
       GROUP BY user_id, t HAVING TRUE""".replace(
        "min(event_id)", "min(CASE WHEN value <= t THEN event_id END)"
    ),
)
def milestones_per_run(spark, sf):
    points = table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("iteration"),
        F.col("value").alias("relative_error"),
    )
    return compare.milestones(points, [1, 5, 10], ("run",))


@query(
    "target_replay",
    _PRICE_TRACE
    + _PROGRESS
    + """ SELECT iteration, CAST(t AS DOUBLE) AS tolerance, relative_error <= t AS target_met,
             CASE WHEN relative_error <= t THEN 'target_met'
                  WHEN is_final OR status = 'target_met' THEN 'converging' ELSE status END AS status
          FROM pts CROSS JOIN (VALUES (0.006), (0.02), (0.06)) v(t)""",
)
def target_replay(spark, sf):
    stored = _price_progress(spark, sf).withColumn("relative_error", F.bround("relative_error", 6))
    return compare.replay(stored, [0.006, 0.02, 0.06]).select(
        "iteration", "tolerance", "target_met", "status"
    )


@query(
    "event_log",
    sql.scalar_trace(0.02, "lineitem", LINEITEM_KEYS, "l_extendedprice", tie="l_extendedprice")
    + """ SELECT CAST(it + 2 AS INTEGER) AS sequence,
             CASE WHEN is_final THEN 'approx_final' ELSE 'approx_progress' END AS type,
             CAST(it AS INTEGER) AS iteration, CAST(sample_rows AS BIGINT) AS sample_rows FROM tr
          UNION ALL SELECT 1, 'sql_generated', NULL, NULL
          UNION ALL SELECT 2, 'plan_ready', NULL, NULL
          UNION ALL SELECT CAST(max(it) + 3 AS INTEGER), 'exact_result', NULL, NULL FROM tr""",
)
def event_log(spark, sf):
    df, order = lineitem(spark, sf)
    trace = adaptive.adaptive_trace(df, PRICE_SUM, order, 0.02)
    compared = compare.compare_scalar(
        adaptive.final_answer(trace), exact.exact(df, PRICE_SUM), PRICE_SUM
    )
    question = spark.range(1).select(F.lit("total price").alias("prompt"))
    events = runlog.event_log(
        "run-1",
        question,
        choose_method(df, PRICE_SUM),
        adaptive.with_progress(trace, PRICE_SUM),
        compared,
    )
    path = scratch_path(spark, "events")
    runlog.write_events(events, path, "run-1")
    return runlog.read_events(spark, path).select(
        "sequence",
        "type",
        F.get_json_object("payload", "$.iteration").cast("int").alias("iteration"),
        F.get_json_object("payload", "$.sample_rows").cast("long").alias("sample_rows"),
    )


@query(
    "event_log_grouped",
    sql.scalar_trace(0.1, "orders", ("o_orderkey",), "o_totalprice", group="o_orderpriority")
    + """ SELECT CAST(it + 2 AS INTEGER) AS sequence,
             CASE WHEN bool_and(is_final) THEN 'approx_final' ELSE 'approx_progress' END AS type,
             CAST(count(*) AS INTEGER) AS groups FROM tr GROUP BY it
          UNION ALL SELECT 1, 'sql_generated', NULL
          UNION ALL SELECT 2, 'plan_ready', NULL
          UNION ALL SELECT CAST((SELECT max(it) FROM tr) + 3 AS INTEGER), 'exact_result',
             CAST(count(DISTINCT o_orderpriority) AS INTEGER) FROM orders""",
)
def event_log_grouped(spark, sf):
    df, order = orders(spark, sf)
    trace = adaptive.grouped_trace(df, REVENUE, order, 0.1)
    compared = compare.compare_grouped(
        adaptive.final_answer(trace), exact.exact(df, REVENUE), REVENUE
    )
    question = spark.range(1).select(F.lit("revenue by priority").alias("prompt"))
    progress = adaptive.with_progress(trace, REVENUE, grouped=True)
    events = runlog.event_log("run-2", question, choose_method(df, REVENUE), progress, compared)
    members = F.coalesce(
        F.get_json_object("payload", "$.group_rows"), F.get_json_object("payload", "$.rows")
    )
    return events.select("sequence", "type", F.json_array_length(members).alias("groups"))


_PROMPTS = """SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS session_id,
                     text AS prompt, role AS dataset_id, role AS dataset_label FROM conversations"""


def _prompts(spark, sf):
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("session_id"),
        F.col("text").alias("prompt"),
        F.col("role").alias("dataset_id"),
        F.col("role").alias("dataset_label"),
    )


@query(
    "history_listing",
    """SELECT CAST(event_id AS VARCHAR) AS session_id, event_type AS dataset_id, ts AS created_at
       FROM events ORDER BY ts DESC, event_id""",
)
def history_listing(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("session_id"),
        F.col("event_type").alias("dataset_id"),
        F.col("ts").alias("created_at"),
    )
    return runlog.newest_first(runs, "created_at", "session_id")


@query(
    "history_search",
    f"""SELECT session_id, dataset_id FROM ({_PROMPTS})
        WHERE lower(prompt) LIKE '%tion%' OR lower(dataset_label) LIKE '%tion%'
           OR lower(dataset_id) LIKE '%tion%'""",
)
def history_search(spark, sf):
    found = runlog.search(_prompts(spark, sf), " TION ", "prompt", "dataset_label", "dataset_id")
    return found.select("session_id", "dataset_id")


@query("history_search_blank", f"SELECT session_id, dataset_id FROM ({_PROMPTS})")
def history_search_blank(spark, sf):
    found = runlog.search(_prompts(spark, sf), "  ", "prompt", "dataset_label", "dataset_id")
    return found.select("session_id", "dataset_id")


@query("history_table", "SELECT 'run-' || CAST(i AS VARCHAR) AS session_id, n AS rows FROM "
       "(SELECT 1 AS i, count(*) AS n FROM orders UNION ALL SELECT 2, count(*) FROM events)")
def history_table(spark, sf):
    path = scratch_path(spark, "history")
    for i, name in enumerate(("orders", "events"), 1):
        rows = table(spark, sf, name).count()
        when = datetime(2025, 1, i, tzinfo=timezone.utc)
        runlog.append_run(spark, path, f"run-{i}", f"{rows}", name, name, created_at=when)
    history = runlog.newest_first(runlog.read_history(spark, path))
    return history.select("session_id", F.col("prompt").cast("long").alias("rows"))


@query(
    "compare_null_and_text_null",
    """WITH told AS (
         SELECT CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN 'NULL' ELSE 'other' END AS g,
                l_quantity AS v, l_linenumber AS n FROM lineitem)
       SELECT coalesce(g, 'NULL') AS group_value,
              coalesce(2 * sum(v) FILTER (n % 2 = 0), 0) AS approx_estimate, sum(v) AS exact_value
       FROM told GROUP BY g""",
)
def compare_null_and_text_null(spark, sf):
    """No value and the text NULL are two groups, on either side of a comparison."""
    told = F.when(F.col("l_returnflag") == "N", "NULL").when(F.col("l_returnflag") != "A", "other")
    df = table(spark, sf, "lineitem").withColumn("g", told)
    spec = AggregateSpec("sum", "l_quantity", group_by="g", alias="total", scale=2)
    half = exact.exact(df.where("l_linenumber % 2 = 0"), spec)
    approx = half.select(F.col("g").alias("group_value"), (2 * F.col("total")).alias("estimate"))
    return compare.compare_grouped(approx, exact.exact(df, spec), spec).select(
        "group_value", "approx_estimate", "exact_value"
    )
