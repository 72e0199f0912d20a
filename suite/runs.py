"""Whole runs over a stored layout: steps, comparison, latencies, records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline import AggregateSpec, Comparison
from plumbline.operators import compare
from plumbline.plans.progressive import progressive_trace
from plumbline.plans.run import record, run
from plumbline.session import scratch_path
from plumbline.sources import layout, runlog
from suite import sql
from suite.registry import LINEITEM_KEYS, query, table
from suite.sampled import PRICE_SUM, lineitem

_BY_FLAG = AggregateSpec("sum", "l_extendedprice", group_by="l_returnflag", scale=2)


def counted_layout(spark, sf):
    """The layout of lineitem with its statistics."""
    df, order = lineitem(spark, sf)
    path = scratch_path(spark, "layout")
    layout.write_sample_layout(df, path, order)
    layout.write_statistics(spark, path, ("l_returnflag", "l_linestatus", "l_linenumber"))
    return layout.open_sample_layout(spark, path)


@query(
    "layout_statistics",
    f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER
              (ORDER BY {sql.priority(LINEITEM_KEYS)}, l_extendedprice) AS rk FROM lineitem),
        pop AS (SELECT count(*) AS n FROM lineitem), {sql.ladder("pop")},
        placed AS (SELECT r.*, coalesce((SELECT min(it) FROM ladder WHERE rk <= size),
                                        (SELECT max(it) + 1 FROM ladder)) AS step FROM ranked r)
        SELECT step AS sample_step, 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS rows
        FROM placed GROUP BY ALL UNION ALL
        SELECT step, 'l_linestatus', l_linestatus, count(*) FROM placed GROUP BY ALL UNION ALL
        SELECT step, 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM placed GROUP BY ALL""",
)
def layout_statistics(spark, sf):
    return counted_layout(spark, sf).statistics


def _filtered_steps(where: str) -> str:
    """As ``sql.moments``, the rows being ranked before they are filtered."""
    return f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER
      (ORDER BY {sql.priority(LINEITEM_KEYS)}, l_extendedprice) AS rk FROM lineitem),
pop AS (SELECT count(*) AS n FROM ranked), {sql.ladder("pop")},
base AS (SELECT rk, CAST(l_extendedprice AS DECIMAL(18,2)) AS y FROM ranked WHERE {where}),
moments AS (
  SELECT it, count(y) AS scanned, (SELECT count(*) FROM base) AS total, 0 AS g,
         (SELECT count(*) FROM base) AS pop_rows, count(y) AS n,
         coalesce(sum(y), 0) AS sy, coalesce(sum(CAST(y AS DECIMAL(38,4)) * y), 0) AS syy, count(y) AS sx
  FROM ladder LEFT JOIN base ON rk <= size GROUP BY it)"""


@query(
    "progressive_filtered_avg",
    _filtered_steps("l_returnflag = 'R'") + sql.estimates(True) + sql.stopped(0.02) + sql.SCALAR_COLUMNS,
)
def progressive_filtered_avg(spark, sf):
    spec = AggregateSpec("avg", "l_extendedprice", (Comparison("l_returnflag", "=", "R"),), scale=2)
    trace = progressive_trace(counted_layout(spark, sf), spec, 0.02)
    return trace.select(
        "iteration", "estimate", "relative_error", "ci_low", "ci_high", "sample_rows", "total_rows",
        "target_met", "is_final", "stopped_reason",
    )


@query(
    "answer_progressive",
    sql.scalar_trace(
        0.03, "lineitem", LINEITEM_KEYS, "l_extendedprice", group="l_returnflag", tie="l_extendedprice"
    )
    + """, truth AS (
      SELECT l_returnflag AS g, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY g),
    both_sides AS (
      SELECT g, it, round_even(estimate, 2) AS approx, round_even(v, 2) AS v FROM tr JOIN truth USING (g) WHERE is_final)
    SELECT 'stratified_sampling' AS method, g AS group_value, CAST(it AS INTEGER) AS steps, approx AS approx_estimate,
           v AS exact_value, round_even(abs(v - approx) / v, 6) AS delta_pct, TRUE AS was_timed FROM both_sides""",
)
def answer_progressive(spark, sf):
    """Method, steps, comparison and latencies of one grouped run that reads only the steps it needs."""
    done = run(counted_layout(spark, sf), _BY_FLAG, 0.03)
    steps = done.trace.agg(F.max("iteration").alias("steps"))
    timed = (F.col("approx_latency_ms") > 0) & (F.col("exact_latency_ms") > 0) & (F.col("speedup") > 0)
    return done.comparison.select(
        F.lit(done.method).alias("method"), "group_value", steps.scalar().alias("steps"), "approx_estimate",
        "exact_value", "delta_pct", timed.alias("was_timed"),
    )


@query(
    "run_record",
    sql.scalar_trace(0.02, "lineitem", LINEITEM_KEYS, "l_extendedprice", tie="l_extendedprice")
    + """, told AS (
      SELECT 'total' AS session_id, CAST(it + 2 AS INTEGER) AS sequence,
             CASE WHEN is_final THEN 'approx_final' ELSE 'approx_progress' END AS type, CAST(sample_rows AS BIGINT) AS sample_rows
      FROM tr
      UNION ALL SELECT 'total', 1, 'sql_generated', NULL UNION ALL SELECT 'total', 2, 'plan_ready', NULL
      UNION ALL SELECT 'total', CAST(max(it) + 3 AS INTEGER), 'exact_result', NULL FROM tr
      UNION ALL SELECT 'rows', 1, 'sql_generated', NULL UNION ALL SELECT 'rows', 2, 'plan_ready', NULL
      UNION ALL SELECT 'rows', 3, 'approx_final', 0 UNION ALL SELECT 'rows', 4, 'exact_result', NULL)
    SELECT told.*, CASE session_id WHEN 'total' THEN 'total price' ELSE 'how many' END AS prompt FROM told""",
)
def run_record(spark, sf):
    """Two runs that record themselves, one of them told twice: its events and its line stand once."""
    stored, path = counted_layout(spark, sf), scratch_path(spark, "runs")
    for name, prompt, spec in (
        ("total", "total price", PRICE_SUM), ("rows", "how many", AggregateSpec("count")), ("total", "total price", PRICE_SUM),
    ):
        record(run(stored, spec, 0.02), path, name, prompt, "lineitem", "Line items", 0.02)
    history = runlog.read_history(spark, f"{path}/history").select("session_id", "prompt")
    events = runlog.read_events(spark, f"{path}/events")
    return events.join(history, "session_id").select(
        "session_id", "sequence", "type",
        F.get_json_object("payload", "$.sample_rows").cast("long").alias("sample_rows"), "prompt",
    )


@query(
    "speedup",
    """SELECT event_type, CASE WHEN approx > 0 THEN round_even(exact / approx, 2) ELSE 0 END AS speedup FROM (
         SELECT event_type, CAST(count(*) * 1000 AS DOUBLE) AS exact,
                CAST(count(*) FILTER (event_type <> 'click' AND event_id % 3 = 0) * 70 AS DOUBLE) AS approx
         FROM events GROUP BY event_type)""",
)
def speedup(spark, sf):
    """Latencies as event counts: a kind of event without an approximate one has no speed-up."""
    some = F.count(F.when((F.col("event_type") != "click") & (F.col("event_id") % 3 == 0), 1))
    times = table(spark, sf, "events").groupBy("event_type").agg(
        (F.count("*") * 1000).alias("exact"), (some * 70).alias("approx")
    )
    return times.select("event_type", compare.speedup(F.col("exact"), F.col("approx")).alias("speedup"))


def _sized_question(column: str, op: str, value) -> AggregateSpec:
    return AggregateSpec("avg", "l_extendedprice", (Comparison(column, op, value),), scale=2)


@query(
    "statistics_sizes",
    """SELECT 'l_returnflag != R' AS question, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R'
       UNION ALL SELECT 'l_linenumber > 2', count(*) FROM lineitem WHERE l_linenumber > 2
       UNION ALL SELECT 'l_linenumber <= 10', count(*) FROM lineitem WHERE l_linenumber <= 10
       UNION ALL SELECT 'all', count(*) FROM lineitem""",
)
def statistics_sizes(spark, sf):
    """Sizes of filtered tables, from the statistics alone."""
    stored = counted_layout(spark, sf)
    asked = {
        "l_returnflag != R": _sized_question("l_returnflag", "!=", "R"),
        "l_linenumber > 2": _sized_question("l_linenumber", ">", 2),
        "l_linenumber <= 10": _sized_question("l_linenumber", "<=", 10),
        "all": PRICE_SUM,
    }
    lines = [
        spark.createDataFrame([(name, stored.sizes(spec)[None])], "question string, n long") for name, spec in asked.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), lines)
