"""Streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.registers import precision_for
from plumbline.operators import sketch
from plumbline.session import scratch_path
from plumbline.streaming import live
from suite import sql
from suite.registry import EVENTS_ORDER, query, table

P = precision_for(0.05)
SLOTS = 64


def _stream(spark, sf, batches: int = 4):
    """The events as a stream of files that follow each other in time, one per batch."""
    events, source = table(spark, sf, "events"), scratch_path(spark, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    part = F.least(F.floor((seconds - first) * batches / (last - first + 1)), F.lit(batches - 1))
    for k in range(batches):
        events.where(part == k).coalesce(1).write.mode("append").parquet(source)
    reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(source)


def _finished(spark, stream, keys: tuple[str, ...] | None = None):
    """Runs the stream over all data that is there, and reads what it wrote; closed windows only without keys."""
    path, checkpoint = scratch_path(spark, "live"), scratch_path(spark, "live-checkpoint")
    start = live.start_updates if keys else live.start_append
    start(stream, path, checkpoint).awaitTermination()
    if keys:
        return live.read_updates(spark, path, stream.schema, keys)
    return spark.read.schema(stream.schema).parquet(path)


def _zoneless(df):
    for name in ("window_start", "window_end"):
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


_SLOT = f"""SELECT *, CAST('0x' || substr(md5(concat_ws('|', 'slot', event_id)), 1, 8) AS BIGINT)
              % {SLOTS} AS slot, {sql.priority(("event_id",))} AS pr FROM events"""


@query(
    "slot_reservoir",
    f"""SELECT slot, event_id, user_id, event_type, value FROM (
          SELECT *, row_number() OVER (PARTITION BY slot ORDER BY pr) AS nth FROM ({_SLOT}))
        WHERE nth = 1""",
)
def slot_reservoir(spark, sf):
    rows = _stream(spark, sf).select("event_id", "user_id", "event_type", "value")
    return _finished(spark, live.slot_reservoir(rows, EVENTS_ORDER, SLOTS), ("slot",))


_DAY = "date_trunc('day', ts)"


@query(
    "window_counts",
    f"""SELECT {_DAY} AS window_start, {_DAY} + INTERVAL 1 DAY AS window_end, event_type,
               count(*) AS rows, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean
        FROM events GROUP BY ALL""",
)
def window_counts(spark, sf):
    timed = live.event_time(_stream(spark, sf), "ts", "1 hour")
    totals = live.window_totals(timed, "ts", "1 day", ("event_type",), "value")
    return _zoneless(_finished(spark, totals, ("window_start", "event_type")))


@query(
    "window_counts_closed",
    f"""SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, rows
        FROM (SELECT {_DAY} AS window_start, count(*) AS rows FROM events GROUP BY 1)
        WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def window_counts_closed(spark, sf):
    timed = live.event_time(_stream(spark, sf), "ts", "1 hour")
    return _zoneless(_finished(spark, live.window_totals(timed, "ts", "1 day")))


@query(
    "window_counts_sliding",
    """SELECT start AS window_start, start + INTERVAL 1 DAY AS window_end, count(*) AS rows
       FROM (SELECT unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * i
                            FOR i IN range(-2, 3)]) AS start, ts FROM events)
       WHERE start <= ts AND ts < start + INTERVAL 1 DAY GROUP BY start""",
)
def window_counts_sliding(spark, sf):
    timed = live.event_time(_stream(spark, sf), "ts", "1 hour")
    totals = live.window_totals(timed, "ts", "1 day", slide="12 hours")
    return _zoneless(_finished(spark, totals, ("window_start",)))


@query(
    "session_counts",
    """SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end,
              count(*) AS rows
       FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS nth
             FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                   < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
       GROUP BY user_id, nth
       HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def session_counts(spark, sf):
    timed = live.event_time(_stream(spark, sf), "ts", "1 hour")
    sessions = live.session_totals(timed, "ts", "6 hours", ("user_id",))
    return _zoneless(_finished(spark, sessions))


_HARMONIC = "CAST(coalesce(sum(pow(CAST(2 AS DOUBLE), -rnk)), 0) AS DOUBLE)"


@query(
    "window_distinct",
    f"""WITH {sql.hll_registers(f"(SELECT {_DAY} AS day, user_id FROM events)", "user_id", P, by="day")}
        SELECT day AS window_start, {sql.hll_estimate(_HARMONIC, "count(*)", P)} AS estimate
        FROM regs GROUP BY day""",
)
def window_distinct(spark, sf):
    timed = live.event_time(_stream(spark, sf), "ts", "1 hour")
    registers = live.window_registers(timed, "ts", "1 day", "user_id", P, "md5")
    stored = _zoneless(_finished(spark, registers, ("window_start", "register_index")))
    counted = sketch.cardinality(stored, P, ("window_start",))
    return counted.withColumn("estimate", F.round("estimate", 6))


@query(
    "window_sketches",
    f"""SELECT {_DAY} AS window_start, TRUE AS near FROM events GROUP BY 1
        HAVING window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def window_sketches(spark, sf):
    """Closed windows, each estimate being within three standard errors of the truth (half a user at least)."""
    timed = live.event_time(_stream(spark, sf), "ts", "1 hour")
    sketches = live.window_sketches(timed, "ts", "1 day", "user_id")
    found = _zoneless(_finished(spark, sketches))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    truth = table(spark, sf, "events").groupBy(day.alias("window_start")).agg(F.count_distinct("user_id").alias("users"))
    off = F.abs(F.col("estimate") - F.col("users"))
    near = off <= F.greatest(F.lit(0.5), 3 * 1.04 / 2**6 * F.col("users"))  # 2**12 registers
    return found.join(truth, "window_start").select("window_start", near.alias("near"))


@query(
    "live_estimates",
    f"""WITH drawn AS (
          SELECT {_DAY} AS g, value, row_number() OVER (PARTITION BY {_DAY}, slot ORDER BY pr) AS nth,
                 count(*) OVER (PARTITION BY {_DAY}) AS ng FROM ({_SLOT})),
        moments AS (
          SELECT 1 AS it, 0 AS scanned, 0 AS total, g, ng AS pop_rows, count(*) AS n,
                 sum(CAST(value AS DECIMAL(18,2))) AS sy,
                 sum(CAST(value AS DECIMAL(38,4)) * CAST(value AS DECIMAL(18,2))) AS syy,
                 count(*) AS sx
          FROM drawn WHERE nth = 1 GROUP BY g, ng)"""
    + sql.estimates(False)
    + """ SELECT g AS window_start, estimate, err AS relative_error, ci_low, ci_high, sample_rows,
                 pop_rows AS population_rows FROM est""",
)
def live_estimates(spark, sf):
    timed = live.event_time(_stream(spark, sf), "ts", "1 hour")
    samples = live.window_samples(timed, "ts", "1 day", "value", EVENTS_ORDER, SLOTS)
    estimates = live.window_estimates(_finished(spark, samples, ("window_start", "slot")))
    return _zoneless(estimates).drop("window_end")
