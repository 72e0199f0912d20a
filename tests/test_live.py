"""Streams give what the same functions give on a batch; late rows are dropped."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.order import SampleOrder
from plumbline.streaming import live

ORDER = SampleOrder(("event_id",))


@pytest.fixture(scope="module")
def events(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, df, build, tmp_path, keys, files=3):
    source, path, check = (str(tmp_path / n) for n in ("source", "out", "check"))
    df.repartition(files, "event_id").write.parquet(source)
    stream = build(
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    )
    live.start_updates(stream, path, check).awaitTermination()
    return live.read_updates(spark, path, stream.schema, keys)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_reservoir(spark, events, tmp_path):
    def build(df):
        return live.slot_reservoir(df.select("event_id", "value"), ORDER, 32)

    streamed = run(spark, events, build, tmp_path, ("slot",))
    assert streamed.count() == 32 and same(streamed, build(events))


def test_reservoir_is_uniform(spark, events):
    slots = live.slot_reservoir(events.select("event_id"), ORDER, 100)
    drawn = [r["event_id"] for r in slots.collect()]
    assert len(drawn) == len(set(drawn)) == 100
    middle = events.count() / 2
    assert abs(sum(drawn) / 100 - middle) < 0.2 * middle


def test_windows(spark, events, tmp_path):
    def build(df):
        timed = live.event_time(df, "ts", "400 days")
        return live.window_totals(timed, "ts", "6 hours", ("event_type",), "value")

    assert same(run(spark, events, build, tmp_path, ("window_start", "event_type")), build(events))


def test_window_distinct_and_estimates(spark, events, tmp_path):
    def build(df):
        return live.window_samples(df, "ts", "5 days", "value", ORDER, 64)

    streamed = run(spark, events, build, tmp_path, ("window_start", "slot"))
    assert same(streamed, build(events))
    truth = {
        r["start"]: (r["n"], r["v"])
        for r in events.groupBy(F.window("ts", "5 days").alias("w"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("v"))
        .select("w.start", "n", "v")
        .collect()
    }
    lines = live.window_estimates(streamed).collect()
    assert {r["window_start"]: r["population_rows"] for r in lines} == {
        s: n for s, (n, _) in truth.items()
    }
    near = [abs(r["estimate"] / truth[r["window_start"]][1] - 1) < 0.5 for r in lines]
    assert all(near)


def test_late_rows_are_dropped_and_the_open_window_held_back(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("source", "out", "check"))
    schema = "event_id long, ts timestamp"

    def feed(*rows):
        df = spark.createDataFrame([(i, t) for i, t in rows], "event_id long, t string")
        df.select("event_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode(
            "append"
        ).parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        timed = live.event_time(stream, "ts", "10 minutes")
        totals = live.window_totals(timed, "ts", "1 hour")
        live.start_append(totals, path, check).awaitTermination()
        return {
            r["window_start"].hour: r["rows"]
            for r in spark.read.schema(totals.schema).parquet(path).collect()
        }

    assert feed((1, "2025-01-01 00:05:00"), (2, "2025-01-01 00:40:00")) == {}
    assert feed((3, "2025-01-01 03:30:00")) == {0: 2}
    # belongs to a closed window
    assert feed((4, "2025-01-01 00:50:00"), (5, "2025-01-01 05:30:00")) == {0: 2, 3: 1}


def test_state_is_dropped_and_every_batch_is_told_once(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("source", "out", "check"))
    rows = spark.range(400).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id * 600) AS ts", "id * 0.25 AS value"
    )
    for k in range(4):
        rows.where(f"event_id DIV 100 = {k}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    totals = live.window_totals(live.event_time(stream, "ts", "1 hour"), "ts", "1 hour", value="value")
    query = live.start_updates(totals, path, check)
    query.awaitTermination()
    states = [p["stateOperators"][0] for p in query.recentProgress]
    assert sum(s["numRowsRemoved"] for s in states) > 40 and states[-1]["numRowsTotal"] < 5
    found = live.read_updates(spark, path, totals.schema, ("window_start",))
    assert same(found, live.window_totals(rows, "ts", "1 hour", value="value"))
    lines = found.count()
    # the last batch again, as after a failure
    last = max(tmp_path.glob("out/update_batch=*"), key=lambda p: int(p.name.split("=")[1]))
    spark.read.parquet(str(last)).write.mode("overwrite").parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("overwrite").parquet(str(last))
    assert lines == live.read_updates(spark, path, totals.schema, ("window_start",)).count()


def test_values_of_streams_are_not_rounded(spark):
    rows = [(1, 1e17), (2, 0.25), (3, None)]
    df = spark.createDataFrame(rows, "k int, value double").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    line = live.window_totals(df, "ts", "1 hour", value="value").first()
    assert line["total"] == 1e17 and line["rows"] == 3
    with pytest.raises(Exception, match="decimal places"):
        live.window_totals(df.withColumn("value", F.lit(0.125)), "ts", "1 hour", value="value").collect()
