"""HyperLogLog: sizes, accuracy, merging."""

import pytest
from pyspark.sql import functions as F

from plumbline import AggregateSpec
from plumbline.functions import registers as hll
from plumbline.operators import sketch

PRECISIONS = {0.5: 5, 0.2: 7, 0.1: 9, 0.05: 11, 0.02: 14, 0.01: 16, 0.005: 18, 0.001: 18}


def test_precision():
    assert {t: hll.precision_for(t) for t in PRECISIONS} == PRECISIONS
    assert hll.standard_error(11) == pytest.approx(0.02298, abs=1e-5)


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
@pytest.mark.parametrize("distinct", [1, 50, 3000, 60_000])
def test_error_stays_small(spark, method, distinct):
    df = spark.range(distinct * 2).selectExpr(f"id % {distinct} as v")
    spec = AggregateSpec("count", "v", distinct=True)
    line = sketch.distinct_trace(df, spec, 0.05, method).first()
    assert abs(line["estimate"] - distinct) <= max(0.5, 4 * hll.standard_error(11) * distinct)


def test_registers_by_hand(spark):
    regs = spark.createDataFrame([(11, 3), (17, 2), (23, 4)], "register_index int, register_rank int")
    estimate = sketch.cardinality(regs, 11).first()[0]
    # three of 2,048 registers filled: linear counting
    assert estimate == pytest.approx(3.0, abs=0.01)


def test_rank_of_known_hashes(spark):
    index, rank = hll.register_and_rank(F.col("v"), 4, "md5")
    row = spark.sql("select '1' as v").select(index, rank).first()
    digest = 0xC4CA4238A0B92382
    low = digest & 0xFFFFFFFF
    rest = ((digest >> 32) << 28) + (low >> 4)
    assert tuple(row) == (low & 15, 61 - rest.bit_length())


def test_merge_equals_one_pass(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("day", F.to_date("ts"))
    daily = sketch.registers(events, "user_id", ("day",), 11)
    whole = sketch.registers(events, "user_id", (), 11)
    assert sketch.merge(daily).exceptAll(whole).count() == 0
    builtin = sketch.builtin_distinct(sketch.builtin_sketches(events, "user_id", ("day",)))
    truth = events.select("user_id").distinct().count()
    assert abs(builtin.first()[0] - truth) <= max(1, 0.05 * truth)


def test_groups(spark):
    df = spark.createDataFrame(
        [(31, "calm"), (57, "calm"), (31, "calm"), (31, "rough"), (88, "rough"), (90, "rough"), (57, "fog"), (None, "gone")],
        "buoy long, sea string",
    )
    spec = AggregateSpec("count", "buoy", group_by="sea", distinct=True)
    lines = {r["group_value"]: r for r in sketch.grouped_distinct_trace(df, spec).collect()}
    assert {g: round(r["estimate"]) for g, r in lines.items()} == {
        "calm": 2,
        "rough": 3,
        "fog": 1,
        "gone": 0,
    }
    assert lines["gone"]["population_rows"] == 1


def test_empty_table(spark):
    df = spark.range(0).selectExpr("id as v")
    line = sketch.distinct_trace(df, AggregateSpec("count", "v", distinct=True), 0.001).first()
    assert (line["estimate"], line["relative_error"]) == (0.0, 0.0)
    assert line["stopped_reason"] == "target_reached"


def test_clamped_precision_misses_the_target(spark):
    df = spark.range(100).selectExpr("id as v")
    line = sketch.distinct_trace(df, AggregateSpec("count", "v", distinct=True), 0.001).first()
    assert (line["target_met"], line["stopped_reason"]) == (False, "sample_cap")


def test_highest_bit(spark):
    numbers = [n for i in range(60) for n in ((1 << i) - 1, 1 << i, (1 << i) + 1) if n > 0]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = df.select("n", hll._highest_bit(F.col("n")).alias("b")).collect()
    assert all(r["b"] == r["n"].bit_length() - 1 for r in got)
