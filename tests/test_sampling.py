"""Random prefixes against a brute-force ranking, on awkward data."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline import AggregateSpec
from plumbline.functions.order import SampleOrder
from plumbline.operators import sampling
from plumbline.operators.adaptive import with_estimates

LADDERS = {
    0: [1],
    1: [1],
    300: [300],
    3000: [512, 1024, 1792, 2048],
    6000: [512, 1024, 1792, 2400],
    15000: [512, 1024, 1792, 3136, 5488, 6000],
    60000: [512, 1024, 1792, 3136, 5488, 9604, 16807, 24000],
    600000: [
        512, 1024, 1792, 3136, 5488, 9604, 16807, 29412, 51471, 90074, 157629, 240000,
    ],
}


def test_ladder(spark):
    for rows, sizes in LADDERS.items():
        frame = spark.createDataFrame([(rows,)], "population_rows long")
        got = [r["sample_rows"] for r in sampling.ladder(frame).orderBy("iteration").collect()]
        assert got == sizes


def test_ladder_reaches_large_tables(spark):
    frame = spark.createDataFrame([(10**13,)], "population_rows long")
    sizes = [r["sample_rows"] for r in sampling.ladder(frame).orderBy("iteration").collect()]
    assert sizes[-1] == 4 * 10**12 and sizes == sorted(sizes) and len(sizes) < 65


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, g string, v double")


def awkward_rows(kind):
    chance = random.Random(7)
    if kind == "plain":
        return [(i, "abc"[i % 3], float(chance.randint(0, 99))) for i in range(4000)]
    if kind == "hot key":
        # a third of all rows are copies of one row, another part shares its key only
        hot = [(1, "a", 5.0)] * 1300 + [(1, "b", float(i % 7)) for i in range(300)]
        return hot + [(i, "abc"[i % 3], float(i % 50)) for i in range(2, 2400)]
    if kind == "nulls":
        return [
            (i, None if i % 4 == 0 else "xy"[i % 2], None if i % 5 == 0 else float(i % 11))
            for i in range(3500)
        ]
    if kind == "one row":
        return [(1, "a", 3.0)]
    return []


KINDS = ["plain", "hot key", "nulls", "one row", "empty"]


def ranked(df, order):
    """Rows in sample order, by sorting all of them."""
    rows = df.withColumn("p", order.priority()).collect()
    return sorted(
        rows, key=lambda r: (r["p"], r["v"] if r["v"] is not None else 0.0, r["g"] or "")
    )


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("method", ["md5", "xxhash64"])
@pytest.mark.parametrize("agg", ["sum", "avg"])
def test_moments_equal_brute_force(spark, kind, method, agg):
    order = SampleOrder(("k",), method, bucket_bits=8)
    df = table(spark, awkward_rows(kind))
    if agg == "avg":
        # a row without a value comes before equal hashes with one; keep to one order
        order = SampleOrder(("k", "v"), method, bucket_bits=8)
    spec = AggregateSpec(agg, "v", scale=2)
    got = {r["iteration"]: r for r in sampling.step_moments(df, spec, order).collect()}
    rows = ranked(df, order)
    sizes = LADDERS[0] if not rows else _ladder(len(rows))
    assert sorted(got) == list(range(1, len(sizes) + 1))
    for iteration, size in enumerate(sizes, 1):
        drawn = rows[:size]
        values = [r["v"] or 0.0 for r in drawn]
        line = got[iteration]
        assert line["sample_rows"] == len(drawn)
        assert float(line["sum_y"]) == pytest.approx(sum(values))
        assert float(line["sum_yy"]) == pytest.approx(sum(v * v for v in values))
        counted = len(drawn) if agg == "sum" else sum(r["v"] is not None for r in drawn)
        assert line["sum_x"] == counted
        assert line["population_rows"] == len(rows)


def _ladder(n):
    cap, sizes = max(1, min(n, max(2048, int(n * 0.4)))), []
    size = min(cap, 512)
    while True:
        sizes.append(size)
        if size >= cap:
            return sizes
        size = min(cap, max(size + 512, int(size * 1.75)))


@pytest.mark.parametrize("kind", ["plain", "nulls", "hot key"])
def test_grouped_moments_equal_brute_force(spark, kind):
    order = SampleOrder(("k", "v", "g"), bucket_bits=8)
    df = table(spark, awkward_rows(kind))
    spec = AggregateSpec("sum", "v", group_by="g")
    got = {
        (r["iteration"], r["group_value"]): r
        for r in sampling.step_moments(df, spec, order).collect()
    }
    rows = ranked(df, order)
    groups = {r["g"] for r in rows}
    for iteration, size in enumerate(_ladder(len(rows)), 1):
        for group in groups:
            drawn = [r for r in rows[:size] if r["g"] == group]
            line = got[(iteration, group)]
            assert line["sample_rows"] == len(drawn)
            assert line["sum_y"] == pytest.approx(sum(r["v"] or 0.0 for r in drawn))
            assert line["population_rows"] == sum(r["g"] == group for r in rows)
            assert line["scanned_rows"] == size


def test_a_group_not_met_yet_has_a_row(spark):
    rows = [(i, "big", 1.0) for i in range(6000)] + [(9999, "tiny", 1.0)]
    order = SampleOrder(("k",), bucket_bits=8)
    spec = AggregateSpec("sum", "v", group_by="g")
    moments = sampling.step_moments(table(spark, rows), spec, order)
    found = with_estimates(moments, spec, 0.95).where("group_value = 'tiny'").collect()
    assert len(found) == len(_ladder(6001))
    for line in found:
        if line["sample_rows"] == 0:
            assert (line["estimate"], line["relative_error"]) == (0.0, 1.0)
        else:
            # all of its one row was seen
            assert (line["estimate"], line["relative_error"]) == (1.0, 0.0)


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_draw_is_the_sorted_prefix_on_any_partitioning(spark, method):
    order = SampleOrder(("k",), method, bucket_bits=8)
    df = table(spark, awkward_rows("plain"))
    expected = {r["k"] for r in ranked(df, order)[:777]}
    for partitions in (1, 7):
        drawn = sampling.draw(df.repartition(partitions), order, 777).collect()
        assert len(drawn) == 777 and {r["k"] for r in drawn} == expected


def test_draw_of_more_than_all(spark):
    df = table(spark, awkward_rows("hot key"))
    assert sampling.draw(df, SampleOrder(("k",), ties=("v", "g")), 10**6).count() == df.count()


def test_seed_changes_the_sample(spark):
    df = table(spark, awkward_rows("plain"))
    first, second = (
        {r["k"] for r in sampling.draw(df, SampleOrder(("k",), seed=s), 500).collect()}
        for s in (1, 2)
    )
    assert first != second


def test_strata_quota_with_a_null_stratum(spark):
    df = table(spark, awkward_rows("nulls"))
    order = SampleOrder(("k",))
    drawn = sampling.draw_per_stratum(df, order, "g", 40)
    assert {r["g"]: r["count"] for r in drawn.groupBy("g").count().collect()} == {
        None: 40,
        "x": 40 if any(r[1] == "x" for r in awkward_rows("nulls")) else 0,
        "y": 40,
    }
    expected = {
        g: {r["k"] for r in [r for r in ranked(df, order) if r["g"] == g][:40]}
        for g in (None, "x", "y")
    }
    for group, keys in expected.items():
        assert {r["k"] for r in drawn.collect() if r["g"] == group} == keys


def test_rows_past_the_cap_are_one_more_step(spark):
    df = table(spark, awkward_rows("plain"))
    steps = sampling.sample_rows(df, SampleOrder(("k",), bucket_bits=8), past_cap=True)
    counts = {r["sample_step"]: r["count"] for r in steps.groupBy("sample_step").count().collect()}
    sizes = _ladder(4000)
    expected = [b - a for a, b in zip([0, *sizes], [*sizes, 4000])]
    assert [counts[i] for i in range(1, len(expected) + 1)] == expected


def test_interval_coverage_over_many_seeds(spark, sf):
    """A nominal 95 % interval of a 512-row sample should hold the truth about that often."""
    prices = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    seeds = 200
    repeated = prices.select("*", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    order = SampleOrder(("o_orderkey", "seed"), bucket_bits=8)
    sampled = sampling.draw_per_stratum(repeated, order, "seed", 512)
    truth = prices.agg(F.sum("o_totalprice")).first()[0]
    sums = sampled.groupBy("seed").agg(
        F.count("*").alias("sample_rows"),
        F.lit(prices.count()).alias("population_rows"),
        F.sum("o_totalprice").alias("sum_y"),
        F.sum(F.col("o_totalprice") * F.col("o_totalprice")).alias("sum_yy"),
        F.count("*").alias("sum_x"),
        F.count("*").alias("sum_xx"),
        F.sum("o_totalprice").alias("sum_xy"),
    )
    estimates = with_estimates(sums, AggregateSpec("sum", "o_totalprice"), 0.95)
    held = estimates.where((F.col("ci_low") <= truth) & (F.col("ci_high") >= truth)).count()
    assert held >= 0.9 * seeds


def test_buckets_suit_the_table():
    order = SampleOrder(("k",))
    assert order.for_rows(1).bucket_bits == 8
    assert order.for_rows(10**8).bucket_bits == 16
    assert order.for_rows(10**13).bucket_bits == 20
    with pytest.raises(ValueError):
        SampleOrder(("k",), bucket_bits=9)


def test_columns_of_any_name(spark):
    """A table may use the names that the operators use inside."""
    names = ["priority", "bucket", "step", "total_rows", "rows_before", "x", "y"]
    df = spark.range(3000).select("id", *[(F.col("id") % 7).cast("double").alias(n) for n in names])
    order = SampleOrder(("id",), ties=("step",), bucket_bits=8)
    for name in names:
        spec = AggregateSpec("sum", name, group_by="bucket" if name != "bucket" else "step")
        lines = sampling.step_moments(df, spec, order).where("iteration = 1").collect()
        assert sum(r["sample_rows"] for r in lines) == 512 and len(lines) == 7
    drawn = sampling.draw(df, order, 100)
    assert drawn.columns == df.columns and drawn.intersect(df).count() == 100
    with pytest.raises(ValueError, match="sample_step"):
        sampling.draw(df.withColumnRenamed("x", "sample_step"), order, 1)
