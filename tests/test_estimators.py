"""Estimators on hand-made sums."""

import math

import pytest

from plumbline import AggregateSpec
from plumbline.functions.estimators import normal_quantile
from plumbline.operators.adaptive import with_estimates

SCHEMA = (
    "sample_rows long, population_rows long, sum_y double, sum_yy double, sum_x double, "
    "sum_xx double, sum_xy double"
)


def estimate(spark, agg, values, population):
    present = [v for v in values if v is not None]
    x = len(values) if agg == "sum" else len(present)
    row = (
        len(values), population, float(sum(present)), float(sum(v * v for v in present)),
        float(x), float(x), float(sum(present)),
    )
    frame = spark.createDataFrame([row], SCHEMA)
    return with_estimates(frame, AggregateSpec(agg, "v"), 0.95).first()


def test_total_by_hand(spark):
    values, population = [100.0, 120.0, 90.0, 110.0], 40
    got = estimate(spark, "sum", values, population)
    mean = 105.0
    variance = sum((v - mean) ** 2 for v in values) / 3
    error = population * math.sqrt((1 - 4 / 40) * variance / 4)
    assert got["estimate"] == pytest.approx(4200.0)
    assert got["relative_error"] == pytest.approx(normal_quantile(0.95) * error / 4200.0)
    assert got["ci_low"] == pytest.approx(4200.0 - normal_quantile(0.95) * error)
    assert got["ci_high"] == pytest.approx(4200.0 + normal_quantile(0.95) * error)


def test_mean_leaves_out_nulls(spark):
    got = estimate(spark, "avg", [10.0, None, 20.0, 30.0], 100)
    assert got["estimate"] == pytest.approx(20.0)
    residual = 100.0 + 0.0 + 100.0
    error = math.sqrt((1 - 4 / 100) * (residual / 3) / (4 * 0.75 * 0.75))
    assert got["relative_error"] == pytest.approx(normal_quantile(0.95) * error / 20.0)


def test_total_counts_null_as_zero(spark):
    assert estimate(spark, "sum", [10.0, None], 10)["estimate"] == pytest.approx(50.0)


@pytest.mark.parametrize("agg", ["sum", "avg"])
def test_edges(spark, agg):
    whole = estimate(spark, agg, [1.0, 5.0, 9.0], 3)
    assert whole["relative_error"] == 0.0 and whole["ci_low"] == whole["ci_high"]
    assert estimate(spark, agg, [7.0, 7.0, 7.0], 50)["relative_error"] == 0.0
    single = estimate(spark, agg, [7.0], 50)
    assert single["relative_error"] == 1.0 and single["ci_low"] is None
    unseen = estimate(spark, agg, [], 50)
    assert (unseen["estimate"], unseen["relative_error"]) == (0.0, 1.0)
    nothing = estimate(spark, agg, [], 0)
    assert (nothing["estimate"], nothing["relative_error"]) == (0.0, 0.0)
    cancelled = estimate(spark, agg, [-5.0, 5.0], 50)
    assert (cancelled["estimate"], cancelled["relative_error"]) == (0.0, 1.0)


def test_mean_of_no_values(spark):
    assert estimate(spark, "avg", [None, None, None], 50)["relative_error"] == 1.0
    known = estimate(spark, "avg", [None, None, None], 3)
    assert (known["estimate"], known["relative_error"]) == (0.0, 0.0)


def test_confidence_must_be_a_share():
    with pytest.raises(ValueError):
        normal_quantile(1.0)
