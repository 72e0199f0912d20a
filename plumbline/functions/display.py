"""Rounding, display text, labels and progress measures, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.spec import AggregateSpec

# Columns and name parts that hold money.
CURRENCY_COLUMNS = ("amount", "total_amount", "revenue")
CURRENCY_NAME_PART = "revenue"


def is_currency(spec: AggregateSpec) -> bool:
    if spec.column is None:
        return False
    return spec.column.lower() in CURRENCY_COLUMNS or CURRENCY_NAME_PART in spec.name


def decimals_shown(spec: AggregateSpec, integral: bool = False) -> int:
    """Decimal places of an answer; ``integral`` says that the column holds whole numbers."""
    if spec.agg == "count" or (spec.agg == "sum" and integral and not is_currency(spec)):
        return 0
    return 2


def rounded(value: Column, spec: AggregateSpec, integral: bool = False) -> Column:
    """Half-even rounding of the decimal notation of the value."""
    return F.bround(value.cast("double"), decimals_shown(spec, integral))


def display(value: Column, spec: AggregateSpec, integral: bool = False) -> Column:
    """``1,234``, ``1,234.56`` or ``$1,234.56``."""
    text = F.format_number(value, decimals_shown(spec, integral))
    return F.concat(F.lit("$"), text) if is_currency(spec) and spec.agg != "count" else text


def group_label(group: Column) -> Column:
    return F.coalesce(group.cast("string"), F.lit("NULL"))


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def sample_fraction(sample: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.bround(_share(sample, total), 4))


def scanned_pct(sample: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.bround(_share(sample, total) * 100, 2))


def saved_pct(scanned: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), 100 - scanned), 2)


def status(met: Column, iteration: Column) -> Column:
    return (
        F.when(met, "target_met").when(iteration == 1, "warming_up").otherwise("converging")
    )
