"""Sums that do not depend on the partitioning, for numbers of known decimal places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: whole numbers below this are exact as doubles
_EXACT = float(1 << 53)
#: finite values from here on are added as doubles, like NaN and infinities
_WILD = 1e30
_LOW_BITS = 26


def exact_total(column: str, scale: int | None) -> Column:
    """Sum of a numeric column as a double; NULL without values.

    With a scale values are added exactly. A double is split into two whole numbers that are summed on their
    own (no decimal is made per row); only values too large for that, and columns of other types, are
    added as decimals. A value that the scale would change is an error; NaN, infinities and values
    from 1e30 on add up as doubles do.
    """
    value = F.col(column).cast("double")
    if scale is None:
        return F.sum(value)
    told = F.concat(F.lit(f"{column} has more than {scale} decimal places: "), F.col(column))
    size = F.abs(value)
    wild = F.isnan(value) | (size >= _WILD)
    units = F.rint(value * float(10**scale))
    small = size * float(10**scale) < _EXACT
    whole = F.when(units / float(10**scale) == value, units.cast("long")).otherwise(F.raise_error(told).cast("long"))
    high = F.sum(F.when(small, F.shiftright(whole, _LOW_BITS)))
    low = F.sum(F.when(small, whole.bitwiseAND((1 << _LOW_BITS) - 1)))
    kind = f"decimal(38,{scale})"
    counted = high.cast("decimal(20,0)") * (1 << _LOW_BITS) + low.cast("decimal(20,0)")
    units_total = F.concat(counted.cast("decimal(38,0)").cast("string"), F.lit(f"e-{scale}")).cast(kind)
    large = F.col(column).cast(kind)
    kept = F.when(large.cast("double") == value, large).otherwise(F.raise_error(told).cast(kind))
    of_large = F.sum(F.when(~wild & ~small, kept))
    of_wild = F.sum(F.when(wild, value))
    none = F.lit(0).cast(kind)
    exact = (F.coalesce(units_total, none) + F.coalesce(of_large, none)).cast("double")
    counts = F.count(F.when(~wild, value))
    of_doubles = F.when(of_wild.isNotNull(), of_wild + exact).when(counts > 0, exact)
    of_others = F.sum(
        F.when(F.col(column).isNotNull(), F.when(large == F.col(column), large).otherwise(F.raise_error(told).cast(kind)))
    ).cast("double")
    # the type of a column is a constant, so that one branch is left before anything runs
    return F.when(F.typeof(F.max(column)).isin("double", "float"), of_doubles).otherwise(of_others)
