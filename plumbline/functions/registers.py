"""HyperLogLog arithmetic as columns: precision, register, rank, estimate."""

from __future__ import annotations

from math import ceil, log2, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half of the error target is spent on the sketch; 2**4 to 2**18 registers;
# bias constants of the small sizes; largest raw estimate per register for linear counting.
TARGET_SHARE = 0.5
LOWEST_PRECISION, HIGHEST_PRECISION = 4, 18
SMALL_ALPHA = {16: 0.673, 32: 0.697, 64: 0.709}
LINEAR_COUNTING_BELOW = 2.5


def precision_for(target_error: float) -> int:
    """Bits of the register index that bring the standard error below half the target."""
    if target_error <= 0:
        raise ValueError("target error must be positive")
    needed = (1.04 / max(TARGET_SHARE * target_error, 1e-9)) ** 2
    return min(HIGHEST_PRECISION, max(LOWEST_PRECISION, ceil(log2(needed))))


def standard_error(precision: int) -> float:
    return 1.04 / sqrt(1 << precision)


def register_and_rank(value: Column, precision: int, method: str) -> tuple[Column, Column]:
    """Register index from the low hash bits, rank of the first one-bit in the rest.

    ``md5`` uses the first 64 bits of the digest, as two 32-bit halves: a signed long cannot
    hold all 64 as a number.
    """
    if method == "xxhash64":
        hashed = F.xxhash64(value)
        index = hashed.bitwiseAND((1 << precision) - 1)
        rest = F.shiftrightunsigned(hashed, precision)
    elif method == "md5":
        digest = F.md5(value.cast("string"))
        high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
        index = low.bitwiseAND((1 << precision) - 1)
        rest = high * (1 << (32 - precision)) + F.shiftright(low, precision)
    else:
        raise ValueError(f"unknown hash {method!r}")
    rank = F.when(rest == 0, 65 - precision).otherwise(64 - precision - _highest_bit(rest))
    return index.cast("int"), rank.cast("int")


def _highest_bit(number: Column) -> Column:
    """Place of the highest one-bit of a positive long.

    The logarithm of the nearest double can be one too high, just below a power of two.
    """
    guess = F.floor(F.log2(number.cast("double"))).cast("int")
    power = F.call_function("shiftleft", F.lit(1).cast("long"), guess)
    return guess - F.when(power > number, 1).otherwise(0)


def estimate(harmonic_part: Column, filled: Column, precision: int) -> Column:
    """Cardinality from the sum of 2**-rank over ``filled`` non-empty registers."""
    size = 1 << precision
    alpha = SMALL_ALPHA.get(size, 0.7213 / (1 + 1.079 / size))
    empty = F.lit(size) - filled
    raw = F.lit(alpha * size * size) / (harmonic_part + empty)
    linear = F.lit(float(size)) * F.log(F.lit(float(size)) / F.nullif(empty, F.lit(0)))
    small = (raw <= LINEAR_COUNTING_BELOW * size) & (empty > 0)
    return F.when(small, linear).otherwise(raw)
