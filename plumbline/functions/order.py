"""Seeded random order of rows.

A DataFrame has no row order, so "a random prefix" is defined by a hash of the row key: the
first n rows are those with the n smallest hashes. The same rows are drawn whatever the
partitioning, and after any lost executor.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil, log2

from pyspark.sql import Column
from pyspark.sql import functions as F

#: rows are first counted per hash range ("bucket") of about this many rows
ROWS_PER_BUCKET = 1 << 14
FEWEST_BITS, MOST_BITS = 8, 20


@dataclass(frozen=True)
class SampleOrder:
    """Columns that identify a row, and the hash that shuffles them.

    The keys should identify rows, since rows of one key are drawn together; a table without a
    key gets one from ``sources.layout.with_row_place``. ``xxhash64`` is the fast choice. ``md5``
    gives the same order in any other SQL engine.
    ``ties`` orders rows whose hashes are equal (columns that tell apart rows of equal keys).
    The table is counted in ``2**bucket_bits`` hash ranges, at most 2**20 whatever its size.
    """

    keys: tuple[str, ...]
    method: str = "xxhash64"
    seed: int | None = None
    ties: tuple[str, ...] = ()
    bucket_bits: int = 16

    def __post_init__(self) -> None:
        if self.method not in ("xxhash64", "md5"):
            raise ValueError(f"unknown hash {self.method!r}")
        if not self.keys:
            raise ValueError("name at least one key column")
        if self.bucket_bits % 4 or not FEWEST_BITS <= self.bucket_bits <= MOST_BITS:
            raise ValueError(f"bucket_bits must be a multiple of 4 in {FEWEST_BITS}..{MOST_BITS}")

    def for_rows(self, rows: int) -> "SampleOrder":
        """The same order, counted in a number of buckets that suits a table of ``rows``."""
        digits = ceil(log2(max(1.0, rows / ROWS_PER_BUCKET)) / 4)
        return replace(self, bucket_bits=min(MOST_BITS, max(FEWEST_BITS, 4 * digits)))

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.keys, *self.ties)))

    def priority(self) -> Column:
        """The hash that rows are ordered by."""
        salt = [] if self.seed is None else [F.lit(self.seed)]
        if self.method == "xxhash64":
            return F.xxhash64(*[F.col(k) for k in self.keys], *salt)
        texts = [F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in self.keys]
        return F.md5(F.concat_ws("|", *texts, *[s.cast("string") for s in salt]))

    def bucket(self, priority: Column) -> Column:
        """Number of the hash range, from 0; sorts like the hash itself."""
        if self.method == "xxhash64":
            return (F.shiftright(priority, 64 - self.bucket_bits) + (1 << (self.bucket_bits - 1))).cast("int")
        return F.conv(F.substring(priority, 1, self.bucket_bits // 4), 16, 10).cast("int")

    def ranking(self, priority: str) -> list[Column]:
        return [F.col(priority), *[F.col(t) for t in self.ties]]
