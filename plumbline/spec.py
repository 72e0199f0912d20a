"""What to aggregate: one table, one aggregate, AND-ed comparisons, at most one group column."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


@dataclass(frozen=True)
class Comparison:
    """``column op value``; a NULL column never passes, as in SQL."""

    column: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        if self.op not in _COMPARE:
            raise ValueError(f"unknown comparison {self.op!r}; use one of {sorted(_COMPARE)}")

    def expression(self) -> Column:
        return _COMPARE[self.op](F.col(self.column), F.lit(self.value))


@dataclass(frozen=True)
class AggregateSpec:
    """A ``count``, ``sum`` or ``avg`` question.

    ``scale`` is the number of decimal places of the column. When given, samples fold the
    values as decimals, so that estimates do not depend on the partitioning; without it they
    are folded as doubles.
    """

    agg: str
    column: str | None = None
    where: tuple[Comparison, ...] = ()
    group_by: str | None = None
    distinct: bool = False
    order_by: str | None = None
    descending: bool = False
    alias: str | None = None
    scale: int | None = None

    def __post_init__(self) -> None:
        if self.agg not in ("count", "sum", "avg"):
            raise ValueError(f"unknown aggregate {self.agg!r}")
        if self.column is None and (self.agg != "count" or self.distinct):
            raise ValueError(f"{self.agg} needs a column")
        if self.distinct and self.agg != "count":
            raise ValueError("distinct applies to count only")
        if self.order_by is not None:
            if self.group_by is None:
                raise ValueError("only a grouped answer can be ordered")
            if self.order_by not in (self.group_by, self.name):
                raise ValueError(f"order by {self.group_by!r} or {self.name!r}")

    @property
    def name(self) -> str:
        """Name of the answer column."""
        if self.alias:
            return self.alias
        return "row_count" if self.column is None else f"{self.agg}_{self.column}"

    @property
    def is_approximable_total(self) -> bool:
        return self.agg in ("sum", "avg")

    def filtered(self, df: DataFrame) -> DataFrame:
        """Rows that pass every comparison."""
        if not self.where:
            return df
        return df.where(reduce(operator.and_, (c.expression() for c in self.where)))

    def projected(self, df: DataFrame, *extra: str) -> DataFrame:
        """Filtered rows with only the group column, the aggregated column and ``extra``."""
        wanted = [self.group_by, self.column, *extra]
        return self.filtered(df).select(*dict.fromkeys(c for c in wanted if c))
