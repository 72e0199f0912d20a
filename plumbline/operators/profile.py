"""Column types by full scan, example values, and the cast that follows from them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cells

# Type names, and the parts of a declared type that stand for them.
NUMERIC_TYPES = ("INTEGER", "BIGINT", "DOUBLE", "FLOAT", "REAL", "DECIMAL")
DECLARED_PARTS = (
    (("BOOL",), "BOOLEAN"),
    (("INT",), "INTEGER"),
    (("REAL", "FLOA", "DOUB", "DEC", "NUM"), "DOUBLE"),
    (("DATE", "TIME"), "DATE"),
)


def declared_type(declaration: str | None) -> str:
    """Type of a column that holds no value, from its declaration."""
    words = (declaration or "").upper()
    return next(
        (kind for parts, kind in DECLARED_PARTS if any(part in words for part in parts)), "TEXT"
    )


_FRACTIONS = "fractions"


def text_cells(df: DataFrame, fractions: bool = False) -> DataFrame:
    """All columns as text cells.

    With ``fractions`` doubles that are whole numbers read ``12.0``, as in SQL, and their columns are
    marked, so that such a cell still counts as a whole number; without, they read ``12``.
    """
    marks = [fractions and isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema]
    return df.select(
        *[
            cells.cell_text(F.col(f"`{f.name}`"), f.dataType, fractions).alias(f.name, metadata={_FRACTIONS: True} if mark else {})
            for f, mark in zip(df.schema, marks)
        ]
    )


# what a cell can look like, one bit each; whole numbers of three sorts
_BOOLEAN, _WHOLE, _LONG_WHOLE, _COMPACT_DAY, _FRACTION, _DAY, _OTHER = (1 << i for i in range(7))
_ANY_WHOLE = _WHOLE | _LONG_WHOLE | _COMPACT_DAY


def _looks(text: Column) -> Column:
    """The bit of a cell. Each cell is tested in order, until one form fits."""
    whole = (
        F.when((F.length(text) == 8) & cells.is_date(text), _COMPACT_DAY)
        .when(F.length(text) <= 18, _WHOLE)
        .when(text.try_cast("bigint").isNotNull(), _WHOLE)
        .otherwise(_LONG_WHOLE)
    )
    return (
        F.when(cells.is_boolean(text), _BOOLEAN)
        .when(cells.is_integer(text), whole)
        .when(cells.is_double(text), _FRACTION)
        .when(cells.is_date(text), _DAY)
        .when(text.isNotNull(), _OTHER)
    )


def column_profile(
    df: DataFrame, declared: Mapping[str, str] | None = None, forced_text: tuple[str, ...] = ()
) -> DataFrame:
    """One row per column of a frame of text cells.

    Columns: ``position``, ``column``, ``type``, ``fits_long``, ``filled_rows``, ``row_count``,
    ``examples`` (the two smallest distinct values). Every row is looked at; the two scans
    each end in one row of flags per task, whatever the number of distinct values.
    """
    declared = declared or {}
    texts = [cells.stripped(F.col(f"`{name}`")) for name in df.columns]
    smallest = df.agg(F.struct(*[F.min(text).alias(f"c{i}") for i, text in enumerate(texts)]))
    stripped = df.select(
        *[text.alias(f"c{i}") for i, text in enumerate(texts)], smallest.scalar().alias("least")
    )
    flags = []
    for i in range(len(texts)):
        text, least = F.col(f"c{i}"), F.col(f"least.c{i}")
        marked = df.schema[i].metadata.get(_FRACTIONS)
        look = _looks(F.regexp_replace(text, r"^(-?[0-9]{1,15})\.0$", "$1") if marked else text)
        flags += [
            F.coalesce(F.bit_or(look), F.lit(0)).alias(f"seen{i}"),
            F.count(text).alias(f"filled{i}"),
            F.min(text).alias(f"first{i}"),
            F.min(F.when(text > least, text)).alias(f"second{i}"),
        ]
    scanned = stripped.agg(F.count(F.lit(1)).alias("row_count"), *flags)

    def summary(i: int, name: str) -> Column:
        def only(bits: int) -> Column:
            seen = F.col(f"seen{i}")
            return (seen != 0) & (seen.bitwiseAND(~bits) == 0)

        otherwise = declared_type(declared.get(name))
        kind = (
            F.when(only(_BOOLEAN), "BOOLEAN")
            .when(only(_ANY_WHOLE), "INTEGER")
            .when(only(_ANY_WHOLE | _FRACTION), "DOUBLE")
            .when(only(_COMPACT_DAY | _DAY), "DATE")
            .otherwise(otherwise)
        )
        return F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            (F.lit("TEXT") if name in forced_text else kind).alias("type"),
            only(_ANY_WHOLE & ~_LONG_WHOLE).alias("fits_long"),
            F.col(f"filled{i}").alias("filled_rows"),
            "row_count",
            F.array_compact(F.array(f"first{i}", f"second{i}")).alias("examples"),
        )

    summaries = [summary(i, name) for i, name in enumerate(df.columns)]
    return scanned.select(F.inline(F.array(*summaries)))


@dataclass(frozen=True)
class ColumnType:
    name: str
    type: str
    fits_long: bool

    def cast(self) -> Column:
        text = cells.stripped(F.col(f"`{self.name}`"))
        if self.type == "BOOLEAN":
            return cells.to_boolean(text)
        if self.type == "INTEGER":
            # numbers of up to 38 digits keep them all; a marked column's end in ".0"
            return F.regexp_replace(text, r"\.0$", "").try_cast("bigint" if self.fits_long else "decimal(38,0)")
        if self.type == "DOUBLE":
            return cells.to_double(text)
        if self.type == "DATE":
            return cells.to_date(text)
        # text keeps its spaces; only an empty cell is NULL
        return F.nullif(F.col(f"`{self.name}`"), F.lit(""))


def column_types(profile: DataFrame) -> list[ColumnType]:
    """The profile as schema metadata on the driver: one small row per column."""
    rows = profile.orderBy("position").select("column", "type", "fits_long").collect()
    return [ColumnType(r["column"], r["type"], r["fits_long"] or False) for r in rows]


def typed(df: DataFrame, types: list[ColumnType]) -> DataFrame:
    """Text cells cast to their profiled types."""
    return df.select(*[t.cast().alias(t.name) for t in types])


def dataset_listing(profile: DataFrame, dataset: str) -> DataFrame:
    """One row for a dataset: row count, column types, and the questions it can answer."""
    numeric = F.col("type").isin(*NUMERIC_TYPES)
    has_numeric, has_other = F.max(numeric), F.max(~numeric)
    return profile.agg(
        F.max("row_count").alias("row_count"),
        F.array_sort(
            F.collect_list(F.struct("position", "column", "type", "examples"))
        ).alias("schema"),
        F.array_compact(
            F.array(
                F.lit("count"),
                F.lit("count_distinct"),
                F.when(has_numeric, "sum"),
                F.when(has_numeric, "avg"),
                F.when(has_numeric & has_other, "group_by"),
            )
        ).alias("capabilities"),
    ).select(F.lit(dataset).alias("dataset"), "*")
