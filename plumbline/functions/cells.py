"""Cells as text, and what a text cell looks like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a boolean column, and the forms of numbers and dates.
TRUE_WORDS = ("true", "yes")
FALSE_WORDS = ("false", "no")
INTEGER_FORM = r"^[+-]?[0-9]+$"
DOUBLE_FORM = (
    r"(?i)^[+-]?(([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)(e[+-]?[0-9](_?[0-9])*)?"
    r"|inf|infinity|nan)$"
)
DAY_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
COMPACT_DAY_FORM = r"^[0-9]{8}$"
WEEK_FORM = r"^([0-9]{4})-?W([0-9]{2})(-?([1-7]))?$"
_SPACE = " \t\n\r\f\x0b"


def stripped(cell: Column) -> Column:
    """Cell without surrounding white space; NULL if nothing is left."""
    return F.nullif(F.trim(cell, F.lit(_SPACE)), F.lit(""))


def cell_text(column: Column, data_type: T.DataType, fractions: bool = False) -> Column:
    """A typed value as a text cell; NULL stays NULL (an empty cell).

    Doubles that are whole numbers lose their empty fraction, unless ``fractions``.
    """
    if isinstance(data_type, T.BinaryType):
        return F.lower(F.hex(column))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        # by way of a variant, whose keys come out sorted
        return F.to_json(F.try_parse_json(F.to_json(column)))
    if isinstance(data_type, T.VariantType):
        return variant_text(column)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return (double_text if fractions else _number_text)(column.cast("double"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(column, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return column.cast("string")


def _number_text(value: Column) -> Column:
    """A double as text; a whole number without its empty fraction."""
    whole = (F.floor(value).cast("double") == value) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("decimal(16,0)").cast("string")).otherwise(double_text(value))


def double_text(value: Column) -> Column:
    """A double as Python and SQL write it: ``0.0``, ``-0.0``, ``12345678.5``, ``1e+16``, ``nan``."""
    text, size = value.cast("string"), F.abs(value)
    # 20 places hold all 17 digits of what is not below 0.0001
    places = F.regexp_replace(value.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    power = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.concat(F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    short = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e-4) & (size < 1e16), places)
        .otherwise(F.concat(short, F.lit("e"), F.when(power < 0, "-").otherwise("+"), digits))
    )


def variant_text(value: Column, kind: Column | None = None) -> Column:
    """A JSON value as a text cell: strings bare, nested values as JSON with sorted keys.

    ``kind`` is its ``schema_of_variant``, if that is at hand.
    """
    kind = F.schema_of_variant(value) if kind is None else kind
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "DOUBLE", _number_text(F.try_variant_get(value, "$", "double")))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def is_boolean(text: Column) -> Column:
    return F.lower(text).isin(*TRUE_WORDS, *FALSE_WORDS)


def is_integer(text: Column) -> Column:
    return text.rlike(INTEGER_FORM)


def is_double(text: Column) -> Column:
    return text.rlike(DOUBLE_FORM)


def is_date(text: Column) -> Column:
    return to_date(text).isNotNull()


def to_boolean(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_double(text: Column) -> Column:
    return F.when(is_double(text), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def to_date(text: Column) -> Column:
    """Calendar dates, compact dates and ISO week dates; NULL for anything else."""
    compact = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    year = F.regexp_extract(text, WEEK_FORM, 1).try_cast("int")
    week = F.regexp_extract(text, WEEK_FORM, 2).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, WEEK_FORM, 4).try_cast("int"), F.lit(1))
    # the 4th of January always lies in the first ISO week
    fourth = F.concat_ws("-", year.cast("string"), F.lit("01-04")).try_cast("date")
    monday = F.date_add(F.trunc(fourth, "week"), (week - 1) * 7)
    week_date = F.when(F.weekofyear(monday) == week, F.date_add(monday, day - 1))
    return (
        F.when(text.rlike(DAY_FORM), text.try_cast("date"))
        .when(text.rlike(COMPACT_DAY_FORM), compact.try_cast("date"))
        .when(text.rlike(WEEK_FORM), week_date)
    )
