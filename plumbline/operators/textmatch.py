"""Which field, which values and which aggregate a text speaks of, for whole tables of texts.

Fields are matched inside each row, against the words of a schema; nothing is shuffled and no job
runs while a frame is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import mentions
from plumbline.operators.profile import NUMERIC_TYPES

# What a token is, and the words that name an aggregate.
TOKEN = "[a-z0-9]+"
INTENT_WORDS = {
    "distinct": ("unique", "distinct", "dedup"),
    "avg": ("average", "avg", "mean"),
    "sum": ("total", "sum"),
}
TRUE_TOKENS = ("true", "yes", "y", "1")
FALSE_TOKENS = ("false", "no", "n", "0")
GROUP_MARK = " by "
GROUP_WEIGHT = 3


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def described_fields(profile: DataFrame, table: str) -> DataFrame:
    """Fields of a column profile with the text that describes them."""
    words = F.concat_ws(" ", "column", F.array_join("examples", " "))
    return profile.select(
        F.lit(table).alias("table"),
        F.col("column").alias("field"),
        "type",
        "position",
        words.alias("description"),
        "examples",
    )


def _field_index(fields: DataFrame) -> Column:
    """All fields of a schema as one array, each with the set of tokens that describe it.

    A scalar subquery whose size is that of the schema, not of any table.
    """
    one = F.struct(
        F.negative("position").alias("rank"), "field", tokens(F.col("description")).alias("tokens")
    )
    return fields.agg(F.collect_list(one).alias("index")).scalar()


def _best(index: Column, words: Column, after: Column | None = None) -> Column:
    """Highest score, the earliest field winning a tie; ``after`` are words that count once more each time.

    Words that describe no field are dropped first, in one hashed pass; the few that are left are
    intersected with the tokens of each field.
    """
    known = F.flatten(F.transform(index, lambda f: f["tokens"]))

    def scored(f: Column, few: Column) -> Column:
        score = F.size(F.array_intersect(few["words"], f["tokens"])).cast("long")
        if after is not None:
            score = score + GROUP_WEIGHT * F.size(F.array_intersect(few["after"], f["tokens"]))
        return F.struct(score.alias("score"), f["rank"].alias("rank"), f["field"].alias("field"))

    kept = [F.array_intersect(words, known).alias("words")]
    if after is not None:
        kept.append(F.array_intersect(after, known).alias("after"))
    # a list of one line binds what is used for every field
    scores = F.transform(F.array(F.struct(*kept)), lambda few: F.transform(index, lambda f: scored(f, few)))
    return F.array_max(F.flatten(scores))


def best_field(texts: DataFrame, text: str, ids: Sequence[str], fields: DataFrame) -> DataFrame:
    """Per row the field that shares most tokens with its text: ``field`` and ``score``.

    ``fields`` has ``field``, ``position`` and ``description``. A text without any shared token,
    also a null one, gets the first field, with score 0. Each text is scored inside its row.
    """
    words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    found = texts.select(*ids, words.alias("_words"), _field_index(fields).alias("_index"))
    return found.select(*ids, _best(F.col("_index"), F.col("_words")).alias("_best")).select(
        *ids, F.col("_best.field").alias("field"), F.col("_best.score").alias("score")
    )


def best_group_field(
    texts: DataFrame, text: str, ids: Sequence[str], fields: DataFrame
) -> DataFrame:
    """Per text with a " by " the field to group by; tokens after the last one count three times more.

    Texts without the mark, or without any shared token, have no row.
    """
    lowered = F.lower(F.col(text))
    found = texts.where(lowered.contains(GROUP_MARK)).select(
        *ids,
        tokens(lowered).alias("_words"),
        tokens(F.substring_index(lowered, GROUP_MARK, -1)).alias("_after"),
        _field_index(fields).alias("_index"),
    )
    return (
        found.select(*ids, _best(F.col("_index"), F.col("_words"), F.col("_after")).alias("_best"))
        .where("_best.score > 0")
        .select(*ids, F.col("_best.field").alias("field"), F.col("_best.score").alias("score"))
    )


def _said(words: Column) -> Column:
    """True or false, if the words say so; a word for true wins."""
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, TRUE_TOKENS))), True).when(
        F.arrays_overlap(words, F.array(*map(F.lit, FALSE_TOKENS))), False
    )


def boolean_mentions(
    texts: DataFrame, text: str, ids: Sequence[str], fields: DataFrame
) -> DataFrame:
    """Per row and boolean field whose name shares a token with the text: ``value``, if it says which.

    Example values do not count as names. A word for true anywhere in the text wins over one for
    false; a text with neither has no row.
    """
    named = fields.where(F.col("type") == "BOOLEAN").select(
        "field", "position", F.col("field").alias("description")
    )
    found = (
        texts.select(*ids, tokens(F.col(text)).alias("_words"))
        .withColumn("value", _said(F.col("_words")))
        .where(F.col("value").isNotNull())
        .select(*ids, "value", "_words", _field_index(named).alias("_index"))
    )
    met = F.filter("_index", lambda f: F.arrays_overlap(f["tokens"], "_words"))
    return found.select(*ids, "value", F.explode(met).alias("_met")).select(
        *ids, F.col("_met.field").alias("field"), "value"
    )


def typed_questions(
    texts: DataFrame, text: str, ids: Sequence[str], fields: DataFrame
) -> DataFrame:
    """Per row the question that its text asks of a table, fields being taken by type.

    ``fields`` has ``field``, ``position``, ``type``, ``description`` and ``examples``. Result:
    ``agg`` (see ``intent``), ``field`` (of a sum or mean the best numeric one, of a distinct count the
    best of all, else null), ``group_field`` (the best one that is not numeric, in a text with a
    " by " that names one) and ``filters``, an array of ``field`` and ``value`` in field order: of
    a boolean field named in the text what the text says, of other fields that are not numeric the first
    example that the text contains. Without a numeric field a sum or mean becomes a count. A null
    text counts as an empty one.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    numeric = F.col("type").isin(*NUMERIC_TYPES)
    described = F.struct(
        "position", "field", "type", tokens(F.col("field")).alias("names"),
        F.transform(F.col("examples"), lambda e: F.struct(F.lower(e).alias("lowered"), e.alias("value"))).alias("examples"),
    )
    rows = texts.select(
        *ids,
        lowered.alias("_text"),
        tokens(lowered).alias("_words"),
        tokens(F.substring_index(lowered, GROUP_MARK, -1)).alias("_after"),
        intent(lowered).alias("_agg"),
        _field_index(fields).alias("_all"),
        _field_index(fields.where(numeric)).alias("_numeric"),
        _field_index(fields.where(~numeric)).alias("_other"),
        fields.where(~numeric).agg(F.array_sort(F.collect_list(described)).alias("x")).scalar().alias("_described"),
    )

    def filtered(f: Column) -> Column:
        held = F.filter(f["examples"], lambda e: (e["lowered"] != "") & F.contains("_text", e["lowered"]))
        first = F.get(held, F.lit(0))["value"]
        example = F.when(f["type"] == "BOOLEAN", F.lower(first).isin(*TRUE_TOKENS).cast("string")).otherwise(first)
        named = (f["type"] == "BOOLEAN") & F.arrays_overlap(f["names"], "_words")
        value = F.coalesce(F.when(named, _said(F.col("_words")).cast("string")), example)
        return F.struct(f["field"].alias("field"), value.alias("value"))

    found = rows.select(
        *ids,
        "_agg",
        _best(F.col("_all"), F.col("_words")).alias("_any"),
        _best(F.col("_numeric"), F.col("_words")).alias("_number"),
        F.when(F.contains("_text", F.lit(GROUP_MARK)), _best(F.col("_other"), F.col("_words"), F.col("_after"))).alias("_group"),
        F.filter(F.transform("_described", filtered), lambda v: v["value"].isNotNull()).alias("filters"),
    )
    wants = F.col("_agg").isin("sum", "avg")
    return found.select(
        *ids,
        F.when(wants & F.col("_number").isNull(), "count").otherwise(F.col("_agg")).alias("agg"),
        F.when(wants, F.col("_number.field")).when(F.col("_agg") == "distinct", F.col("_any.field")).alias("field"),
        F.when(F.col("_group.score") > 0, F.col("_group.field")).alias("group_field"),
        "filters",
    )


def value_mentions(
    texts: DataFrame, text: str, ids: Sequence[str], values: DataFrame
) -> DataFrame:
    """Per row and field the first of the field's values that the text contains, in any case.

    ``values`` has ``field``, ``place`` (order within the field) and ``value``. A text is read once, however
    many values there are (``operators.mentions``): windows of the text are looked up by hash, so the work
    grows with the texts and what they hold, not with texts times values. Matches of a list of up to
    ``BLOCK_BYTES`` are folded inside the row; a longer one never leaves its executors, and matches are
    joined and folded by shuffle. Null and repeated ids keep every text.
    """
    listed = (
        values.where("value <> ''")
        .select("field", "place", "value", F.lower("value").alias("_value"))
        .orderBy("field", F.asc_nulls_first("place"), "value")
    )
    rows = texts.select(*ids, F.lower(F.col(text)).alias("_text")).where(F.col("_text").isNotNull())
    block = mentions.short_list(listed)
    if block is None:
        met = mentions.joined_matches(rows, "_text", ids, listed)
    elif not len(block):
        return texts.sparkSession.createDataFrame(
            [], texts.select(*ids).schema.add("field", "string").add("value", "string")
        )
    else:
        found = mentions.with_matches(rows, "_found", block, "_text").where(F.size("_found") > 0)
        met = found.select(*ids, F.explode("_found").alias("_m"))
    return met.select(*ids, F.col("_m.field").alias("field"), F.col("_m.value").alias("value"))


def intent(text: Column) -> Column:
    """``distinct``, ``avg``, ``sum`` or, when no word says otherwise, ``count``."""
    lowered = F.lower(text)

    def says(words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])

    named = [F.when(says(words), F.lit(name)) for name, words in INTENT_WORDS.items()]
    return F.coalesce(*named, F.lit("count"))


def intent_counts(texts: DataFrame, text: str) -> DataFrame:
    return texts.groupBy(intent(F.col(text)).alias("intent")).agg(F.count(F.lit(1)).alias("texts"))
