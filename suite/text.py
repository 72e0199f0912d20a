"""Fields, values and intents that texts speak of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.operators import textmatch
from plumbline.operators.profile import column_profile, text_cells
from suite.registry import query, table

_FIELD_TABLES = ("documents", "part")
_COLUMNS = {
    "documents": ("lang", "source"),
    "part": ("p_name", "p_brand", "p_type"),
    "conversations": ("role",),
    "events": ("event_type",),
}


def _profile(spark, sf, name):
    return column_profile(text_cells(table(spark, sf, name).select(*_COLUMNS[name])))


def _fields(spark, sf):
    """All described columns, numbered across their tables."""
    parts = [
        textmatch.described_fields(_profile(spark, sf, name), name).withColumn(
            "position", F.col("position") + 100 * i
        )
        for i, name in enumerate(_COLUMNS)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


_FIELDS_SQL = " UNION ALL ".join(
    f"""SELECT '{column}' AS field, {100 * i + j} AS position,
          '{column}' || ' ' || (SELECT string_agg(v, ' ' ORDER BY v) FROM (
            SELECT DISTINCT trim({column}) AS v FROM {name} WHERE trim({column}) <> ''
            ORDER BY v LIMIT 2)) AS description"""
    for i, (name, columns) in enumerate(_COLUMNS.items())
    for j, column in enumerate(columns)
)


def _tokens(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+'))"


_MATCH_SQL = f"""WITH fields AS ({_FIELDS_SQL}),
  ft AS (SELECT field, position, unnest({_tokens("description")}) AS token FROM fields)"""

_PICK = """
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS nth
             FROM scored)"""


@query(
    "token_match",
    _MATCH_SQL
    + f""",
  words AS (SELECT doc_id, unnest({_tokens("text")}) AS token FROM documents),
  scored AS (SELECT d.doc_id, f.field, f.position, count(ft.token) AS score
             FROM documents d CROSS JOIN fields f
             LEFT JOIN (SELECT doc_id, ft.field, ft.token FROM words JOIN ft USING (token)) ft
               ON ft.doc_id = d.doc_id AND ft.field = f.field
             GROUP BY ALL),
{_PICK}
  SELECT doc_id, field, score FROM ranked WHERE nth = 1""",
)
def token_match(spark, sf):
    documents = table(spark, sf, "documents")
    return textmatch.best_field(documents, "text", ["doc_id"], _fields(spark, sf))


@query(
    "token_match_grouped",
    _MATCH_SQL
    + f""",
  marked AS (SELECT doc_id, lower(text) AS t FROM documents WHERE lower(text) LIKE '% by %'),
  pieces AS (SELECT doc_id, {_tokens("t")} AS everything,
                    {_tokens("string_split(t, ' by ')[-1]")} AS after FROM marked),
  words AS (SELECT doc_id, unnest(everything) AS token, after FROM pieces),
  scored AS (SELECT doc_id, field, position,
               CAST(sum(CASE WHEN list_contains(after, token) THEN 4 ELSE 1 END) AS BIGINT) AS score
             FROM words JOIN ft USING (token) GROUP BY ALL),
{_PICK}
  SELECT doc_id, field, score FROM ranked WHERE nth = 1""",
)
def token_match_grouped(spark, sf):
    documents = table(spark, sf, "documents")
    return textmatch.best_group_field(documents, "text", ["doc_id"], _fields(spark, sf))


_VALUES_SQL = " UNION ALL ".join(
    f"""SELECT '{column}' AS field, row_number() OVER (ORDER BY v) AS place, v AS value FROM (
          SELECT DISTINCT trim({column}) AS v FROM {name} WHERE trim({column}) <> ''
          ORDER BY v LIMIT 2)"""
    for name, columns in _COLUMNS.items()
    for column in columns
)


@query(
    "value_mentions",
    f"""WITH known AS ({_VALUES_SQL})
        SELECT doc_id, field, arg_min(value, place) AS value FROM documents
        JOIN known ON contains(lower(text), lower(value)) GROUP BY doc_id, field""",
)
def value_mentions(spark, sf):
    parts = [
        _profile(spark, sf, name).select(
            F.col("column").alias("field"),
            F.posexplode("examples").alias("place", "value"),
        )
        for name in _COLUMNS
    ]
    known = reduce(lambda a, b: a.unionByName(b), parts)
    return textmatch.value_mentions(table(spark, sf, "documents"), "text", ["doc_id"], known)


@query(
    "value_mentions_many",
    """WITH known AS (
         SELECT 'word' AS field, row_number() OVER (ORDER BY w) AS place, w AS value
         FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w
               FROM benchmark))
       SELECT conv_id, turn, field, arg_min(value, place) AS value FROM conversations
       JOIN known ON contains(lower(text), value) GROUP BY conv_id, turn, field""",
)
def value_mentions_many(spark, sf):
    words = (
        table(spark, sf, "benchmark")
        .select(F.explode(textmatch.tokens(F.col("text"))).alias("value"))
        .distinct()
        # words are their own order
        .select(F.lit("word").alias("field"), F.col("value").alias("place"), "value")
    )
    texts = table(spark, sf, "conversations")
    return textmatch.value_mentions(texts, "text", ["conv_id", "turn"], words)


@query(
    "intent_counts",
    """SELECT intent, count(*) AS texts FROM (SELECT CASE
         WHEN regexp_matches(lower(text), 'unique|distinct|dedup') THEN 'distinct'
         WHEN regexp_matches(lower(text), 'average|avg|mean') THEN 'avg'
         WHEN regexp_matches(lower(text), 'total|sum') THEN 'sum'
         ELSE 'count' END AS intent FROM documents) GROUP BY intent""",
)
def intent_counts(spark, sf):
    return textmatch.intent_counts(table(spark, sf, "documents"), "text")


@query(
    "value_mentions_long",
    """WITH known AS (
         SELECT 'name' AS field, c_custkey AS place, c_name AS value FROM customer
         UNION ALL SELECT 'part', p_partkey, p_name FROM part
         UNION ALL SELECT 'word', w, CAST(w AS VARCHAR) FROM range(1000, 12000) r(w)),
       said AS (SELECT turn, role, text FROM conversations UNION ALL
                SELECT o_orderkey % 3, NULL, o_orderpriority || o_orderkey FROM orders)
       SELECT turn, role, field, value FROM (
         SELECT s.n, s.turn, s.role, field, arg_min(value, place) AS value
         FROM (SELECT *, row_number() OVER () AS n FROM said) s
         JOIN known ON contains(lower(text), lower(value)) GROUP BY ALL)""",
)
def value_mentions_long(spark, sf):
    """More than ten thousand values, and texts whose ids repeat or are null."""
    customers = table(spark, sf, "customer").selectExpr("'name' AS field", "c_custkey AS place", "c_name AS value")
    parts = table(spark, sf, "part").selectExpr("'part' AS field", "p_partkey AS place", "p_name AS value")
    numbers = spark.range(1000, 12000).selectExpr("'word' AS field", "id AS place", "CAST(id AS string) AS value")
    said = table(spark, sf, "conversations").select("turn", "role", "text")
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey % 3 AS turn", "CAST(NULL AS string) AS role", "concat(o_orderpriority, o_orderkey) AS text"
    )
    values = customers.unionByName(parts).unionByName(numbers)
    return textmatch.value_mentions(said.unionByName(orders), "text", ["turn", "role"], values)


@query(
    "boolean_mentions",
    f"""WITH words AS (SELECT doc_id, {_tokens("text")} AS t FROM documents),
      said AS (SELECT doc_id, t, CASE
                 WHEN list_has_any(t, ['true', 'yes', 'y', '1']) THEN TRUE
                 WHEN list_has_any(t, ['false', 'no', 'n', '0']) THEN FALSE END AS value FROM words)
      SELECT doc_id, field, value FROM said
      JOIN (SELECT DISTINCT lang AS field FROM documents) f ON list_contains(t, field)
      WHERE value IS NOT NULL""",
)
def boolean_mentions(spark, sf):
    """One boolean field per language of the documents."""
    documents = table(spark, sf, "documents")
    fields = documents.select(F.col("lang").alias("field")).distinct().select(
        "field", F.lit("BOOLEAN").alias("type"), F.hash("field").alias("position")
    )
    return textmatch.boolean_mentions(documents, "text", ["doc_id"], fields)


_TYPED_FIELDS = """described AS (
    SELECT * FROM (VALUES ('user_id', 1, 'INTEGER'), ('event_type', 3, 'TEXT'), ('value', 4, 'DOUBLE')) t(field, position, type)),
  seen AS (
    SELECT 'user_id' AS field, CAST(user_id AS VARCHAR) AS v FROM events
    UNION SELECT 'event_type', event_type FROM events UNION SELECT 'value', CAST(value AS VARCHAR) FROM events),
  examples AS (
    SELECT field, list(v ORDER BY v) AS examples FROM (
      SELECT *, row_number() OVER (PARTITION BY field ORDER BY v) AS nth FROM seen WHERE trim(v) <> '') WHERE nth <= 2 GROUP BY field),
  fields AS (
    SELECT field, position, type, examples, list_distinct(regexp_extract_all(
      lower(field || ' ' || array_to_string(examples, ' ')), '[a-z0-9]+')) AS tokens FROM described JOIN examples USING (field))"""


@query(
    "typed_questions",
    f"""WITH {_TYPED_FIELDS},
  asked AS (
    SELECT conv_id, turn, t, {_tokens("t")} AS words, {_tokens("string_split(t, ' by ')[-1]")} AS after,
      CASE WHEN regexp_matches(t, 'unique|distinct|dedup') THEN 'distinct' WHEN regexp_matches(t, 'average|avg|mean') THEN 'avg'
           WHEN regexp_matches(t, 'total|sum') THEN 'sum' ELSE 'count' END AS agg
    FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations
          UNION ALL SELECT event_id, 0, lower(event_type || ' total value by event type ' || event_id) FROM events
          UNION ALL SELECT event_id, 1, 'average by value ' || value FROM events
          UNION ALL SELECT event_id, 2, 'distinct user id ' || user_id FROM events)),
  scored AS (
    SELECT a.*, f.field, f.type, f.position, len(list_intersect(words, tokens)) AS score,
      len(list_intersect(words, tokens)) + 3 * len(list_intersect(after, tokens)) AS group_score
    FROM asked a CROSS JOIN fields f),
  best AS (
    SELECT conv_id, turn, t, agg,
      arg_max(field, score * 100 - position) AS any_field,
      arg_max(field, score * 100 - position) FILTER (type <> 'TEXT') AS number_field,
      arg_max(field, group_score * 100 - position) FILTER (type = 'TEXT') AS other_field,
      max(group_score) FILTER (type = 'TEXT') AS other_score
    FROM scored GROUP BY ALL)
  SELECT conv_id, turn, agg,
    CASE WHEN agg IN ('sum', 'avg') THEN number_field WHEN agg = 'distinct' THEN any_field END AS field,
    CASE WHEN contains(t, ' by ') AND other_score > 0 THEN other_field END AS group_field,
    coalesce((SELECT 'event_type=' || list_filter(examples, lambda e: contains(t, lower(e)))[1] FROM fields
              WHERE type = 'TEXT'), '') AS filters
  FROM best""",
)
def typed_questions(spark, sf):
    """Questions to the events table: what is summed must be a number, what is grouped by must not."""
    events = table(spark, sf, "events")
    fields = textmatch.described_fields(
        column_profile(text_cells(events.select("event_id", "user_id", "ts", "event_type", "value"), fractions=True)), "events"
    ).where(F.col("field").isin("user_id", "event_type", "value"))
    said = (
        table(spark, sf, "conversations").select("conv_id", "turn", "text")
        .unionByName(events.selectExpr("event_id AS conv_id", "0 AS turn", "concat(event_type, ' total value by event type ', event_id) AS text"))
        .unionByName(events.selectExpr("event_id AS conv_id", "1 AS turn", "concat('average by value ', value) AS text"))
        .unionByName(events.selectExpr("event_id AS conv_id", "2 AS turn", "concat('distinct user id ', user_id) AS text"))
    )
    asked = textmatch.typed_questions(said, "text", ["conv_id", "turn"], fields)
    shown = F.array_join(F.transform("filters", lambda f: F.concat_ws("=", f["field"], f["value"])), ";")
    return asked.select("conv_id", "turn", "agg", "field", "group_field", shown.alias("filters"))
