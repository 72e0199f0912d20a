"""The registered queries of this subpackage, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    alignment, decontaminate, licences, mixing, near_vectors, ngram_join, pii, pii_labels, quality, ranked, repeats, tokens, toxicity,
    urls,
)
from plumbline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pii.train(pii_labels.labelled_table(spark))
    return pii.find_personal_data(_table(spark, sf_dir, "documents"), model)


_LEAK_SQL = r"""
WITH words AS (
  SELECT doc_id AS id, false AS item,
         list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT item_id, true,
         list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')
  FROM benchmark WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT id, item, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      ELSE [array_to_string(w, ' ')] END) AS s
  FROM words WHERE len(w) > 0
  UNION
  SELECT id, item, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))
  FROM words JOIN (SELECT DISTINCT len(w) AS n FROM words WHERE item AND len(w) BETWEEN 1 AND 4) ON len(w) >= n
  WHERE NOT item
), sizes AS (
  SELECT id, count(*) AS n_item FROM shingles WHERE item GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingles i JOIN shingles d ON i.s = d.s WHERE i.item AND NOT d.item
  GROUP BY d.id, i.id
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes ON sizes.id = item_id WHERE 100 * n_shared >= 75 * n_item
"""


@_query("op2_contained_items", _LEAK_SQL)
def contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contained_items(docs, items)


@_query("op3_fragment_join")
def fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(_table(spark, sf_dir, "documents"))


@_query("op5_repeated_strings")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents"))


@_query("op6_token_blocks")
def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, tokens.word_tokenizer())
    return tokens.read_documents(spark, path)


@_query("op7_pivotal_mix")
def pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


#: host, path and verdict of the rules that ``pages`` are judged by
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

_URL_SQL = """
WITH RECURSIVE rules(rule_host, rule_path, decided) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), raw AS (
  SELECT page_id, url, html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT page_id, html, split_part(url, '://', 1) AS scheme, row_number() OVER () AS n,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*(\\?[^#]*)?', 1) AS query
  FROM raw
), tags AS (
  SELECT n, scheme, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag
  FROM cut WHERE host <> ''
), aims AS (
  SELECT n, scheme, host, path, CASE
      WHEN regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?\\s*canonical\\b')
        THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''>\\s]+)', 1)
      WHEN regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')
        THEN regexp_extract(tag, '(?is)\\burl\\s*=\\s*''?\\s*([^"''>\\s]+)', 1) END AS aim
  FROM tags
), full_aims AS (
  SELECT n, CASE WHEN contains(aim, '://') THEN aim
      WHEN starts_with(aim, '//') THEN scheme || ':' || aim
      WHEN starts_with(aim, '/') THEN scheme || '://' || host || aim
      ELSE scheme || '://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || aim
      END AS target
  FROM aims WHERE aim <> ''
), ends AS (
  SELECT n, substr(target, instr(target, '://') + 3) AS rest FROM full_aims
), links AS (
  SELECT c.host || c.path || c.query AS a,
         translate(regexp_extract(e.rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz')
           || regexp_extract(e.rest, '^[^/?#]*([^?#]*)', 1)
           || regexp_extract(e.rest, '^[^?#]*(\\?[^#]*)?', 1) AS b
  FROM ends e JOIN cut c USING (n)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), fits AS (
  SELECT host, path, arg_max(rule_host || rule_path,
           length(rule_host || rule_path) * 1000 + length(rule_host)) AS rule,
         arg_max(decided, length(rule_host || rule_path) * 1000 + length(rule_host)) AS decided
  FROM (SELECT DISTINCT host, path FROM cut
        UNION SELECT regexp_extract(b, '^[^/?]*'), regexp_extract(b, '^[^/?]*([^?]*)', 1) FROM links)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
), alias AS (
  SELECT r.a, bool_or(f.decided = 'allow') AS allows, bool_or(f.decided = 'block') AS blocks
  FROM reach r JOIN fits f ON f.host = regexp_extract(r.b, '^[^/?]*')
    AND f.path = regexp_extract(r.b, '^[^/?]*([^?]*)', 1)
  GROUP BY r.a
)
SELECT c.page_id, coalesce(c.host, '') AS host, coalesce(c.path, '') AS path, f.rule,
       coalesce(f.decided, CASE WHEN s.blocks AND NOT s.allows THEN 'block' ELSE 'allow' END) AS verdict
FROM cut c
LEFT JOIN fits f ON f.host = c.host AND f.path = c.path
LEFT JOIN alias s ON s.a = c.host || c.path || c.query
"""


@_query("op4_redirect_filter", _URL_SQL)
def redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(_table(spark, sf_dir, "pages"), rules)


@_query("op8_string_kernel")
def string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


@_query("op9_licence_paragraphs")
def licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(licences.notices_table(spark), docs))


@_query("op10_tiled_vectors")
def tiled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op11_quadratic_quality")
def quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.described(_table(spark, sf_dir, "documents"))
    return quality.scored(stats, quality.train(stats, _table(spark, sf_dir, "labels")))


_SEARCH_SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL
), docs AS (
  SELECT row, doc_id, w AS words, len(w)::BIGINT AS n FROM terms WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS length FROM docs
), postings AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM docs) GROUP BY row, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term, n_docs
), asked AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term
  FROM benchmark WHERE text IS NOT NULL
), scores AS (
  SELECT item_id, d.row, any_value(doc_id) AS doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // length))))::BIGINT AS score
  FROM asked JOIN postings p USING (term) JOIN weights USING (term) JOIN docs d ON d.row = p.row, totals
  GROUP BY item_id, d.row
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""


@_query("op12_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return alignment.aligned(docs, alignment.byte_tokenizer(), alignment.piece_tokenizer())


@_query("op13_stratified_search", _SEARCH_SQL)
def stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
