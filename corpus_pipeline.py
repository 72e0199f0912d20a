"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

A stage is run by who writes its result, so those with Python in their last step bound the batches of the
session: executors keep their memory from stage to stage, and whole texts by the 10,000 fill it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, mixing, ngram_join, tokens, toxicity
from plumbline.llm.common import BROADCAST_ROWS, unused
from plumbline.session import scratch_path, small_batches, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sized(small: DataFrame) -> DataFrame:
    """A stored side of a join, broadcast if it is short."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the string-kernel machine rejects go; others stay as they are.

    Null and empty texts hold no word that could be rejected and stay, ids do not matter, repeated rows
    share their fate, and an empty table stays empty.
    """
    small_batches(spark)
    detector = toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, detector)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts stays: that with the smallest ``doc_id``, null last.

    Texts are grouped by what they hold, so rows without an id are in groups too, and texts that
    share an id are told apart; of texts with the same smallest id one stays. Documents without
    shingles are in no group and stay, but of rows that repeat an id and its text one stays. An empty
    table stays empty.
    """
    mark = F.xxhash64("text")
    # names that no column of the documents has
    own_mark, best_mark, best_id = (unused(n, docs.columns) for n in ("mark", "best_mark", "best_id"))
    linked = ngram_join.similar_sets(docs.select(mark.alias("doc_id"), "text")).where("n_shingles > 0")
    groups = stored(linked.select(F.col("doc_id").alias(own_mark), "component_id").distinct(), "groups")
    ids = docs.select("doc_id", mark.alias(own_mark))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    texts = stored(ids.groupBy(own_mark).agg(first, F.count("*").alias("n")).join(groups, own_mark), "texts")
    best = (
        texts.groupBy("component_id")
        .agg(F.min(F.struct("first", F.col(own_mark).alias("text"))).alias("best"), F.sum("n").alias("n_rows"))
        .where("n_rows > 1")
        .select(
            "component_id", F.col("best.first.doc_id").alias(best_id), F.col("best.text").alias(best_mark)
        )
    )
    of_text = texts.join(_sized(stored(best, "best")), "component_id").select(own_mark, best_mark, best_id)
    kept = (
        docs.join(_sized(stored(of_text, "copies")), mark == F.col(own_mark), "left")
        .where(
            F.col(own_mark).isNull()
            | ((F.col(own_mark) == F.col(best_mark)) & F.col("doc_id").eqNullSafe(F.col(best_id)))
        )
        .select(*docs.columns)
    )
    again = (
        ids.groupBy("doc_id", own_mark).count().where("count > 1")
        .join(groups, own_mark, "left")
        .where("doc_id IS NOT NULL OR component_id IS NOT NULL")
        .select(F.col("doc_id").alias(best_id), own_mark)
    )
    again = stored(again, "again")
    if again.isEmpty():
        return kept
    again = _sized(again)
    same = F.col("doc_id").eqNullSafe(F.col(best_id)) & (mark == F.col(own_mark))
    twice = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(twice)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; each row is judged by its own text, whatever its id.

    Null and empty texts hold nothing and stay, repeated rows share their fate, an empty table stays empty.
    """
    return decontaminate.clean_rows(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    A null source is a source of its own, the last; null and empty texts have no words to be taken; an
    empty table stays empty.
    """
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; a row per document, read back from them.

    Null and empty texts have the end id alone, a null ``doc_id`` comes first, repeated rows are
    all written, and an empty table gives no rows.
    """
    small_batches(spark)
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(docs, path, tokens.word_tokenizer())
    return tokens.read_documents(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", test_items),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]

#: the stages rest on a trained model, hashes and a tokenizer, which SQL does not have
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
