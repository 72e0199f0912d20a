"""Benchmark decontamination: MinHash containment search in DataFrame operations.

Test items are short and documents long, so their Jaccard similarity says little; what counts is
the share of an item's shingles that a document holds. Items are partitioned by size. Each item
gets a MinHash sketch: its smallest shingle hashes, as many as its partition needs. Of an item
with at most ``u`` shingles a document that reaches the threshold misses at most ``m = u - ceil(t
* u)``, so of the ``m + extra`` smallest hashes it holds at least ``extra``: the search loses no
document, whatever its length. Candidates are verified by the exact shingles, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, joined_by, unused
from plumbline.session import stored

WORDS = 5
PERCENT = 75
#: smallest hashes of a sketch beyond those that may be missing
EXTRA = 4

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words; all ASCII signs but letters and digits separate."""
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def _shingles(text: Column, shape, short: tuple[int, ...] = ()) -> Column:
    """``shape`` of every run of five words; of the whole sequence if it is shorter.

    Runs of as many words as ``short`` lists (fewer than five) come after them. The words are bound to a lambda, so that they are split once and not once per shingle.
    """

    none = F.array().cast("array<bigint>" if shape is _hash else "array<string>")

    def of_size(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: shape(F.slice(w, i, n)))

    def runs(w: Column) -> Column:
        whole = F.when(F.size(w) >= WORDS, of_size(w, WORDS)).when(F.size(w) > 0, F.array(shape(w))).otherwise(none)
        if not short:
            return whole
        return F.concat(whole, *[F.when(F.size(w) >= n, of_size(w, n)).otherwise(none) for n in short])

    return F.get(F.transform(F.array(words_of(text)), runs), F.lit(0))


def _hash(words: Column) -> Column:
    return F.xxhash64(words)


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def _missing(size: Column, percent: int) -> Column:
    """How many of ``size`` shingles a document may lack."""
    return size - F.ceil(size * percent / 100)


def contained_items(
    docs: DataFrame, items: DataFrame, percent: int = PERCENT, extra: int = EXTRA
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of each item and document that holds it.

    Shingles are distinct runs of five words (see ``words_of``); a document holds an item if at
    least ``percent`` of the item's shingles are among its own. An item with fewer words has its
    whole sequence as one shingle, which is looked for among the runs of as many words of every
    document.

    Null and empty texts hold nothing and are held by nothing. Repeated rows, of documents or
    items, give each pair of ids once; texts that share an id are told apart and the best
    containment stands. Rows with a null id are found as well, a null ``item_id`` beside a null.
    Empty tables give no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = stored(
        items.select("item_id", F.array_distinct(_shingles(F.col("text").cast("string"), _text)).alias("own"))
        .where(F.size("own") > 0)
        .distinct()
        .select(F.xxhash64("item_id", "own").alias("item"), "item_id", "own", F.size("own").alias("n_item")),
        "items",
    )
    words = F.size(F.split(F.get("own", F.lit(0)), " "))
    short = tuple(r[0] for r in sized.select(words.alias("n")).where(f"n < {WORDS}").distinct().orderBy("n").collect())
    # partitions by size: an item's sketch is as long as the largest size of its partition needs
    largest = F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("long")
    sketch = F.slice(
        F.array_sort(F.transform("own", lambda s: F.xxhash64(F.split(s, " ")))),
        F.lit(1),
        (_missing(largest, percent) + extra).cast("int"),
    )
    held_at_least = F.size("sketch") - _missing(F.col("n_item"), percent)
    sketches = stored(
        sized.withColumn("sketch", sketch)
        .select("item", held_at_least.cast("int").alias("needed"), F.explode("sketch").alias("shingle"))
        .distinct(),
        "sketches",
    )
    mark = F.xxhash64("text").alias("mark")
    shingles = docs.select("doc_id", mark, F.explode(_shingles(F.col("text"), _hash, short)).alias("shingle"))
    found = stored(
        joined_by(shingles, sketches, "shingle", sketches.count())
        .groupBy("doc_id", "mark", "item")
        .agg(F.count_distinct("shingle").alias("held"), F.first("needed").alias("needed"))
        .where("held >= needed")
        .select("doc_id", "mark", "item"),
        "found",
    )
    few = found.count() <= BROADCAST_ROWS
    texts = found.select("doc_id", "mark").distinct().withColumnsRenamed({"doc_id": "of_doc", "mark": "of_mark"})
    own = (
        docs.join(
            F.broadcast(texts) if few else texts,
            F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.xxhash64("text") == F.col("of_mark")),
        )
        .select("of_doc", "of_mark", F.array_distinct(_shingles(F.col("text"), _text, short)).alias("shingles"))
        .dropDuplicates(["of_doc", "of_mark"])
    )
    pairs = found.join(
        own, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("mark") == F.col("of_mark"))
    ).select("doc_id", "item", "shingles")
    shared = F.size(F.array_intersect("own", "shingles"))
    return (
        pairs.join(sized, "item")
        .select("doc_id", "item_id", shared.cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"))
        .where(100 * F.col("n_shared") >= percent * F.col("n_item"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("best"))
        .select("doc_id", "item_id", "best.n_shared", "best.n_item", "best.containment")
    )


def clean_rows(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item, whatever their ids, with the columns they came with."""
    mark = F.xxhash64("text")
    texts = docs.select(mark.alias("doc_id"), "text")
    own = unused("leak", docs.columns)
    leaks = contained_items(texts, items, **parameters).select(F.col("doc_id").alias(own)).distinct()
    leaks = stored(leaks, "leaks")
    few = leaks.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(leaks) if few else leaks, mark == F.col(own), "left_anti")
