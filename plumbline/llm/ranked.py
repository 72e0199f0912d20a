"""Ranked lexical search over a length-stratified index.

A document's normaliser ``m`` is its length in fiftieths of the mean, so documents of equal ``m`` form a
stratum in which a term's impact depends on its frequency alone. The index holds blocks of a stratum's
documents; a block lists, per term and frequency, the places of the documents that hold the term that often.
An impact is worked out once per term and frequency of a block. The highest frequencies bound what an item
can score in a block: blocks are visited from the highest bound down, and left out once it cannot
reach an item's fiftieth best score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import lean, stored, text_slices, word_hashes, words_of

#: documents of an index block, and blocks a task chooses among at a time
BLOCK_DOCS, BLOCKS_AT_A_TIME = 2048, 64
#: bytes of items that are searched for in one pass over the index; more items take further passes
MOST_ITEM_BYTES = 16 << 20
#: postings of an index partition
PARTITION_POSTINGS = 2_000_000

# Bytes of terms; only A-Z are lower-cased.
_FOLDED = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _FOLDED[_a : _b + 1] = np.arange(_a, _b + 1)
_FOLDED[0x41:0x5B] += 0x20

_FOUND = "kind int, doc_id long, n long, salt int, terms array<int>, tfs array<long>"
_BLOCKS = "m long, docs array<long>, run_term array<int>, run_tf array<long>, run_size array<int>, places binary"


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order, as UTF-8."""
    data = _FOLDED[np.frombuffer((text or "").encode(), np.uint8)].tobytes()
    return data.split()


class Items:
    """A batch of items: their distinct terms in order, and each item's terms as places in that list."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        own = [(k, sorted(set(terms_of(t)))) for k, t in items]
        own = [(k, t) for k, t in own if t]
        self.ids = [k for k, _ in own]
        self.terms = sorted({t for _, ts in own for t in ts})
        place = {t: i for i, t in enumerate(self.terms)}
        self.flat = np.array([place[t] for _, ts in own for t in ts], np.int64)
        self.starts = np.cumsum([0, *(len(t) for _, t in own)])
        data = np.frombuffer(b" ".join(self.terms), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in self.terms], dtype=np.int64) - 1
        begins = ends - np.array([len(t) for t in self.terms], np.int64)
        hashes = word_hashes(data, begins, ends, lower=False)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.data, self.begins, self.ends = data, begins, ends

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The term that each word is, or -1; bytes are compared, not hashes alone."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = word_hashes(data, starts, ends, lower=False)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        while True:  # equal hashes of two terms stand side by side
            term = self.order[at]
            open_ = np.flatnonzero((out < 0) & (self.hashes[at] == hashes))
            sizes = ends[open_] - starts[open_]
            fits = sizes == self.ends[term[open_]] - self.begins[term[open_]]
            for size in np.unique(sizes[fits]):
                some = open_[fits & (sizes == size)]
                step = np.arange(size)
                for part in np.array_split(some, max(1, len(some) * int(size) >> 22)):
                    mine = data[starts[part][:, None] + step]
                    same = (mine == self.data[self.begins[term[part]][:, None] + step]).all(axis=1)
                    out[part[same]] = term[part[same]]
            left = open_[out[open_] < 0]
            left = left[at[left] + 1 < len(self.hashes)]
            left = left[self.hashes[np.minimum(at[left] + 1, len(self.hashes) - 1)] == hashes[left]]
            if not len(left):
                return out
            at[left] += 1


def _found(items: Items):
    """Per document with terms one row; per batch one row (kind 1) of documents, lengths and frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                data = _FOLDED[data]
                starts, ends, owner = words_of(data, offsets)
                n = np.bincount(owner, minlength=last - first)
                place = items.places(data, starts, ends)
                hit = place >= 0
                key, tf = np.unique(owner[hit] * len(items.terms) + place[hit], return_counts=True)
                doc, term = np.divmod(key, max(len(items.terms), 1))
                holds, df = np.unique(term, return_counts=True)
                bounds = np.searchsorted(doc, np.arange(last - first + 1))
                kept = np.flatnonzero(n > 0)
                sizes = np.append(np.diff(bounds)[kept], len(holds))
                cuts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                ids = batch.column(0).slice(first, last - first).take(pa.array(kept))
                ids = pa.concat_arrays([ids, pa.array([len(kept)], pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(np.zeros(len(kept), np.int32), np.int32(1)), pa.int32()),
                        ids,
                        pa.array(np.append(n[kept], n.sum()), pa.int64()),
                        pa.array(rng.integers(0, 1 << 30, len(kept) + 1), pa.int32()),
                        pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([term, holds]), pa.int32())),
                        pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([tf, df]), pa.int64())),
                    ],
                    names=["kind", "doc_id", "n", "salt", "terms", "tfs"],
                )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents that follow each other with equal ``m``."""
    held: list[tuple] = []
    now, count = None, 0

    def block() -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        sizes = np.concatenate([h[1] for h in held])
        terms, tfs = (np.concatenate([h[k] for h in held]) for k in (2, 3))
        places = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((places, tfs, terms))
        terms, tfs = terms[order], tfs[order]
        new = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([now], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                one(terms[new], pa.int32()),
                one(tfs[new], pa.int64()),
                one(np.diff(np.append(new, len(terms))), pa.int32()),
                pa.array([places[order].astype("<u2").tobytes()], pa.binary()),
            ],
            names=["m", "docs", "run_term", "run_tf", "run_size", "places"],
        )

    for batch in batches:
        m = np.asarray(batch.column("m"), np.int64)
        at = 0
        while at < len(m):
            if held and (m[at] != now or count >= BLOCK_DOCS):
                yield block()
                held, count = [], 0
            now = int(m[at])
            same = int(np.searchsorted(m[at:], now, "right"))
            end = at + min(same, BLOCK_DOCS - count)
            part = batch.slice(at, end - at)
            lists = part.column("terms")
            held.append((
                pa.concat_arrays([part.column("doc_id")]),
                np.asarray(pc.list_value_length(lists), np.int64),
                np.asarray(lists.flatten(), np.int64),
                np.asarray(part.column("tfs").flatten(), np.int64),
            ))
            count += end - at
            at = end
    if held:
        yield block()


class _Block:
    """One block with the impacts of its terms."""

    def __init__(self, row: dict, weights: np.ndarray):
        self.docs = row["docs"]
        m = row["m"]
        term, tf, size = (np.array(row[k], np.int64) for k in ("run_term", "run_tf", "run_size"))
        self.places = np.frombuffer(row["places"], "<u2").astype(np.int64)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        self.values = np.repeat(impact, size).astype(float)
        last = np.flatnonzero(np.append(term[1:] != term[:-1], True))
        self.terms, self.highest = term[last], impact[last]
        ends = np.cumsum(size)[last]
        self.bounds = np.concatenate(([0], ends))

    def limits(self, items: Items) -> np.ndarray:
        """The most that each item can score here."""
        most = np.zeros(len(items.terms), np.int64)
        most[self.terms] = self.highest
        return np.add.reduceat(most[items.flat], items.starts[:-1])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)]
        first, each = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        done = np.cumsum(each)
        picked = np.repeat(first - done + each, each) + np.arange(int(done[-1]) if len(done) else 0)
        found = np.bincount(self.places[picked], self.values[picked], len(self.docs))
        return found.astype(np.int64)  # sums stay far below 2^53


def _best(scores: np.ndarray, ids: list, depth: int) -> list[tuple[int, bool, int | None]]:
    """The ``depth`` highest positive scores as ``(-score, id is null, id)``, in rank order."""
    at = np.flatnonzero(scores > 0)
    if len(at) > depth:
        at = at[scores[at] >= np.partition(scores[at], -depth)[-depth]]
    return sorted((-int(scores[k]), ids[k] is None, ids[k] or 0) for k in at)[:depth]


def _runs(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[list[_Block]]:
    held = []
    for batch in batches:
        for k in range(len(batch)):
            held.append(_Block(batch.slice(k, 1).to_pylist()[0], weights))
            if len(held) == BLOCKS_AT_A_TIME:
                yield held
                held = []
    if held:
        yield held


def _floors(items: Items, weights: np.ndarray, depth: int):
    """Per item the score of rank ``depth`` in the most promising block of each run: no answer ranks below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _runs(batches, weights):
            choice = np.array([b.limits(items) for b in blocks]).argmax(axis=0)
            item, floor = [], []
            for k, at in enumerate(choice):
                best = _best(blocks[at].scores(items.flat[items.starts[k] : items.starts[k + 1]]), blocks[at].docs, depth)
                if len(best) == depth:
                    item.append(k)
                    floor.append(-best[-1][0])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(floor, pa.int64())], names=["item", "floor"])

    return run


def _visited(items: Items, weights: np.ndarray, floors: np.ndarray, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        least = floors.copy()
        for blocks in _runs(batches, weights):
            limits = np.array([b.limits(items) for b in blocks])
            for k in range(len(items.ids)):
                for at in np.argsort(-limits[:, k], kind="stable"):
                    if limits[at, k] < max(least[k], 1):
                        break
                    found = blocks[at].scores(items.flat[items.starts[k] : items.starts[k + 1]])
                    found[found < least[k]] = 0
                    mine = sorted([*best.get(k, ()), *_best(found, blocks[at].docs, depth)])[:depth]
                    best[k] = mine
                    if len(mine) == depth:
                        least[k] = max(least[k], -mine[-1][0])
        rows = [(k, items.ids[k], None if null else doc, -score) for k, own in best.items() for score, null, doc in own]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["item", "item_id", "doc_id", "score"]
        )

    return run


def index(docs: DataFrame, items: Items) -> tuple[DataFrame, np.ndarray]:
    """The blocks of all documents for the terms of ``items``, stored, and the weight of each term."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(rows.mapInArrow(lean(_found(items)), _FOUND), "ranked-documents")
    totals = found.where("kind = 1")
    n_docs, length = totals.agg(F.sum("doc_id"), F.sum("n")).first()
    weights = np.zeros(len(items.terms), np.int64)
    postings = 0
    for row in (
        totals.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        .groupBy("x.terms").agg(F.sum("x.tfs").alias("df"))
        .collect()  # one line per term of the batch
    ):
        weights[row.terms] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
        postings += row.df
    if not postings:
        return spark.createDataFrame([], _BLOCKS), weights
    parts = -(-postings // PARTITION_POSTINGS)
    held = found.where("kind = 0 AND size(terms) > 0").selectExpr(
        f"50 + (50 * n * {n_docs}) div {length} AS m", "doc_id", "salt", "terms", "tfs"
    )
    # strata go to partitions in hashed order, so that those of long documents do not meet in one
    dealt = held.repartitionByRange(parts, F.xxhash64("m"), "m", "salt").sortWithinPartitions("m")
    blocks = dealt.mapInArrow(lean(_blocks), _BLOCKS)
    return stored(blocks, "ranked-index"), weights


def search(docs: DataFrame, items: DataFrame, depth: int = 50) -> DataFrame:
    """The ``depth`` highest-scoring documents of each item: ``item_id, rank, doc_id, score``.

    Null and empty texts, and texts without a term, rank nowhere and are found by nothing; they do not count
    as documents. Rows of ``docs`` are documents of their own, whatever their id; equal scores are
    ranked by ``doc_id``, a null one last. Rows of ``items`` that are equal in id and text are one item;
    others that share an id rank each on its own. Other columns are ignored; empty tables give no rows.
    Every item and every document takes part: items that exceed ``MOST_ITEM_BYTES`` together are
    dealt to several passes.
    """
    asked = items.selectExpr("CAST(item_id AS long) AS item_id", "CAST(text AS string) AS text").where("text <> ''").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // MOST_ITEM_BYTES))
    results = []
    for k in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        own = Items(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if not own.ids:
            continue
        blocks, weights = index(docs, own)
        floors = np.zeros(len(own.ids), np.int64)
        known = blocks.mapInArrow(lean(_floors(own, weights, depth)), "item int, floor long")
        for row in known.groupBy("item").agg(F.max("floor").alias("floor")).collect():  # one line per item of the pass
            floors[row["item"]] = row["floor"]
        results.append(
            blocks.mapInArrow(lean(_visited(own, weights, floors, depth)), "item int, item_id long, doc_id long, score long")
            .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
            .where(F.col("rank") <= depth)
            .select("item_id", "rank", "doc_id", "score")
        )
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, results)
