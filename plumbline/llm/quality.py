"""Quality: a regularised quadratic discriminant over transformed statistics of whole texts.

Every text becomes one vector: logarithms of counts and lengths, arcsines of the roots of shares, on
a fixed grid of 1/4096. Sums and products of grid values are whole numbers, so class means and
covariances are exact however the rows are dealt. Covariances shrink towards that of both classes
together and towards its diagonal; the amounts are chosen by five-fold cross-validation. A score is
the difference of two Mahalanobis log densities, taken through cached Cholesky factors and turned into a
chance on the folds that a model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean, stored, text_slices, word_hashes, words_of

#: what a text is described by, in the order of its vector
STATISTICS = (
    "words", "word_length", "spread_of_word_lengths", "words_per_line", "distinct_words", "repeats_of_the_word_before",
    "longest_run_of_a_word", "repeated_four_words", "words_without_letters", "words_in_capitals",
    "words_ending_in_other_signs", "words_ending_in_stops", "capitals", "rare_signs", "digits", "other_bytes",
)
GRID = 4096
FOLDS = 5
#: shares of the pooled covariance and of the diagonal that cross-validation chooses from
SHRINKAGE = tuple((pooled, diagonal) for pooled in (0.0, 0.1, 0.4) for diagonal in (0.02, 0.2, 0.6))
#: variance added to every statistic, in squared units of the statistic
RIDGE = 1e-4
_BINS = 4.0

_KIND = np.full(256, 4, np.uint8)  # 0 space, 1 small letter, 2 capital, 3 digit, 4 rare sign, 5 common sign, 6 beyond ASCII
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
_KIND[128:] = 6


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0.0, 1.0)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of grid values (64-bit whole numbers) per text of joined UTF-8 texts."""
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    kinds = _KIND[data]
    of_byte = np.repeat(np.arange(texts), sizes)
    per_kind = np.bincount(of_byte * 7 + kinds, minlength=7 * texts).reshape(texts, 7).astype(float)
    lines = np.bincount(of_byte[data == 0x0A], minlength=texts) + 1.0
    starts, ends, owner = words_of(data, offsets)
    lengths = (ends - starts).astype(float)
    keys = word_hashes(data, starts, ends, lower=False)
    words = np.bincount(owner, minlength=texts).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=texts).astype(float)

    def new(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        first = np.ones(len(values), bool)
        first[1:] = (values[order][1:] != values[order][:-1]) | (of[order][1:] != of[order][:-1])
        return np.bincount(of[order][first], minlength=texts).astype(float)

    again = np.zeros(len(starts), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    begins = np.flatnonzero(~again)
    runs = np.diff(np.append(begins, len(again)))
    longest = np.zeros(texts)
    np.maximum.at(longest, owner[begins], runs)
    four = max(len(starts) - 3, 0)
    inside = owner[3:] == owner[:four]
    with np.errstate(over="ignore"):
        grams = keys[:four].copy()
        for k in range(1, 4):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + keys[k : four + k]
    grams, of_gram = grams[inside], owner[:four][inside]
    total = np.bincount(of_gram, minlength=texts).astype(float)
    held = np.zeros((5, len(data) + 1), np.int64)
    for row, kind in enumerate((1, 2, 3, 6)):
        np.cumsum(kinds == kind, out=held[row, 1:])
    small, capital, _, beyond, _ = held[:, ends] - held[:, starts]
    last = kinds[ends - 1] if len(ends) else np.empty(0, np.uint8)
    mean = np.bincount(owner, lengths, texts) / np.maximum(words, 1)
    square = np.bincount(owner, lengths**2, texts) / np.maximum(words, 1)
    stops = np.isin(data[ends - 1], [ord("."), ord(",")]) if len(ends) else np.empty(0, bool)
    bytes_in_words = per_kind[:, 1:].sum(axis=1)
    out = np.stack(
        [
            np.log1p(words),
            np.log1p(mean),
            np.log1p(np.sqrt(np.maximum(square - mean**2, 0.0))),
            np.log1p(words / lines),
            _share(new(keys, owner), words),
            _share(count(again), words),
            np.log1p(longest),
            _share(total - new(grams, of_gram), total),
            _share(count(small + capital + beyond == 0), words),
            _share(count((capital > 1) & (small == 0)), words),
            _share(count(((last == 4) | (last == 5)) & ~stops), words),
            _share(count(stops), words),
            _share(per_kind[:, 2], per_kind[:, 1] + per_kind[:, 2]),
            _share(per_kind[:, 4], bytes_in_words),
            _share(per_kind[:, 3], bytes_in_words),
            _share(per_kind[:, 6], bytes_in_words),
        ],
        axis=1,
    )
    return np.rint(out * GRID).astype(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of every row, computed once from its whole text and stored.

    Null texts count as empty ones, whose vector is zero.
    """
    size = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((len(batch), size), np.int64)
            for first, last, data, offsets in text_slices(batch.column(1)):
                rows[first:last] = statistics(data, offsets)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), rows.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["doc_id", "stats"])

    rows = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text")
    return stored(rows.mapInArrow(lean(run), "doc_id long, stats array<long>"), "quality")


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Moments:
    """Number of rows, sum and sum of outer products of their grid values, in units of a statistic."""

    rows: float
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.rows + other.rows, self.sums + other.sums, self.products + other.products)

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.rows, 1.0)

    @property
    def scatter(self) -> np.ndarray:
        return self.products - np.outer(self.mean, self.mean) * self.rows


class Discriminant:
    """Two Gaussian classes; each keeps the inverse of the Cholesky factor of its covariance."""

    def __init__(self, classes: tuple[Moments, Moments], pooled: float, diagonal: float):
        rows = sum(c.rows for c in classes)
        both = sum(c.scatter for c in classes) / max(rows - 2.0, 1.0)
        self.means = [c.mean for c in classes]
        self.factors, self.shifts = [], []
        for c in classes:
            own = c.scatter / max(c.rows - 1.0, 1.0)
            own = (1.0 - pooled) * own + pooled * both
            own = (1.0 - diagonal) * own + diagonal * np.diag(np.diag(own)) + RIDGE * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.factors.append(np.linalg.inv(factor))
            self.shifts.append(np.log(max(c.rows, 1.0) / max(rows, 1.0)) - np.log(np.diag(factor)).sum())

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with their shares of the training rows."""
        each = [
            shift - 0.5 * (((rows - mean) @ factor.T) ** 2).sum(axis=1)
            for mean, factor, shift in zip(self.means, self.factors, self.shifts)
        ]
        return each[1] - each[0]


@dataclass(frozen=True)
class Model:
    """Chance of label 1: logistic in the inverse hyperbolic sine of the density difference."""

    discriminant: Discriminant | None
    slope: float
    shift: float
    shrinkage: tuple[float, float] | None = None

    def chances(self, stats: np.ndarray) -> np.ndarray:
        bent = np.arcsinh(self.discriminant.difference(stats / GRID)) if self.discriminant else np.zeros(len(stats))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * bent + self.shift, -40.0, 40.0)))


def _matrix(stats: pa.Array) -> np.ndarray:
    return np.asarray(stats.flatten(), np.int64).reshape(-1, len(STATISTICS))


def _moments(rows: DataFrame) -> dict[tuple[int, int], Moments]:
    """Exact moments of each fold and label: whole-number sums, combined on the map side."""
    size = len(STATISTICS)
    below = [(i, j) for i in range(size) for j in range(i + 1)]
    values = F.array(
        F.lit(1).cast("long"),
        *[F.col("stats")[i] for i in range(size)],
        *[F.col("stats")[i] * F.col("stats")[j] for i, j in below],
    )
    sums = (
        rows.select("fold", "label", values.alias("values"))
        .groupBy("fold", "label")
        .agg(*[F.sum(F.col("values")[k]).alias(f"s{k}") for k in range(1 + size + len(below))])
        .collect()  # one line per fold and label
    )
    out = {}
    for row in sums:
        own = np.array(row[2:], float)
        square = np.zeros((size, size))
        for (i, j), v in zip(below, own[1 + size :]):
            square[i, j] = square[j, i] = v
        out[row.fold, row.label] = Moments(own[0], own[1 : 1 + size] / GRID, square / GRID**2)
    return out


def _logistic(bent: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and mean loss of the chance of label 1, by Newton steps on binned rows."""
    x = np.stack([bent, np.ones(len(bent))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - label)) + 1e-2 * w
        bend = (x.T * (weight * p * (1 - p) + 1e-9)) @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    loss = -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum()
    return float(w[0]), float(w[1]), float(loss)


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Trains on all rows of ``stats`` that ``labels(doc_id, quality)`` marks and that are not held out.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the highest counts;
    rows that share an id count one by one. With one label only, or with fewer than two rows of a
    label, every score is the share of label 1 (0.5 without rows).
    """
    marks = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("label"))
    )
    rows = stored(
        stats.join(marks, "doc_id")
        .select("label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "stats"),
        "quality-labelled",
    )
    moments = _moments(rows)
    nothing = Moments(0.0, np.zeros(len(STATISTICS)), np.zeros((len(STATISTICS),) * 2))

    def classes(without: int | None) -> tuple[Moments, Moments]:
        return tuple(
            sum((m for (fold, label), m in moments.items() if label == want and fold != without), nothing)
            for want in (0, 1)
        )

    whole = classes(None)
    if min(c.rows for c in whole) < 2:
        share = (whole[1].rows + 0.5) / (whole[0].rows + whole[1].rows + 1.0)
        return Model(None, 0.0, float(np.log(share / (1.0 - share))))
    models = [[Discriminant(classes(fold), *s) for s in SHRINKAGE] for fold in range(FOLDS)]

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, fold = (np.asarray(batch.column(k)) for k in (0, 1))
            values = _matrix(batch.column(2)) / GRID
            for setting in range(len(SHRINKAGE)):
                found = np.zeros(len(label))
                for f in np.unique(fold):
                    found[fold == f] = models[f][setting].difference(values[fold == f])
                bins = np.rint(np.arcsinh(found) * _BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bins), setting, np.int32)), pa.array(label.astype(np.int32)), pa.array(bins)],
                    names=["setting", "label", "bin"],
                )

    seen = (
        rows.mapInArrow(lean(unseen), "setting int, label int, bin int")
        .groupBy("setting", "label", "bin")
        .count()
        .orderBy("setting", "label", "bin")
        .collect()  # a few hundred bins per setting
    )
    best = None
    for setting, shrinkage in enumerate(SHRINKAGE):
        own = np.array([(r["bin"], r["label"], r["count"]) for r in seen if r["setting"] == setting], float)
        slope, shift, loss = _logistic(own[:, 0] / _BINS, own[:, 1], own[:, 2])
        if best is None or loss < best[0] - 1e-9:
            best = loss, slope, shift, shrinkage
    return Model(Discriminant(whole, *best[3]), best[1], best[2], best[3])


def scored(stats: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Per row of ``described``: ``doc_id, held_out, score, predicted``.

    ``score`` is the chance of label 1, ``predicted`` is 1 from ``least`` on. Only the text counts: null
    and empty texts share one score, repeated rows score alike, other columns are ignored, and a
    row with a null ``doc_id`` is scored and not held out. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = model.chances(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chances)], names=["doc_id", "score"])

    return stats.mapInArrow(lean(run), "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
