"""Toxicity: a support vector machine on subsequence string kernels with Nystroem landmarks.

The kernel of two words sums over the subsequences of four signs that both hold, each weighted by
``decay`` to the power of the length it spans, at most six signs: letters may be left out or
pushed in between. Signs that stand for no letter are skipped, the edges of a word are signs. Landmark words
span the space that the machine is trained in. Since the kernel's subsequences can be listed,
the trained expansion over landmarks is the same function as one weight per subsequence, and that
form scores every word of a corpus.

Labels belong to whole documents, so training runs over bags: the words that mark toxic documents
start as positives, words of clean documents are negatives, and after each fit every toxic
document adds its highest word. A document's score is that of its highest word, turned into a
probability on documents of the training sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, lean, text_slices, word_bounds, word_hashes, words_of

#: labelled documents that training reads at most, per label
MOST_TOXIC, MOST_CLEAN = 1_500, 3_000
#: words of clean documents that training compares with: the most common, random others, and, from each round, the
#: highest of the highest clean documents
MOST_COMMON, MOST_RARE, MOST_HARD = 6_000, 10_000, 600

#: signs of a subsequence, and the signs it may span
_SIGNS_OF, _SPAN = 4, 6
_LONG, _STRIDE = 32, 24
_KINDS = 32
_MOST_CACHED = 1 << 19

# Signs often written for letters.
_LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_EDGE = 31


def _sign_table() -> np.ndarray:
    """A class for each byte: letters 1-26, bytes of other scripts 27-30, 0 for signs that are skipped."""
    table = np.zeros(256, np.int32)
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = k + 1
    for sign, letter in _LOOKALIKES.items():
        table[ord(sign)] = table[ord(letter)]
    table[128:] = 27 + np.arange(128) % 4
    return table


_SIGNS = _sign_table()
_SKIPPED = bytes(np.flatnonzero(_SIGNS == 0).astype(np.uint8))
_OFFSETS = [
    (0, *inner, last)
    for last in range(_SIGNS_OF - 1, _SPAN)
    for inner in combinations(range(1, last), _SIGNS_OF - 2)
]


class Words:
    """Subsequences of words of one length: codes, their weights and the norm of each word."""

    def __init__(self, signs: np.ndarray, decay: float):
        n, length = signs.shape
        keys = []
        for places in _OFFSETS:
            if places[-1] < length:
                end = length - places[-1]
                code = np.zeros((n, end), np.int32)
                for p in places:
                    code = code * _KINDS + signs[:, p : p + end]
                keys.append(code * 8 + (places[-1] + 1))
        found = np.concatenate(keys, axis=1) if keys else np.zeros((n, 1), np.int32)
        found.sort(axis=1)
        self.codes = found >> 3
        self.weights = (decay ** np.arange(8)).astype(np.float32)[found & 7]
        if not keys:
            self.weights[:] = 0.0
        self.norms = self._norms()

    def _norms(self) -> np.ndarray:
        """Equal codes of a word add up before they are squared."""
        starts = np.empty(self.codes.shape, bool)
        starts[:, 0] = True
        starts[:, 1:] = self.codes[:, 1:] != self.codes[:, :-1]
        at = np.flatnonzero(starts.ravel())
        sums = np.add.reduceat(self.weights.ravel(), at) ** 2
        rows = np.searchsorted(at, np.arange(0, starts.size, starts.shape[1]))
        return np.sqrt(np.maximum(np.add.reduceat(sums, rows), 1e-12))


def _windows(word: bytes) -> list[bytes]:
    """The signs of a word that stand for letters; overlapping windows of them if they are many."""
    w = word.translate(None, _SKIPPED)
    return [w] if len(w) <= _LONG else [w[a : a + _LONG] for a in range(0, len(w) - _LONG + _STRIDE, _STRIDE)]


def _grouped(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, signs)`` of the words of each length, with a mark at either edge.

    Signs that stand for no letter are left out. Long words are cut into overlapping windows.
    """
    by_length: dict[int, tuple[list[int], list[bytes]]] = {}
    for i, w in enumerate(words):
        for p in _windows(w):
            places, own = by_length.setdefault(len(p), ([], []))
            places.append(i)
            own.append(p)
    for length, (places, own) in by_length.items():
        if not length:
            continue
        for at in range(0, len(own), 4_000):
            some = own[at : at + 4_000]
            signs = np.full((len(some), length + 2), _EDGE, np.int32)
            signs[:, 1:-1] = _SIGNS[np.frombuffer(b"".join(some), np.uint8).reshape(-1, length)]
            yield np.array(places[at : at + 4_000]), signs


class Detector:
    """Scores words by one weight per subsequence; ``base`` is the score of a word without any."""

    def __init__(self, weights: np.ndarray, base: float, scale: tuple[float, float], decay: float):
        self.weights, self.base, self.scale, self.decay = weights, base, scale, decay

    def words(self, words: list[bytes]) -> np.ndarray:
        scores = np.full(len(words), self.base)
        for places, signs in _grouped(words):
            w = Words(signs, self.decay)
            own = (self.weights[w.codes] * w.weights).sum(axis=1) / w.norms + self.base
            np.maximum.at(scores, places, np.where(w.norms > 1e-5, own, self.base))
        return scores

    def probability(self, score: np.ndarray) -> np.ndarray:
        slope, shift = self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(slope * score + shift, -40.0, 40.0)))


def spelled_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Words written as single signs apart: runs of three or more words of at most two bytes."""
    short = np.concatenate(([0], (ends - starts <= 2).astype(np.int8), [0]))
    step = np.diff(short)
    return [
        b"".join(data[starts[k] : ends[k]] for k in range(a, b))
        for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))
        if b - a >= 3
    ]


class Landmarks:
    """Unit vectors of landmark words over the subsequences that any of them holds."""

    def __init__(self, words: list[bytes], decay: float):
        self.decay = decay
        rows, codes, values = self._listed(words)
        self.codes, at = np.unique(codes, return_inverse=True)
        self.matrix = np.zeros((len(self.codes), len(words)), np.float32)
        np.add.at(self.matrix, (at, rows), values)

    def _listed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, codes, values = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.float32)]
        for places, signs in _grouped(words):
            found = Words(signs, self.decay)
            rows.append(np.repeat(places, found.codes.shape[1]))
            codes.append(found.codes.ravel())
            values.append((found.weights / found.norms[:, None]).ravel())
        return np.concatenate(rows), np.concatenate(codes), np.concatenate(values)

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """Kernel of each word with each landmark."""
        out = np.zeros((len(words), self.matrix.shape[1]), np.float32)
        for first in range(0, len(words), 250):
            rows, codes, values = self._listed(words[first : first + 250])
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            shared = np.flatnonzero(self.codes[at] == codes)
            shared = shared[np.argsort(rows[shared], kind="stable")]
            if len(shared):
                own, starts = np.unique(rows[shared], return_index=True)
                each = self.matrix[at[shared]] * values[shared, None]
                out[first + own] = np.add.reduceat(each, starts, axis=0)
        return out

    def expanded(self, weights: np.ndarray) -> np.ndarray:
        """One weight per subsequence for weights of the landmarks."""
        table = np.zeros(_KINDS**_SIGNS_OF, np.float32)
        table[self.codes] = self.matrix @ weights
        return table


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 30):
    """Weights and shift that minimise the squared hinge loss, by Newton steps over blocks of rows."""
    size = x.shape[1] + 1
    w = np.zeros(size)
    for _ in range(rounds):
        bend, slope = np.eye(size) * penalty, np.zeros(size)
        bend[-1, -1] = 1e-6
        for at in range(0, len(x), 2_000):
            rows = np.ones((min(2_000, len(x) - at), size))
            rows[:, :-1] = x[at : at + 2_000]
            label, each = y[at : at + 2_000], weight[at : at + 2_000]
            inside = label * (rows @ w) < 1.0
            own = rows[inside]
            bend += (own * each[inside, None]).T @ own
            slope += own.T @ (each[inside] * label[inside])
        new = np.linalg.solve(bend, slope)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], w[-1]


def _logistic(score: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift from scores to chances, with smoothed targets."""
    hits = int(label.sum())
    goal = np.where(label > 0, (hits + 1) / (hits + 2), 1 / (len(label) - hits + 2))
    x = np.stack([score, np.ones(len(score))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - goal) + 1e-3 * w
        w = w - np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + 1e-3 * np.eye(2), slope)
    return float(w[0]), float(w[1])


def fit(
    texts: list[str],
    labels: list[int],
    landmarks: int = 512,
    decay: float = 0.7,
    penalty: float = 0.3,
    rounds: int = 5,
    seed: int = 5,
) -> Detector:
    """Trains on documents with labels 0 and 1. With one label only, every score is that label's share."""
    label = np.array(labels, np.int8)
    nothing = np.zeros(_KINDS**_SIGNS_OF, np.float32)
    if len(set(labels)) < 2:
        sure = 20.0 if len(labels) and label[0] else -20.0
        return Detector(nothing, 0.0, (0.0, sure), decay)
    known: dict[bytes, int] = {}
    bags: list[np.ndarray] = []
    for t in texts:
        data = (t or "").encode()
        starts, ends = word_bounds(np.frombuffer(data, np.uint8))
        bag = {data[a:b].lower().strip(b".,;:!?\"'()") for a, b in zip(starts, ends)}
        bag.update(w.lower() for w in spelled_words(data, starts, ends))
        # long words train window by window, as they are scored
        bag = {piece for w in bag for piece in (_windows(w) if len(w) > _LONG else [w])}
        bags.append(np.array([known.setdefault(w, len(known)) for w in sorted(bag)], np.int32))
    words = list(known)
    del known
    toxic, clean = (np.zeros(len(words), np.int64) for _ in range(2))
    for bag, y in zip(bags, labels):
        (toxic if y else clean)[bag] += 1
    long_enough = np.array([len(w) >= 3 for w in words])
    gain = np.where(long_enough, _marking(toxic, clean, float(label.mean())), 0.0)
    if not gain.any():  # too few documents to tell: words of toxic documents alone
        gain = (long_enough & (toxic > 0) & (clean == 0)).astype(float)
    rng = np.random.default_rng(seed)
    first = [int(k) for k in np.argsort(-gain, kind="stable") if gain[k] > 0]
    negative = np.flatnonzero(long_enough & (clean > 0) & (gain == 0))
    common = negative[np.argsort(-clean[negative], kind="stable")][:MOST_COMMON]
    rare = rng.permutation(negative)[:MOST_RARE]
    negatives = list(dict.fromkeys([*common.tolist(), *rare.tolist()]))
    if not first or not negatives:
        return Detector(nothing, 0.0, (0.0, float(np.log(label.mean() / (1 - label.mean())))), decay)
    positives, hard = set(first), []
    for turn in range(rounds):
        others = [*hard[: landmarks // 3], *negatives]
        marks = list(dict.fromkeys([*first[: landmarks // 2], *others]))[:landmarks]
        space = Landmarks([words[k] for k in marks], decay)
        values, vectors = np.linalg.eigh((space.matrix.T @ space.matrix).astype(float))
        keep = values > 1e-4 * values.max()
        root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        pos, neg = sorted(positives), sorted({*negatives, *hard} - positives)
        x = space.kernel([words[k] for k in [*pos, *neg]]) @ root
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        often = np.sqrt(np.concatenate([toxic[pos], clean[neg]]) + 1.0)
        often[: len(pos)] *= 500 / often[: len(pos)].sum()
        often[len(pos) :] *= 2000 / often[len(pos) :].sum()
        w, shift = _svm(x, y, often, penalty)
        detector = Detector(space.expanded((root @ w).astype(np.float32)), float(shift), (1.0, 0.0), decay)
        del space, x
        scores = detector.words(words)
        top = np.array([bag[scores[bag].argmax()] if len(bag) else -1 for bag in bags])
        tops = np.where(top >= 0, scores[top], detector.base)
        if turn + 1 < rounds:
            by_score = [k for k in np.argsort(-tops, kind="stable") if not labels[k] and top[k] >= 0]
            line = max(tops[by_score[len(by_score) // 50]], 0.0) if by_score else 0.0
            positives |= {int(top[k]) for k in np.flatnonzero((label == 1) & (tops > line)) if not clean[top[k]]}
            hard = list(dict.fromkeys([*(int(top[k]) for k in by_score[:MOST_HARD]), *hard]))
    detector.scale = _logistic(tops, label)
    return detector


def _marking(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Gain of words found in toxic documents more often than chance explains, over all words; else 0."""
    both = np.maximum(toxic + clean, 1)
    part = toxic / both
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = toxic * np.log(part / share) + np.where(clean > 0, clean * np.log((1 - part) / (1 - share)), 0.0)
    wanted = (part > max(0.8, share)) & (gain > np.log((toxic > 0).sum() + 1) + 3.0)
    return np.where(wanted, gain, 0.0)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, **parameters
) -> Detector:
    """Trains on rows of ``labels(doc_id, toxic)`` that are not held out.

    At most ``most_toxic`` and ``most_clean`` labelled documents are read, those first in the order
    of a hash of their id. Rows with a null id or label are left out.
    """
    rows = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    mark = F.xxhash64("doc_id")
    chosen = (
        rows.where("toxic = 1").orderBy(mark).limit(most_toxic)
        .unionByName(rows.where("toxic = 0").orderBy(mark).limit(most_clean))
    )
    sample = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # its rows are bounded by the two parameters
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .toPandas()
        .sort_values("doc_id")
    )
    texts, marks = [t or "" for t in sample.text], [int(x) for x in sample.toxic]
    del sample
    detector = fit(texts, marks, **parameters)
    # the driver goes on with other steps; it keeps the detector alone
    del texts
    give_back()
    return detector


class _Scorer:
    """Highest word score of each text; a word is scored once per task."""

    def __init__(self, detector: Detector):
        self.detector = detector
        self.keys, self.scores = np.empty(0, np.uint64), np.empty(0)

    def _known(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        keys, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        seen = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        scores = np.empty(len(keys))
        scores[seen] = self.scores[at[seen]]
        new = np.flatnonzero(~seen)
        scores[new] = self.detector.words([data[starts[k] : ends[k]] for k in first[new]])
        if len(self.keys) + len(new) > _MOST_CACHED:
            self.keys, self.scores = keys, scores
        else:
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys, kind="stable")
            self.keys = all_keys[order]
            self.scores = np.concatenate([self.scores, scores[new]])[order]
        return scores[place]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        tops = np.full(len(offsets) - 1, self.detector.base)
        raw = data.tobytes()
        starts, ends, owner = words_of(data, offsets)
        if len(starts):
            scores = self._known(raw, starts, ends, word_hashes(data, starts, ends))
            np.maximum.at(tops, owner, scores)
        short = np.flatnonzero(ends - starts <= 2)
        for k in np.unique(owner[short]):
            own = slice(*np.searchsorted(owner, [k, k + 1]))
            spelled = spelled_words(raw, starts[own], ends[own])
            if spelled:
                tops[k] = max(tops[k], self.detector.words(spelled).max())
        return tops


def clean(docs: DataFrame, detector: Detector, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose own text is not predicted toxic (see ``scored``), with their columns."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(detector)
        for batch in batches:
            yield batch.filter(pa.array(_chances(scorer, batch.column(place)) < least))

    return docs.mapInArrow(lean(run), docs.schema)


def _chances(scorer: _Scorer, texts: pa.Array) -> np.ndarray:
    tops = np.empty(len(texts))
    for first, last, data, offsets in text_slices(texts):
        tops[first:last] = scorer.texts(data, offsets)
    return scorer.detector.probability(tops)


def scored(docs: DataFrame, detector: Detector, least: float = 0.3) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``.

    ``score`` is the chance of label 1; ``predicted`` is 1 from ``least`` on. Only the text counts.
    Null and empty texts get the score of a word without subsequences; a null ``doc_id`` is kept
    and not held out; repeated rows get equal scores; other columns are ignored. Long words are
    read in overlapping windows, long texts whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(detector)
        for batch in batches:
            chances = _chances(scorer, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chances)], names=["doc_id", "score"])

    return (
        docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text")
        .mapInArrow(lean(run), "doc_id long, score double")
        .select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "score",
            (F.col("score") >= least).cast("int").alias("predicted"),
        )
    )
