"""Cross-tokenizer alignment: tokens of two vocabularies that cover the same bytes, counted over a corpus.

Both tokenizers cut ``" " + text`` into byte ranges; where both end a token, a group ends, and every token of
one side is linked with every token of the other in its group. The first pass lists the distinct id pairs of
runs of documents. Pairs are dealt to 256 shards; each shard builds a minimal perfect hash of its pairs, under
which the documents holding a pair are counted in dense vectors that are summed up a tree, every
key being compared with the one stored at its place. The second pass aligns the documents again and looks
the counts of its pairs up.

A shard holds at most a 256th of all pairs of two vocabularies, whatever the corpus; a run of documents is
bounded by its bytes. Nothing is broadcast but the highest count of each id of the first vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import _mixed, lean, stored

SHARDS = 256
#: bytes of texts whose pairs are asked for together, and of those aligned at a time
RUN_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
#: words a worker remembers the alignment of; beyond, it keeps those it meets most often
MOST_UNITS = 350_000
#: pairs asked for per branch of a shard, and branches summed in one step of the tree
BRANCH_PAIRS, FAN_IN = 4_000_000, 16
_WIDE_GROUP = 4096

# White space, and signs that some regular expressions take for white space.
_W = r"\s\u180e\u200b\ufeff"
#: a word with the blanks before it; it ends before a blank (U+0020) that follows another sign than white space
_UNIT = re.compile(rf"[{_W}]*[^{_W}]+(?:(?! )[{_W}]+[^{_W}]*)*(?:[{_W}]+\Z)?|[{_W}]+\Z")
_OPEN = re.compile(rf"[{_W}]\Z")
_PLAIN_WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f "
_OTHER_WHITE = re.compile(r"[^\S\t-\r\x1c-\x1f ]|[\u180e\u200b\ufeff]")
#: signs of texts that the faster library encodes; beyond them libraries may differ in what a letter is
_BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
# Fixed value: how byte-level vocabularies cut texts before merging.
_PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_tokenizer() -> str:
    """Path of the byte-level vocabulary (A) of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_tokenizer() -> str:
    """Path of the sentence-piece vocabulary (B) of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


@dataclass
class Units:
    """What is known of a list of words: counts, digest and linked pairs (``first`` to ``first + size``) of each."""

    counts: np.ndarray  # tokens of A, tokens of B, groups, links; all 0 for a word that does not come back whole
    whole: np.ndarray
    digests: list[str]
    sizes: np.ndarray
    pairs: np.ndarray
    weights: np.ndarray


_NO_PAIRS = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def cut(text: str) -> list[str]:
    """The words of ``" " + text`` (see ``_UNIT``), each without the blank it begins with."""
    simple = text[0] != " " and text[-1] not in _PLAIN_WHITE and not any(f"{w} " in text for w in _PLAIN_WHITE)
    if simple and (text.isascii() or not _OTHER_WHITE.search(text)):
        return text.split(" ")
    return [w[1:] for w in _UNIT.findall(" " + text)]


class Aligner:
    """Both tokenizers and the alignment of words seen so far.

    Words are kept without their first blank.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        signs = _byte_signs()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[k] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        if any(" " in p.decode("utf-8", "replace").lstrip(" ") for p in self.bytes_b):
            raise ValueError("words cannot be aligned one by one: a piece goes on after a blank")
        self.merges_a = self._by_rank(path_a)
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # how an id is written inside a group, and at the end of its side of the group
        self.said_a, self.said_b = (
            np.array([[f"{k}{sign}" for k in range(len(of))] for sign in signs], object)
            for of, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))
        )
        self.digits = np.array([len(str(k)) + 1 for k in range(max(len(self.bytes_a), len(self.bytes_b)))])
        self._start()

    def _by_rank(self, path: str):
        """A faster encoder of A, if its merges are in the order of their ids and cut nothing else off."""
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, cutter = described["model"], described["pre_tokenizer"]
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocabulary.get(a + b, -1) for a, b in pairs]
        plain = described["normalizer"] is None and not model.get("ignore_merges") and cutter == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
        }
        if not plain or ids != list(range(256, 256 + len(ids))) or len(vocabulary) - len(ids) not in (256, 257):
            return None
        import tiktoken

        ranks = {self.bytes_a[k]: k for k in range(256 + len(ids))}
        return tiktoken.Encoding("a", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def _joined(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self.merges_a is None or _BEYOND_LATIN.search(text):
            return next(self._ids([text]))
        return np.array(self.merges_a.encode_ordinary(text), np.int64), np.array(self.b.encode(text[1:]), np.int64)

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.units = Units(np.zeros((0, 4), np.int64), np.zeros(0, bool), [], np.zeros(0, np.int64), *_NO_PAIRS)
        self.first = self.uses = np.zeros(0, np.int64)

    def _trim(self) -> None:
        """Keeps the half of the words that were met most often, none that was met once."""
        least = max(2, int(np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2]) + 1)
        kept = np.flatnonzero(self.uses >= least)
        words = list(self.known)
        at, _ = self.pairs_of(kept)
        u = self.units
        self.known = {words[k]: i for i, k in enumerate(kept.tolist())}
        self.units = Units(
            u.counts[kept], u.whole[kept], [u.digests[k] for k in kept.tolist()], u.sizes[kept], u.pairs[at], u.weights[at]
        )
        self.first = np.cumsum(self.units.sizes) - self.units.sizes
        self.uses = self.uses[kept] // 2

    def _ids(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = self.a.encode_batch_fast(texts, add_special_tokens=False)
        for x, y in zip(found, self.b.encode([t[1:] for t in texts], num_threads=1)):
            yield np.array(x.ids, np.int64), np.array(y, np.int64)

    def _comes_back(self, data: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        joined = (b"".join(map(of.__getitem__, ids)) for of, ids in ((self.bytes_a, a.tolist()), (self.bytes_b, b.tolist())))
        return all(j == data for j in joined)

    def _linked(self, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> Units:
        """Alignment of words that stand one after the other, ``ends`` being the byte after each."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        per_a, per_b = np.bincount(in_a, minlength=len(both)), np.bincount(in_b, minlength=len(both))
        unit = np.searchsorted(ends, both)
        links = per_a * per_b
        total = lambda values: np.bincount(unit, values, len(ends)).astype(np.int64)
        counts = np.stack([total(per_a), total(per_b), total(np.ones(len(both))), total(links)], axis=1)
        digests = self._digests(ends, a, b, in_a, in_b, per_a, per_b, unit)
        weight_a, weight_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        if len(links) and links.max() > _WIDE_GROUP:  # long runs of one sign: equal ids of a group count as one
            key, weight_a = np.unique(in_a * len(self.bytes_a) + a, return_counts=True)
            in_a, a = np.divmod(key, len(self.bytes_a))
            key, weight_b = np.unique(in_b * len(self.bytes_b) + b, return_counts=True)
            in_b, b = np.divmod(key, len(self.bytes_b))
            per_b = np.bincount(in_b, minlength=len(both))
        start_b = np.cumsum(per_b) - per_b
        each = per_b[in_a]
        done = np.cumsum(each)
        at_b = np.repeat(start_b[in_a] - done + each, each) + np.arange(int(done[-1]) if len(done) else 0)
        pairs = (np.repeat(a, each).astype(np.uint64) << np.uint64(32)) | b[at_b].astype(np.uint64)
        sizes = np.bincount(unit[np.repeat(in_a, each)], minlength=len(ends))
        return Units(
            counts, np.ones(len(ends), bool), digests, sizes, pairs, np.repeat(weight_a, each) * weight_b[at_b],
        )

    def _digests(self, ends, a, b, in_a, in_b, per_a, per_b, unit) -> list[str]:
        """The groups of each word as text: ids of A, a bar, ids of B; semicolons between groups."""
        start_a, start_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        last_a, last_b = ((np.diff(g, append=-1) != 0).astype(np.int64) for g in (in_a, in_b))
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + start_b[in_a]] = self.said_a[last_a, a]
        parts[np.arange(len(b)) + start_a[in_b] + per_a[in_b]] = self.said_b[last_b, b]
        text = "".join(parts.tolist())
        size = np.bincount(unit[in_a], self.digits[a], len(ends)) + np.bincount(unit[in_b], self.digits[b], len(ends))
        cut = [0, *np.cumsum(size).astype(np.int64).tolist()]
        return [text[x : y - 1] for x, y in zip(cut, cut[1:])]

    def _one_by_one(self, words: list[str]) -> Iterator[Units]:
        units = [f" {w}" for w in words]
        for unit, (a, b) in zip(units, self._ids(units)):
            data = unit.encode()
            if self._comes_back(data, a, b):
                yield self._linked(np.array([len(data)]), a, b)
            else:
                yield Units(np.zeros((1, 4), np.int64), np.zeros(1, bool), [""], np.zeros(1, np.int64), *_NO_PAIRS)

    def learn(self, words: list[str]) -> None:
        # words that end in white space could go on; all others are cut off by the blank of the next one
        open_ = [w for w in words if not w or _OPEN.search(w)]
        closed = words if not open_ else [w for w in words if w and not _OPEN.search(w)]
        order, found = [], []
        for at in range(0, len(closed), 8192):
            some = closed[at : at + 8192]
            joined = " " + " ".join(some)
            a, b = self._joined(joined)
            data = joined.encode()
            order += some
            if self._comes_back(data, a, b):
                found.append(self._linked(np.cumsum([len(w.encode()) + 1 for w in some]), a, b))
            else:
                found.extend(self._one_by_one(some))
        order += open_
        found.extend(self._one_by_one(open_))
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))
        all_ = [self.units, *found]
        digests = self.units.digests
        for u in found:
            digests += u.digests
        self.units = Units(
            *(np.concatenate([getattr(u, f) for u in all_]) for f in ("counts", "whole")),
            digests,
            *(np.concatenate([getattr(u, f) for u in all_]) for f in ("sizes", "pairs", "weights")),
        )
        self.first = np.cumsum(self.units.sizes) - self.units.sizes
        self.uses = np.append(self.uses, np.zeros(len(order), np.int64))

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as places in ``units``, and how many each text has."""
        each = [cut(t) if t else [] for t in texts]
        flat = [w for ws in each for w in ws]
        new = set(flat).difference(self.known)
        if len(self.known) + len(new) > MOST_UNITS and self.known:
            self._trim()
            new = set(flat).difference(self.known)
        if new:
            self.learn(list(new))
        places = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        self.uses += np.bincount(places, minlength=len(self.known))
        return places, np.array([len(ws) for ws in each], np.int64)

    def pairs_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``pairs`` of all links of the given words, and how many places each word has."""
        each = self.units.sizes[units]
        done = np.cumsum(each)
        return np.repeat(self.first[units] - done + each, each) + np.arange(int(done[-1]) if len(done) else 0), each


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    """One aligner per Python worker: words learnt in one task serve the next ones, of either pass."""
    if paths not in _aligners:
        _aligners.clear()
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _whole_texts(aligner: Aligner, units: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(owner, ~aligner.units.whole[units], texts) == 0


# ---- minimal perfect hashing


class PerfectHash:
    """Places 0 to n - 1 for n distinct keys: levels of bit arrays, each holding the keys that meet no other there."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(bits) - 1

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = max(2 * len(keys), 8)
            at = cls._places(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate([*levels, np.zeros(0, bool)]))

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            own = _mixed(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        return (own % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; keys it was not built from get some place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._places(keys[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left, base = left[~hit], base + size
        return out

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, sizes: list[int], data: bytes) -> PerfectHash:
        return cls(sizes, np.unpackbits(np.frombuffer(data, np.uint8))[: sum(sizes)].astype(bool))


class _Shard:
    """The pairs of a shard in the order of their hash."""

    def __init__(self, row: dict):
        self.hash = PerfectHash.unpacked(row["sizes"], row["bits"])
        self.keys = np.frombuffer(row["keys"], "<u8")

    def places(self, keys: np.ndarray) -> np.ndarray:
        at = self.hash(keys)
        if len(keys) and not (self.keys[at] == keys).all():
            raise ValueError("a pair is asked for that no document holds")
        return at


# ---- the jobs

_ASKED = "shard int, run long, keys binary, counts binary"
_FUNCTIONS = "shard int, sizes array<long>, bits binary, keys binary"
_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers runs of documents of about ``RUN_BYTES``."""
    run, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
        before = held + np.cumsum(sizes) - sizes
        runs = run + before // RUN_BYTES
        held += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array(runs), *batch.columns], names=["run", "doc_id", "text"])


def _by_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        runs = np.asarray(batch.column("run"), np.int64)
        cuts = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        for first, last in zip(cuts, [*cuts[1:], len(runs)]):
            if last > first:
                yield int(runs[first]), batch.slice(first, last - first)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(np.concatenate(keys), return_inverse=True)
    return own, np.bincount(place, np.concatenate(counts), len(own)).astype(np.int64)


def _asked(paths: tuple[str, str]):
    """Distinct pairs of each run with the number of its documents that hold them, dealt to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(paths)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        now = None

        def rows() -> pa.RecordBatch:
            own, count = _summed(keys, counts)
            shard = (_mixed(own) >> np.uint64(56)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            used = np.flatnonzero(np.diff(cuts))
            parts = [order[cuts[s] : cuts[s + 1]] for s in used]
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array([now] * len(used), pa.int64()),
                    pa.array([own[p].astype("<u8").tobytes() for p in parts], pa.binary()),
                    pa.array([count[p].astype("<u4").tobytes() for p in parts], pa.binary()),
                ],
                names=["shard", "run", "keys", "counts"],
            )

        for number, batch in _by_run(batches):
            if keys and number != now:
                yield rows()
            now = number
            texts = batch.column("text").to_pylist()
            for first, last in _slices(texts):
                units, each = aligner.words(texts[first:last])
                owner = np.repeat(np.arange(last - first), each)
                whole = _whole_texts(aligner, units, owner, last - first)
                known = len(aligner.known)
                doc, unit = np.divmod(np.unique((owner * known + units)[whole[owner]]), max(known, 1))
                at, sizes = aligner.pairs_of(unit)
                own, place = np.unique(aligner.units.pairs[at], return_inverse=True)
                held = np.unique(np.repeat(doc, sizes) * len(own) + place)
                if len(own):
                    keys.append(own)
                    counts.append(np.bincount(held % len(own), minlength=len(own)))
            if len(keys) > 8:
                merged = _summed(keys, counts)
                keys[:], counts[:] = [merged[0]], [merged[1]]
        if keys:
            yield rows()

    return run


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minimal perfect hash of each shard, from rows sorted by shard."""
    held: list[np.ndarray] = []
    now, size = None, 0

    def row() -> pa.RecordBatch:
        keys = np.unique(np.concatenate(held))
        own = PerfectHash.of(keys)
        ordered = np.empty_like(keys)
        ordered[own(keys)] = keys
        return pa.RecordBatch.from_arrays(
            [
                pa.array([now], pa.int32()),
                pa.array([own.sizes], pa.list_(pa.int64())),
                pa.array([own.packed()], pa.binary()),
                pa.array([ordered.astype("<u8").tobytes()], pa.binary()),
            ],
            names=["shard", "sizes", "bits", "keys"],
        )

    for batch in batches:
        for shard, keys in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and shard != now:
                yield row()
                held, size = [], 0
            now = shard
            held.append(np.frombuffer(keys.as_py(), "<u8"))
            size += len(held[-1])
            if size > 4_000_000 and len(held) > 1:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
    if held:
        yield row()


def _with_functions(asked: DataFrame, functions: DataFrame, fan: int) -> DataFrame:
    """Rows of a branch of a shard side by side, its function first."""
    branches = F.explode(F.array(*[F.lit(k) for k in range(fan)])) if fan <= 1024 else F.explode(F.sequence(F.lit(0), F.lit(fan - 1)))
    first = functions.withColumn("branch", branches).withColumn("run", F.lit(-1).cast("long"))
    rest = asked.withColumn("branch", F.pmod(F.xxhash64("run"), F.lit(fan)).cast("int"))
    return (
        first.unionByName(rest, allowMissingColumns=True)
        .repartition("shard", "branch")
        .sortWithinPartitions("shard", "branch", "run")
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One dense vector of counts per branch of a shard, in the order of its hash."""
    shard = vector = now = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([vector.tobytes()], pa.binary())],
            names=["shard", "branch", "vector"],
        )

    for batch in batches:
        for at in range(len(batch)):
            r = batch.slice(at, 1).to_pylist()[0]
            if r["run"] < 0:
                if now is not None:
                    yield row()
                now, shard = (r["shard"], r["branch"]), _Shard(r)
                vector = np.zeros(len(shard.keys), "<i8")
            else:  # the pairs of a row are distinct
                vector[shard.places(np.frombuffer(r["keys"], "<u8"))] += np.frombuffer(r["counts"], "<u4")
    if now is not None:
        yield row()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of equal shard and branch, from sorted rows."""
    now = total = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            names=["shard", "branch", "vector"],
        )

    for batch in batches:
        for shard, branch, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = np.frombuffer(vector.as_py(), "<i8")
            if (shard, branch) == now:
                total = total + own
                continue
            if now is not None:
                yield row()
            now, total = (shard, branch), own
    if now is not None:
        yield row()


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, vector in zip(batch.column(0), batch.column(1)):
            a = (np.frombuffer(keys.as_py(), "<u8") >> np.uint64(32)).astype(np.int64)
            count = np.frombuffer(vector.as_py(), "<i8")
            own, place = np.unique(a, return_inverse=True)
            best = np.zeros(len(own), np.int64)
            np.maximum.at(best, place, count)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(best)], names=["a", "best"])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corpus-wide counts of the pairs each run asked for."""
    shard = vector = None
    for batch in batches:
        for at in range(len(batch)):
            r = batch.slice(at, 1).to_pylist()[0]
            if r["run"] < 0:
                shard, vector = _Shard(r), np.frombuffer(r["vector"], "<i8")
                continue
            found = vector[shard.places(np.frombuffer(r["keys"], "<u8"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["run"]], pa.int64()), pa.array([r["keys"]], pa.binary()), pa.array([found.tobytes()], pa.binary())],
                names=["run", "keys", "counts"],
            )


def _looked_up(paths: tuple[str, str], best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(paths)
        now, keys, counts = None, [], []
        for number, batch in _by_run(batches):
            if number != now:
                now, keys, counts = number, [], []
            answers = pc.is_valid(batch.column("keys"))
            for k, c in zip(*(batch.filter(answers).column(x).to_pylist() for x in ("keys", "counts"))):
                keys.append(np.frombuffer(k, "<u8"))
                counts.append(np.frombuffer(c, "<i8"))
            rest = batch.filter(pc.invert(answers))
            if not len(rest):
                continue
            if len(keys) > 1:
                all_keys = np.concatenate(keys)
                order = np.argsort(all_keys, kind="stable")
                keys, counts = [all_keys[order]], [np.concatenate(counts)[order]]
            ids, texts = rest.column("doc_id"), rest.column("text").to_pylist()
            for first, last in _slices(texts):
                yield _results(aligner, ids.slice(first, last - first), texts[first:last], keys, counts, best)

    return run


def _results(aligner: Aligner, ids: pa.Array, texts: list, keys: list, counts: list, best: np.ndarray) -> pa.RecordBatch:
    units, each = aligner.words(texts)
    owner = np.repeat(np.arange(len(texts)), each)
    whole = _whole_texts(aligner, units, owner, len(texts))
    numbers = np.zeros((len(texts), 6), np.int64)
    used = np.unique(units[whole[owner]])
    own = np.zeros((len(aligner.known), 6), np.int64)
    own[:, :4] = aligner.units.counts
    if len(used):
        at, sizes = aligner.pairs_of(used)
        pair, weight = aligner.units.pairs[at], aligner.units.weights[at]
        place = np.searchsorted(keys[0], pair)
        if not (keys[0][np.minimum(place, len(keys[0]) - 1)] == pair).all():
            raise ValueError("a pair of the second pass is missing from the first")
        count = counts[0][place]
        cuts = np.cumsum(sizes) - sizes
        own[used, 4] = np.add.reduceat(weight * (count == best[(pair >> np.uint64(32)).astype(np.int64)]), cuts)
        own[used, 5] = np.add.reduceat(weight * count, cuts)
    ends = np.cumsum(each)
    running = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(own[units], axis=0)])
    numbers = np.where(whole[:, None], running[ends] - running[ends - each], 0)
    said, places = aligner.units.digests, units.tolist()
    digests = [
        hashlib.sha256(";".join([said[u] for u in places[e - n : e]]).encode()).hexdigest() if w and n else ""
        for e, n, w in zip(ends.tolist(), each.tolist(), whole.tolist())
    ]
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(numbers[:, k]) for k in range(6)), pa.array(digests, pa.string())],
        names=[part.split()[0] for part in _RESULT.split(", ")],
    )


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens of A and B, groups, links, links of highest count, their sum, digest of the groups.

    ``n_best`` counts the links whose pair is held by as many documents as any pair of its A id. Null and empty
    texts, and texts that either tokenizer does not give back byte by byte, have zeros and an empty digest and
    count nowhere. Every row is a document, whatever its id: repeated rows count one by one, a null
    ``doc_id`` is kept. Texts of any length are read whole; other columns are ignored; an empty table gives no
    rows.
    """
    paths = (path_a, path_b)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the runs are numbered once, in a table: both passes and every repeated task see the same ones
    runs = stored(rows.mapInArrow(lean(_runs), "run long, doc_id long, text string"), "alignment-runs")
    asked = stored(runs.mapInArrow(lean(_asked(paths)), _ASKED), "alignment-asked")
    total = asked.select(F.sum(F.octet_length("keys")) / 8).first()[0] or 0
    fan = max(1, -(-int(total) // (SHARDS * BRANCH_PAIRS)))
    functions = stored(
        asked.select("shard", "keys").repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(_functions), _FUNCTIONS),
        "alignment-functions",
    )
    summed = "shard int, branch int, vector binary"
    vectors = _with_functions(asked, functions, fan).mapInArrow(lean(_counted), summed)
    branches = fan
    while branches > 1:
        branches = -(-branches // FAN_IN)
        vectors = (
            vectors.withColumn("branch", F.col("branch") % branches)
            .repartition("shard", "branch")
            .sortWithinPartitions("shard", "branch")
            .mapInArrow(lean(_added), summed)
        )
    counts = stored(functions.join(vectors.select("shard", "vector"), "shard"), "alignment-counts")
    best = np.zeros(Aligner(*paths).a.get_vocab_size(with_added_tokens=True), np.int64)
    highest = counts.select("keys", "vector").mapInArrow(lean(_highest), "a long, best long")
    for r in highest.groupBy("a").agg(F.max("best").alias("best")).collect():  # at most one line per id of A
        best[r["a"]] = r["best"]
    answers = _with_functions(asked.drop("counts"), counts, fan).mapInArrow(lean(_answered), "run long, keys binary, counts binary")
    return (
        answers.unionByName(runs, allowMissingColumns=True)
        .repartition("run")
        .sortWithinPartitions("run", F.desc_nulls_last(F.col("keys").isNotNull()))
        .mapInArrow(lean(_looked_up(paths, best)), _RESULT)
    )

