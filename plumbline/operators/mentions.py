"""Which of many listed values each text contains, by hashes of windows.

A value of ``n`` bytes is known by its first and its last ``w`` bytes, ``w`` being the largest power
of two up to ``n``: together they cover it. Windows of a text get their hashes from running sums, so each
power of two costs one pass over the text, whatever the number of values. A place whose window begins
a value is looked up once per length of the values that begin so; hits are compared byte by byte.
A list too long for a task is known there by marks of one bit each, and joined with what bears them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: bytes of values that every task may hold; longer lists stay apart and meet the texts by shuffle
BLOCK_BYTES = 4 << 20
#: bytes of texts that are searched at a time; a longer text is searched whole
SLICE_BYTES = 1 << 18
_FILTER_BITS = 20
#: bits of the marks of a longer list. Any number gives the same result; fewer let more words through
_MARK_BITS = 26

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_U32 = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> _U32)


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class _Sums:
    """Running sums of a byte string; the hash of any window comes from two of them."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[data] * _powers(_ODD, len(data)), dtype=np.uint64)))
        self.back = _powers(_INVERSE, len(data) + 1)

    def windows(self, at: np.ndarray | slice, width: int, places: int) -> np.ndarray:
        """Hashes of the windows of ``width`` bytes that begin at ``at`` (or at each of the first ``places``)."""
        with np.errstate(over="ignore"):
            if isinstance(at, slice):
                own = (self.sums[width : width + places] - self.sums[:places]) * self.back[:places]
            else:
                own = (self.sums[at + width] - self.sums[at]) * self.back[at]
        return _mixed(own)


def _both(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(first * _ODD + last + np.asarray(size).astype(np.uint64))


class _Width:
    """The values whose window is one power of two."""

    def __init__(self, width: int, first: np.ndarray, keys: np.ndarray, sizes: np.ndarray, values: np.ndarray):
        self.width = width
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        begin = np.unique(np.stack([first, sizes.astype(np.uint64)], axis=1), axis=0)
        self.first, at = np.unique(begin[:, 0], return_index=True)
        self.sizes = begin[:, 1].astype(np.int64)
        self.begins = np.append(at, len(begin))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.first >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, sums: _Sums, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, sizes and entries of ``keys`` that match by hash; ``ends`` is the end of the text of each byte."""
        places = len(ends) - self.width + 1
        if places <= 0:
            return (np.zeros(0, np.int64),) * 3
        hashes = sums.windows(slice(None), self.width, places)
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.first, hashes[at]), len(self.first) - 1)
        same = self.first[found] == hashes[at]
        at, found = at[same], found[same]
        each = self.begins[found + 1] - self.begins[found]
        done = np.cumsum(each)
        entry = np.repeat(self.begins[found] - done + each, each) + np.arange(int(done[-1]) if len(done) else 0)
        at, size = np.repeat(at, each), self.sizes[entry]
        inside = at + size <= ends[at]
        at, size = at[inside], size[inside]
        keys = _both(hashes[at], sums.windows(at + size - self.width, self.width, 0), size)
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        same = self.keys[place] == keys
        return at[same], size[same], place[same]


class ValueIndex:
    """Values in order of preference, indexed by their windows; equal values share one entry."""

    def __init__(self, values: list[bytes]):
        listed: dict[bytes, list[int]] = {}
        for k, v in enumerate(values):
            listed.setdefault(v, []).append(k)
        self.known = list(listed)
        self.data = np.frombuffer(b"".join(self.known), np.uint8)
        sizes = np.array([len(v) for v in self.known], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.members = np.array([k for own in listed.values() for k in own], np.int64)
        self.member_ends = np.cumsum([len(own) for own in listed.values()], dtype=np.int64)
        sums = _Sums(self.data)
        width = _width_of(sizes)
        self.widths = []
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            first = sums.windows(self.starts[own], int(w), 0)
            last = sums.windows(self.starts[own] + sizes[own] - w, int(w), 0)
            self.widths.append(_Width(int(w), first, _both(first, last, sizes[own]), sizes[own], own))

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs of text and known value that are equal byte by byte, and how many places were looked up."""
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        ends = offsets[1:][owner]
        sums, texts, found, looked = _Sums(data), [], [], 0
        for w in self.widths:
            at, size, entry = w.hits(sums, ends)
            looked += len(at)
            while len(at):  # values of equal hash stand side by side
                value, left = w.values[entry], []
                same = np.zeros(len(at), bool)
                for s in np.unique(size):
                    of = np.flatnonzero(size == s)
                    step = np.arange(s)
                    for some in np.array_split(of, max(1, len(of) * int(s) >> 22)):
                        mine = data[at[some][:, None] + step]
                        same[some] = (mine == self.data[self.starts[value[some]][:, None] + step]).all(axis=1)
                texts.append(owner[at[same]])
                found.append(value[same])
                left = np.flatnonzero(~same & (entry + 1 < len(w.keys)))
                left = left[w.keys[entry[left] + 1] == w.keys[entry[left]]]
                at, size, entry = at[left], size[left], entry[left] + 1
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), looked
        pairs = np.unique(np.concatenate(texts) * len(self.known) + np.concatenate(found))
        return *np.divmod(pairs, len(self.known)), looked

    def matches(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text and group of values the first listed value that the text contains."""
        text, known, _ = self.candidates(data, offsets)
        ends = self.member_ends[known]
        each = ends - np.where(known > 0, self.member_ends[known - 1], 0)
        done = np.cumsum(each)
        value = self.members[np.repeat(ends - done, each) + np.arange(int(done[-1]) if len(done) else 0)]
        text = np.repeat(text, each)
        order = np.lexsort((value, groups[value], text))
        text, value = text[order], value[order]
        group = groups[value]
        new = np.append(True, (text[1:] != text[:-1]) | (group[1:] != group[:-1]))[: len(text)]
        return text[new], value[new]


def short_list(listed: DataFrame) -> pa.Table | None:
    """The listed values (``field, place, value, _value``) in order, if every task may hold them."""
    size = listed.select(F.sum(F.octet_length("_value") + F.octet_length("value"))).first()[0] or 0
    return listed.toArrow() if size <= BLOCK_BYTES else None


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _marks(first: np.ndarray, last: np.ndarray, width: int, size: np.ndarray) -> Iterator[np.ndarray]:
    """What marks a value: that any begins so, that one of its size does, and itself."""
    yield _both(first, np.uint64(0), np.uint64(width))
    yield _both(first, np.uint64(1), size)
    yield _both(first, last, size)


def _width_of(sizes: np.ndarray) -> np.ndarray:
    return 1 << (np.frexp(sizes)[1] - 1).astype(np.int64)


def value_marks(listed: DataFrame) -> np.ndarray:
    """Bits of the marks of all values, gathered in Spark: of one size, however many values there are."""
    total = _MARK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _slices(batch.column(0)):
                sums, sizes, bits = _Sums(data), np.diff(offsets), []
                width = _width_of(sizes)
                for w in np.unique(width):
                    own = np.flatnonzero(width == w)
                    first = sums.windows(offsets[own], int(w), 0)
                    last = sums.windows(offsets[own] + sizes[own] - w, int(w), 0)
                    bits += [_bit(m, total) for m in _marks(first, last, int(w), sizes[own])]
                bits = np.unique(np.concatenate(bits))
                word, at = np.unique(bits >> 6, return_index=True)
                held = np.bitwise_or.reduceat(np.uint64(1) << (bits & 63).astype(np.uint64), at)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(held.view(np.int64))], names=["word", "bits"])

    found = listed.select("_value").mapInArrow(run, "word long, bits long")
    words = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    marks = np.zeros(1 << (total - 6), np.uint64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return marks


def _new(data: np.ndarray, owner: np.ndarray, at: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places without repeats of a word in its text, and their words as rows of bytes."""
    order = np.lexsort((keys, owner[at]))
    at, keys = at[order], keys[order]
    words = data[at[:, None] + np.arange(size)]
    again = (keys[1:] == keys[:-1]) & (owner[at[1:]] == owner[at[:-1]])
    again[again] = (words[1:][again] == words[:-1][again]).all(axis=1)
    keep = np.append(True, ~again)[: len(at)]
    return at[keep], words[keep]


def marked_words(rows: DataFrame, text: str, ids: Sequence[str], marks: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """``ids`` and ``word`` (bytes) for whatever in a text bears the marks of a value; few others do."""
    place = rows.columns.index(text)
    at_ids = [rows.columns.index(c) for c in ids]
    width = _width_of(sizes)
    widths = [(int(w), sizes[width == w]) for w in np.unique(width)]
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value

        def known(hashes: np.ndarray) -> np.ndarray:
            bit = _bit(hashes, len(held).bit_length() + 5)
            return (held[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) != 0

        def found(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            ends, sums = offsets[1:][owner], _Sums(data)
            for w, own_sizes in widths:
                places = len(data) - w + 1
                if places <= 0:
                    continue
                hashes = sums.windows(slice(None), w, places)
                at = np.flatnonzero(known(_both(hashes, np.uint64(0), np.uint64(w))))
                for s in own_sizes:
                    of = at[at + s <= ends[at]]
                    _, begin, own = _marks(hashes[of], sums.windows(of + s - w, w, 0), w, s)
                    here = known(begin) & known(own)
                    of, own = of[here], own[here]
                    for some in np.array_split(np.arange(len(of)), max(1, len(of) * int(s) >> 22)):
                        if len(some):
                            new, words = _new(data, owner, of[some], own[some], int(s))
                            cuts = pa.array(np.arange(len(new) + 1, dtype=np.int32) * np.int32(s))
                            buffers = [None, cuts.buffers()[1], pa.py_buffer(words.tobytes())]
                            yield owner[new], pa.Array.from_buffers(pa.binary(), len(new), buffers)

        for batch in batches:
            for first, _, data, offsets in _slices(batch.column(place)):
                for text_, words in found(data, offsets):
                    rows_ = pa.array(text_ + first)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows_) for c in at_ids), words], names=[*ids, "word"])

    schema = StructType([rows.schema[c] for c in at_ids]).add("word", "binary")
    return rows.mapInArrow(run, schema)


def joined_matches(rows: DataFrame, text: str, ids: Sequence[str], listed: DataFrame) -> DataFrame:
    """``ids, _m`` (``field, place, value``): of each field the first listed value that a text contains.

    For lists that no task can hold: words of texts that bear the marks of a value meet the values by
    shuffle, byte by byte, and what a text contains is folded by its number.
    """
    sizes = listed.select(F.octet_length("_value").alias("n")).distinct().toArrow().column("n").to_numpy()
    numbered = rows.select(
        F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], F.col(text).alias("_text")
    )
    held = [f"_id{i}" for i in range(len(ids))]
    words = marked_words(numbered, "_text", ["_row", *held], value_marks(listed), np.sort(sizes).astype(np.int64))
    one = F.min(F.struct("place", "value"))
    values = listed.groupBy("field", F.col("_value").cast("binary").alias("word")).agg(one.alias("own"))
    first = words.join(values, "word").groupBy("_row", "field").agg(
        F.min("own").alias("own"), *[F.first(c).alias(c) for c in held]
    )
    met = F.struct("field", "own.place", "own.value")
    return first.select(*[F.col(h).alias(c) for h, c in zip(held, ids)], met.alias("_m"))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = texts.cast(pa.large_binary())
    count = len(texts)
    if not count:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + count + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    first = 0
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def with_matches(rows: DataFrame, name: str, block: pa.Table, text: str) -> DataFrame:
    """``rows`` with an array of what each text contains: ``field, place, value``, the first of each field."""
    kind = StructType([f for f in _struct_of(rows, block).fields])
    place = rows.columns.index(text)
    fields = block.column("field").combine_chunks()
    groups = np.asarray(fields.dictionary_encode().indices.fill_null(-1), np.int64)
    index = ValueIndex([v.encode() for v in block.column("_value").to_pylist()])
    values = pa.StructArray.from_arrays(
        [block.column(c).combine_chunks() for c in ("field", "place", "value")], names=["field", "place", "value"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for first, last, data, offsets in _slices(batch.column(place)):
                text_, value = index.matches(data, offsets, groups)
                texts.append(text_ + first)
                found.append(value)
            cuts = np.concatenate(([0], np.cumsum(np.bincount(np.concatenate(texts), minlength=len(batch)))))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values.take(pa.array(np.concatenate(found))))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

    schema = StructType([*rows.schema.fields]).add(name, ArrayType(kind))
    return rows.mapInArrow(run, schema)


def _struct_of(rows: DataFrame, block: pa.Table) -> StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(block.select(["field", "place", "value"]).schema)
