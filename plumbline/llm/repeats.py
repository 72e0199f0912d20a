"""Repeated byte strings across a corpus, by bounded interval expansion on a Burrows-Wheeler order.

Every string of ``length`` bytes has an anchor: the stretch of ``_ANCHOR`` bytes in it with the
smallest hash. Equal strings have equal anchors at equal places, so strings are compared only where
an anchor occurs more than once, and the anchors of a corpus are about one in seventy places.

The occurrences of an anchor, sorted by what follows it, are an interval of the suffix order. The
interval is extended backwards, breadth first, one byte at a time: the bytes that stand before it
(the Burrows-Wheeler column) split it into the intervals of the longer strings, kept in order by a
stable sort, and the common prefix of neighbours in a new interval is one more than the least
between them before. Intervals of one occurrence are dropped, and after as many steps as a string
has places before its anchor the expansion stops: neighbours whose common prefix has reached
``length`` are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import _BYTE, _mixed, lean, text_slices
from plumbline.llm.meeting import shared_rows
from plumbline.session import stored

LENGTH = 200
_ANCHOR = 64
_CHUNK = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: pieces whose intervals a task expands at once
_PIECES = 20_000
_FRAGMENT_ROWS = 500_000
_FIELDS = [("row", "<i8"), ("place", "<i8"), ("low", "<u2"), ("high", "<u2"), ("piece", "<i8")]


def _slid(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over every run of ``width`` values."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


class _Anchors:
    """Anchors of joined texts; powers are kept for the next run of texts."""

    def __init__(self, length: int):
        self.length, self.wide = length, length - _ANCHOR + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, count: int) -> None:
        if len(self.up) < count:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(count, _STEP))))
                self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(count, _BACK))))

    def of(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hash, place, least and largest distance of its strings, and hash of their union.

        ``room`` says how many bytes are left from each place to the end of its text.
        """
        n, wide = len(data), self.wide
        if n < self.length:
            return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64))
        with np.errstate(over="ignore"):
            h, done = _BYTE[data], 1
            while done < _ANCHOR:
                h = h[:-done] * _mixed(np.array([done], np.uint64) + _STEP) + h[done:]
                done *= 2
            h = _mixed(h) | np.uint64(1)
        least = _slid(h, wide, np.minimum)
        least[room[: len(least)] < self.length] = 0
        edge = np.zeros(wide - 1, np.uint64)
        place = np.flatnonzero(_slid(np.concatenate((edge, least, edge)), wide, np.maximum) == h)
        value = h[place]
        cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
        run_first = np.concatenate(([0], cuts))
        run_last = np.concatenate((cuts, [len(least)])) - 1
        run = np.searchsorted(run_first, np.maximum(place - wide + 1, 0), "right") - 1
        while True:
            wrong = np.flatnonzero(least[run_first[run]] != value)
            if not len(wrong):
                break
            run[wrong] += 1
        low = place - np.minimum(run_last[run], place)
        high = place - np.maximum(run_first[run], np.maximum(place - wide + 1, 0))
        self._powers(n)
        with np.errstate(over="ignore"):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * self.up[:n])))
            begin = place - high
            piece = (sums[place - low + self.length] - sums[begin]) * self.down[begin]
            piece = _mixed(piece + low.astype(np.uint64) * _STEP + high.astype(np.uint64) * _BACK)
        return value, place, low, high, piece


def _emit(length: int):
    anchors = _Anchors(length)

    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        rows = batch.column(0).to_numpy()
        for first, last, data, offsets in text_slices(batch.column(1), _CHUNK):
            room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
            for at in range(0, max(len(data), 1), 4 * _CHUNK):  # long texts in pieces that overlap
                a, b = max(0, at - 2 * length), min(len(data), at + 4 * _CHUNK + 2 * length)
                value, place, low, high, piece = anchors.of(data[a:b], np.minimum(room[a:b], b - a - np.arange(b - a)))
                own = (place + a >= at) & (place + a < at + 4 * _CHUNK)
                place = place[own] + a
                text = np.searchsorted(offsets, place, "right") - 1
                out = np.empty(len(place), [("key", "<u8"), *_FIELDS])
                out["key"], out["row"], out["place"] = value[own], rows[first + text], place - offsets[text]
                out["low"], out["high"], out["piece"] = low[own], high[own], piece[own].view(np.int64)
                yield out

    return run


def repeated_distances(group: np.ndarray, high: np.ndarray, low: np.ndarray, pieces: list[bytes], length: int) -> np.ndarray:
    """Which strings of each piece another piece of its group holds, by distance to the anchor.

    A piece holds ``high`` bytes before its anchor and all of the strings that start between
    ``high`` and ``low`` bytes before it. ``group`` must be sorted.
    """
    count = len(pieces)
    wide = length - _ANCHOR + 1
    found = np.zeros((count, wide), bool)
    ahead = np.zeros((count, length + 4), np.uint8)
    before = np.zeros((count, wide), np.uint8)
    for i, (p, k) in enumerate(zip(pieces, high.tolist())):
        raw = np.frombuffer(p, np.uint8)
        ahead[i, 4 : 4 + len(raw) - k] = raw[k : k + length] + 1  # 0 ends a piece; no byte of UTF-8 is 255
        before[i, :k] = raw[:k][::-1]
    after = length - low  # bytes known from the anchor on
    ranks = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
    ahead[:, :4] = ranks.astype(">u4").view(np.uint8).reshape(-1, 4)
    order = np.argsort(ahead.view(f"S{length + 4}")[:, 0], kind="stable")
    ahead = ahead[:, 4:]
    differ = ahead[order[1:]] != ahead[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common = np.minimum(common, np.minimum(after[order[1:]], after[order[:-1]]))
    interval = ranks[order].astype(np.int64)
    # common[i]: prefix that entry i shares with the one before it; -1 at the start of an interval
    common = np.concatenate(([-1], np.where(interval[1:] == interval[:-1], common, -1)))
    for distance in range(wide):
        reached = common >= length - distance
        hit = order[reached | np.concatenate((reached[1:], [False]))]
        found[hit, distance] = True
        # intervals of one entry and entries without a byte before them end here
        alone = (common < 0) & np.concatenate((common[1:] < 0, [True]))
        stay = ~alone & (high[order] > distance)
        if not stay.all():
            order, interval, common = _kept(order, interval, common, stay)
        if not len(order):
            break
        byte = before[order, distance]
        inside = interval[1:] == interval[:-1]
        if (byte[1:] != byte[:-1])[inside].any():
            by = np.argsort(interval * 256 + byte, kind="stable")
            a, b = by[:-1], by[1:]
            same = (interval[a] == interval[b]) & (byte[a] == byte[b])
            least = np.full(len(by), -1)
            if same.any():  # a < b there: the sort is stable
                ends = np.stack((a[same] + 1, b[same] + 1), axis=1).ravel()
                least[1:][same] = np.minimum.reduceat(np.append(common, 0), ends)[::2]
            order, common = order[by], least
            interval = np.cumsum(common < 0)
    in_range = (np.arange(wide) >= low[:, None]) & (np.arange(wide) <= high[:, None])
    return found & in_range


def _kept(order: np.ndarray, interval: np.ndarray, common: np.ndarray, stay: np.ndarray):
    """Entries that stay; neighbours that become adjacent share the least of what lay between."""
    at = np.flatnonzero(stay)
    if not len(at):
        return order[:0], interval[:0], common[:0]
    least = np.full(len(at), -1)
    if len(at) > 1:
        ends = np.stack((at[:-1] + 1, at[1:] + 1), axis=1).ravel()
        between = np.minimum.reduceat(np.append(common, 0), ends)[::2]
        least[1:] = np.where(interval[at[1:]] == interval[at[:-1]], between, -1)
    return order[at], interval[at], least


def _runs(flags: np.ndarray, length: int) -> list[int]:
    """Spans relative to the anchor, flat, that the strings at the flagged distances cover."""
    at = np.flatnonzero(flags)[::-1]  # the largest distance starts first
    cuts = np.flatnonzero(np.diff(at) != -1) + 1
    out: list[int] = []
    for part in np.split(at, cuts):
        if len(part):
            out += [-int(part[0]), int(length - part[-1])]
    return out


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans without overlaps; those that touch become one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))
    return np.stack((spans[new, 0], ends[last]), axis=1)


def _expanded(length: int):
    """Rows of a partition, sorted by key, to the spans of pieces that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            key, piece, many = (t.column(c).to_numpy() for c in ("key", "piece", "many"))
            low, high = t.column("low").to_numpy(), t.column("high").to_numpy()
            flags = repeated_distances(key, high, low, t.column("bytes").to_pylist(), length)
            own = np.flatnonzero(flags.any(axis=1) & (many == 1))
            return pa.RecordBatch.from_arrays(
                [pa.array(key[own]), pa.array(piece[own]),
                 pa.array([_runs(flags[i], length) for i in own], pa.list_(pa.int32()))],
                names=["key", "piece", "spans"],
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _PIECES:
                whole = pa.Table.from_batches(held).combine_chunks()
                key = whole.column("key").to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if last:
                    yield done(whole.slice(0, last))
                held = whole.slice(last).to_batches()
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            if whole.num_rows:
                yield done(whole)

    return run


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """``row, spans`` of rows of ``docs(row, text)``: start and end pairs in bytes, flat."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least_parts, int(size // 60 // _FRAGMENT_ROWS))
    marks = stored(shared_rows(docs, _emit(length), _FIELDS, parts).distinct(), "anchors")
    at = F.struct("row", "place", "low", "high")
    pieces = stored(
        marks.groupBy("key", "piece").agg(F.count("*").alias("many"), F.min(at).alias("at")), "pieces"
    )
    mixed = pieces.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    open_ = (
        pieces.join(mixed, "key")
        .select(F.col("at.row").alias("row"), F.struct("key", "piece", "many", "at.place", "at.low", "at.high").alias("cut"))
        .groupBy("row")
        .agg(F.collect_list("cut").alias("cuts"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for k in range(batch.num_rows):
                text = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
                own = batch.column("cuts")[k].as_py()
                raw = [text[c["place"] - c["high"] : c["place"] - c["low"] + length] for c in own]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([c[n] for c in own], pa.int64()) for n in ("key", "piece", "many", "low", "high")),
                     pa.array(raw, pa.binary())],
                    names=["key", "piece", "many", "low", "high", "bytes"],
                )

    windows = docs.join(open_, "row").select("text", "cuts").mapInArrow(
        lean(cut), "key long, piece long, many long, low long, high long, bytes binary"
    )
    apart = (
        windows.repartition(parts, "key")
        .sortWithinPartitions("key")
        .mapInArrow(lean(_expanded(length)), "key long, piece long, spans array<int>")
    )
    whole = pieces.where("many > 1").select(
        "key", "piece",
        F.array((-F.col("at.high")).cast("int"), (F.lit(length) - F.col("at.low")).cast("int")).alias("spans"),
    )
    covers = stored(apart.unionByName(whole), "covers")
    shifted = F.transform("spans", lambda s: s.cast("long") + F.col("place"))
    return (
        marks.join(covers, ["key", "piece"])
        .select("row", shifted.alias("spans"))
        .groupBy("row")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept``.

    Removes each byte of a UTF-8 text that a string of ``length`` bytes covers which starts
    anywhere else in the corpus too, in the same text or another. Strings never cross texts and
    are judged on the input; ``kept`` are the remaining bytes, joined.

    Null and empty texts have no bytes; shorter texts than ``length`` stay whole; a null ``doc_id``
    is kept; a repeated row repeats all of its strings; an empty table gives no rows; other columns
    are ignored. ``length`` must be more than 64. Long texts are searched piece by piece.
    """
    if length <= _ANCHOR:
        raise ValueError(f"length must be more than {_ANCHOR}")
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("row", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed.select("row", "text"), length)
    times = keyed.groupBy("row").agg(F.count("*").alias("times")).where("times > 1")
    times = stored(times, "repeated-rows")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            rows = ([], [], [], [], [])
            for k in range(batch.num_rows):
                text = texts[k].as_buffer() if texts[k].is_valid else pa.py_buffer(b"")
                found = batch.column("spans")[k]
                cuts = np.empty((0, 2), np.int64)
                if batch.column("times")[k].is_valid and len(text) >= length:
                    cuts = np.array([[0, len(text)]])
                elif found.is_valid and len(found):
                    cuts = _merged(found.values.to_numpy().reshape(-1, 2))
                view, at, hashed, parts = memoryview(text), 0, hashlib.sha256(), []
                for a, b in cuts.tolist():
                    hashed.update(view[at:a])
                    if keep_text:
                        parts.append(bytes(view[at:a]))
                    at = b
                hashed.update(view[at:])
                if keep_text:
                    parts.append(bytes(view[at:]))
                removed = int((cuts[:, 1] - cuts[:, 0]).sum())
                for column, value in zip(rows, (len(view), removed, len(cuts), hashed.hexdigest(), b"".join(parts))):
                    column.append(value)
            arrays = [batch.column("doc_id"), *(pa.array(r, t) for r, t in zip(rows, (pa.int64(),) * 3 + (pa.string(), pa.binary())))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            size = 6 if keep_text else 5
            yield pa.RecordBatch.from_arrays(arrays[:size], names=names[:size])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (
        keyed.join(spans, "row", "left")
        .join(times, "row", "left")
        .select("doc_id", "text", "spans", "times")
        .mapInArrow(lean(kept), schema + (", kept binary" if keep_text else ""))
    )
