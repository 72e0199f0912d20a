"""What several operators share: stored steps, size-checked broadcasts, words and hashes in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stored

__all__ = ["joined_by", "lean", "stored", "text_slices", "unused", "word_bounds", "word_hashes", "words_of"]

#: rows of a side that may be broadcast; longer sides are joined by shuffle, with the same result
BROADCAST_ROWS = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LONGEST_POWER = 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
    _BYTE_LOWER = _BYTE.copy()
    _BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
    _POWER = np.cumprod(np.full(_LONGEST_POWER, _ODD, np.uint64))


def give_back() -> None:
    """Gives memory that this Python process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives memory back when its task ends.

    Python workers stay for later tasks; without this they keep the most that any task needed.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def joined_by(left: DataFrame, small: DataFrame, on: str, rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined with a side of ``rows`` counted rows: broadcast if few, else by shuffle."""
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def unused(name: str, taken: list[str]) -> str:
    """A column name beside those of a frame, which may hold any; case does not tell names apart."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; A-Z count as a-z if ``lower``."""
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(
        np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)])))
    )
    with np.errstate(over="ignore"):
        each = (_BYTE_LOWER if lower else _BYTE)[data]
        each *= _POWER[place & (_LONGEST_POWER - 1)] + (place >> 12).astype(np.uint64)
        each[_SPACE[data]] = 0
        total = np.add.reduceat(each, starts)
        return _mixed(total + (ends - starts).astype(np.uint64))


def text_slices(texts: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as ``(first, last, bytes, offsets)``, of about ``most_bytes`` each.

    A longer text has a run of its own. Null texts have no bytes.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    count = len(texts)
    if not count:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + count + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.empty(0, np.uint8)
    first = 0
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of joined texts, cut where a text ends, and the text of each."""
    starts, ends = word_bounds(data)
    cuts = offsets[1:-1]
    if len(starts) and len(cuts):
        holds = np.maximum(np.searchsorted(starts, cuts, "right") - 1, 0)
        at = np.unique(cuts[(cuts > starts[holds]) & (cuts < ends[holds])])
    else:
        at = np.empty(0, starts.dtype)
    starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
