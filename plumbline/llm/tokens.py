"""Token files: ids of a corpus in patched frame-of-reference blocks, in order of ``doc_id``.

A file is a Parquet file whose rows are chunks of whole documents. A chunk carries its payload
and, beside it, the ids and lengths of its documents. A payload is, little-endian throughout::

    "PFR1", values u32, blocks u32, start of each block from the payload's first byte u32 ...
    block: minimum u32, width u8, exceptions u16, 256 packed differences of ``width`` bits,
           place of each exception u8 ..., its whole difference u32 ...

Differences to the block's minimum are packed at the width that a given share of them fits into;
the others are patched from the exception list. Any block can be decoded alone.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import lean

BLOCK = 256
_MAGIC = b"PFR1"
_HEAD = 7

#: ids after which a chunk ends at the next document
CHUNK_IDS = 1 << 17
#: share of a block's differences that must fit into the packed width
PERCENTILE = 0.9
#: words a worker remembers the ids of; beyond, it keeps those it meets most often
MOST_WORDS = 800_000

_CHUNKS = (
    "shard int, chunk int, start long, total long, doc_ids array<long>, lengths array<long>, "
    "payload binary"
)


def pack(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The payload that holds ``values`` (each below 2^32)."""
    values = np.asarray(values, np.uint32)
    blocks = -(-len(values) // BLOCK)
    head = _MAGIC + np.array([len(values), blocks], "<u4").tobytes()
    if not blocks:
        return head
    padded = np.full(blocks * BLOCK, values[-1], np.uint32)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, BLOCK)
    least = grid.min(axis=1)
    grid = grid - least[:, None]
    bits = np.searchsorted(np.uint64(1) << np.arange(33, dtype=np.uint64), grid, "right").astype(np.uint8)
    place = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.partition(bits, place, axis=1)[:, place]
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        raw = grid[of].astype("<u4").view(np.uint8).reshape(len(of), BLOCK, 4)
        low = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :w]
        for k, row in zip(of, np.packbits(low.reshape(len(of), -1), axis=1, bitorder="little")):
            packed[k] = row.tobytes()
    beyond = bits > width[:, None]
    parts, starts, at = [], np.empty(blocks, "<u4"), len(head) + 4 * blocks
    counts = beyond.sum(axis=1)
    for k in range(blocks):
        part = (
            least[k : k + 1].astype("<u4").tobytes()
            + bytes([width[k]])
            + int(counts[k]).to_bytes(2, "little")
            + packed[k]
        )
        if counts[k]:
            places = np.flatnonzero(beyond[k])
            part += places.astype(np.uint8).tobytes() + grid[k, places].astype("<u4").tobytes()
        starts[k] = at
        at += len(part)
        parts.append(part)
    return head + starts.tobytes() + b"".join(parts)


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values ``first`` to ``last`` (exclusive) of a payload; only their blocks are decoded."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a payload of packed ids")
    data = np.frombuffer(payload, np.uint8)
    count, blocks = (int(x) for x in data[4:12].view("<u4"))
    last = count if last is None else min(last, count)
    if first >= last:
        return np.empty(0, np.uint32)
    wanted = np.arange(first // BLOCK, (last - 1) // BLOCK + 1)
    starts = np.frombuffer(payload, "<u4", blocks, 12)[wanted].astype(np.int64)
    head = data[starts[:, None] + np.arange(_HEAD)]
    least = head[:, :4].copy().view("<u4")[:, 0]
    width = head[:, 4]
    patched = head[:, 5].astype(np.int64) + 256 * head[:, 6].astype(np.int64)
    out = np.empty((len(wanted), BLOCK), np.uint32)
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        packed = data[starts[of][:, None] + _HEAD + np.arange(BLOCK // 8 * int(w))]
        bits = np.zeros((len(of), BLOCK, 32), np.uint8)
        if w:
            bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(of), BLOCK, w)
        out[of] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    for k in np.flatnonzero(patched):
        at, n = int(starts[k]) + _HEAD + BLOCK // 8 * int(width[k]), int(patched[k])
        out[k, data[at : at + n]] = np.frombuffer(payload, "<u4", n, at + n)
    out += least[:, None]
    skipped = int(wanted[0]) * BLOCK
    return out.ravel()[first - skipped : last - skipped]


def word_tokenizer() -> str:
    """Path of the vocabulary that the registered queries use; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: a stop or comma after another sign belongs to that sign's run
_AFTER_SIGN = re.compile(r"[.,](?<=[^\s\w][.,])(?=\s|$)")
#: the start of special tokens, and letters whose lower case depends on their neighbours
_KEEP_CASE = ("<|", "\u0130", "\u03a3")

_encoders: dict[str, "_Encoder"] = {}


def _encoder(path: str) -> "_Encoder":
    """One encoder per Python worker: words learnt in one task serve the next ones."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


class _Encoder:
    """Ids of texts. Blanks separate words for good, so each word is tokenised once per task.

    Stops and commas that end a word are cut off, since they are tokens of their own, and letters
    are lower-cased as the vocabulary does; both only spare words that differ in nothing else.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.zeros(size, bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends_word[k] = token.endswith("</w>")
        self.folds = self._same("AbC dE", "abc de") and self._same("ab, cd.", "ab , cd .")
        self._forget()

    def _same(self, a: str, b: str) -> bool:
        x, y = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in (a, b))
        return x == y

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int32)

    def _trim(self) -> None:
        """Keeps the half of the words that were met most often, none that was met once."""
        middle = len(self.uses) // 2
        least = max(2, int(np.partition(self.uses, middle)[middle]) + 1)
        kept = np.flatnonzero(self.uses >= least)
        at = dict(zip(kept.tolist(), range(len(kept))))
        self.known = {w: at[k] for w, k in self.known.items() if k in at}
        each = np.diff(self.bounds)[kept]
        done = np.cumsum(each)
        self.flat = self.flat[np.repeat(self.bounds[kept] - done + each, each) + np.arange(done[-1] if len(done) else 0)]
        self.bounds = np.append(0, done).astype(np.int64)
        self.uses = self.uses[kept] // 2

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        parts = []
        if plain:  # one run of letters is one word to the vocabulary, and its last id ends a word
            found = self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)
            ids = np.array(found[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(plain):
                parts.append((plain, ids, cuts))
            else:
                plain = []
        alone = set(plain)
        others = [w for w in words if w not in alone]
        found = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        each = [f.ids for f in found]
        flat = np.fromiter((i for ids in each for i in ids), np.uint32)
        parts.append((others, flat, np.cumsum([len(ids) for ids in each], dtype=np.int64)))
        for own, ids, cuts in parts:
            first = len(self.bounds) - 1
            self.known.update(zip(own, range(first, first + len(own))))
            self.bounds = np.concatenate([self.bounds, cuts + len(self.flat)])
            self.flat = np.concatenate([self.flat, ids])
        self.uses = np.append(self.uses, np.zeros(len(self.bounds) - 1 - len(self.uses), np.int32))

    def _words(self, text: str) -> list[str]:
        if self.folds:
            text = text.replace("\n", " ")
            if not any(k in text for k in _KEEP_CASE):
                text = text.lower()
            if "_" not in text and not _AFTER_SIGN.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and how many each text has."""
        if len(self.known) > MOST_WORDS:
            self._trim()
        words, ends = [], []
        for t in texts:
            words += self._words(t)
            ends.append(len(words))
        new = set(words).difference(self.known)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.uses += np.bincount(at, minlength=len(self.uses)).astype(np.int32)
        first, each = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        done = np.cumsum(each)
        ids = self.flat[np.repeat(first - done + each, each) + np.arange(int(done[-1]) if len(done) else 0)]
        return ids, np.diff(done[np.array(ends, np.int64) - 1], prepend=0)


def _chunks(path: str, end_id: int, percentile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(path), TaskContext.get().partitionId()
        docs, ids, held, chunk, start = [], [], 0, 0, 0

        def row():
            nonlocal docs, ids, held, chunk, start
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([chunk], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
                    pa.array([pack(np.concatenate(ids), percentile)], pa.binary()),
                ],
                names=["shard", "chunk", "start", "total", "doc_ids", "lengths", "payload"],
            )
            start, chunk, docs, ids, held = start + held, chunk + 1, [], [], 0
            return out

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 256):
                some = [t or "" for t in texts[at : at + 256].to_pylist()]
                flat, each = encoder.ids(some)
                for key, own in zip(keys[at : at + 256], np.split(flat, np.cumsum(each)[:-1])):
                    docs.append(key)
                    ids.append(np.append(own, np.uint32(end_id)))
                    held += len(ids[-1])
                    if held >= CHUNK_IDS:
                        yield row()
        if docs:
            yield row()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    percentile: float = PERCENTILE,
) -> None:
    """Writes the ids of every ``text``, each text followed by ``end_id``, in order of ``doc_id``.

    Null and empty texts have the end id alone; a null ``doc_id`` comes first; rows that share a
    ``doc_id`` are ordered by their text. Other columns are ignored, an empty table gives files
    without chunks. Each task writes one file (a shard) of a range of ids: only whole rows of one
    range and one chunk are held, however long the corpus.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
        .mapInArrow(lean(_chunks(tokenizer_path, end_id, percentile)), _CHUNKS)
        .write.parquet(path)
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"])
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([row["shard"]] * len(ends), pa.int32()),
                    pa.array(starts + row["start"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)], pa.int64()),
                ],
                names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of token files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it; the checksum is over its decoded ids.
    """
    files = spark.read.schema(_CHUNKS).parquet(path)
    before = (
        files.groupBy("shard")
        .agg(F.sum("total").alias("total"))
        .select(
            "shard",
            (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"),
        )
    )
    found = files.mapInArrow(
        lean(_documents), "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"
    )
    return found.join(before, "shard").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per chunk of token files, in whatever order: ``shard, chunk, doc_ids, lengths, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(["shard", "chunk", "doc_ids", "lengths"])
            ids = [unpack(p.as_py()).astype(np.int64) for p in batch.column("payload")]
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(ids, pa.list_(pa.int64()))], names=[*kept.schema.names, "ids"]
            )

    schema = "shard int, chunk int, doc_ids array<long>, lengths array<long>, ids array<long>"
    return spark.read.schema(_CHUNKS).parquet(path).mapInArrow(run, schema)
