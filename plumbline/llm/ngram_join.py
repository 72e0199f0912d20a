"""Jaccard self-join of word n-gram sets by vertical partitioning.

All n-grams stand in one global order: by a hash, the frequent ones last. Two sets that are
similar enough share one of the first n-grams of each (its prefix), the smaller one even among fewer
of its first (its lead), and the places of the first n-gram they share leave room for the
overlap they need. Only such pairs are compared. The order is cut into fragments: the prefixes of all sets
meet fragment by fragment, and for each pair the overlap is counted in every fragment on its own
and summed per pair.

Sets that are equal form a class and are compared once. Classes that share an n-gram are not
paired with one another: each is compared with one leader, then with a few neighbours in a random order of
those that still lie in different components, and only what is apart after that is paired in full. No
link that joins two components is left out, and a group of thousands of near copies costs a few
comparisons each.

A pair is first compared by bitmaps: one bit per place, turned over by every n-gram of the set that
falls there. Two sets differ in at least as many n-grams as their bitmaps do in bits, so a pair whose
bitmaps differ too much cannot link; only the others are counted n-gram by n-gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, _mixed, joined_by, lean, text_slices, word_hashes, words_of
from plumbline.llm.components import components
from plumbline.llm.meeting import shared_rows
from plumbline.session import stored

WORDS = 5
#: percent of the union that the intersection must reach
PERCENT = 75
#: fragments in which overlaps are counted
FRAGMENTS = 4
#: entries of the list of frequent n-grams at most. Any list gives the same links
MOST_FREQUENT = 1_000_000
#: n-grams a task gathers before it sends them on
_FLUSH = 4_000_000
#: prefix rows that a fragment is meant to hold, and members per leader and task
_FRAGMENT_ROWS, _MEMBERS = 1_000_000, 500
#: neighbours that a class is compared with in each round, before all that is still apart is paired
NEIGHBOURS = (4, 8, 8)
#: classes of an n-gram that are put in one random order
_BLOCK = 4_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xFF51AFD7ED558CCD], np.uint64)


def sets_of(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of joined texts, text after text, and where each set ends."""
    starts, ends, owner = words_of(data, offsets)
    hashes = word_hashes(data, starts, ends)
    count = len(offsets) - 1
    per_text = np.bincount(owner, minlength=count)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words if len(grams) else 0):
            grams += hashes[k : len(hashes) - words + 1 + k] * _FACTORS[k % 5] + np.uint64(k // 5)
        grams = _mixed(grams)
    first = np.cumsum(per_text) - per_text
    parts, sizes = [], np.zeros(count, np.int64)
    for i in np.flatnonzero(per_text):
        a, n = first[i], per_text[i]
        if n >= words:
            own = np.sort(grams[a : a + n - words + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        else:
            with np.errstate(over="ignore"):
                own = _mixed((hashes[a : a + n] * _FACTORS[:n]).sum(keepdims=True) + np.uint64(n))
        parts.append(own)
        sizes[i] = len(own)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(sizes)


def set_keys(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; 0 for empty ones."""
    sizes = np.diff(ends, prepend=0)
    keys = np.zeros(len(ends), np.uint64)
    full = sizes > 0
    if full.any():
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_mixed(values ^ _FACTORS[1]), (ends - sizes)[full])
            keys[full] = _mixed(sums + sizes[full].astype(np.uint64) * _FACTORS[2]) | np.uint64(1)
    return keys


def bitmaps(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Of each set, a bitmap of two to four bits per n-gram; a bit is 1 if an odd number of n-grams fall there."""
    out, begin = [], 0
    for end in ends.tolist():
        size = max(64, 1 << (2 * (end - begin) - 1).bit_length()) if end > begin else 0
        places = (values[begin:end] & np.uint64(max(size, 1) - 1)).astype(np.int64)
        odd = (np.bincount(places, minlength=size) & 1).astype(np.uint8)
        out.append(np.packbits(odd, bitorder="little").tobytes())
        begin = end
    return out


def _bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the larger one folded to the size of the other."""
    x, y = (np.frombuffer(b, np.uint8) for b in (x, y))
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _both_hold(x: bytes, y: bytes) -> int:
    """How many values two sorted lists share."""
    own, values = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    if not len(own) or not len(values):
        return 0
    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
    return int((own[at] == values).sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def set_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, cls, mark, bits`` per row.

    ``cls`` is null for empty sets, ``mark`` is a hash of the text. ``bits`` is the bitmap of the set, where a task
    sees the set first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0}
        for batch in batches:
            sizes, keys, bits = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], []
            for _, _, data, offsets in text_slices(batch.column(1)):
                values, ends = sets_of(data, offsets)
                sizes.append(np.diff(ends, prepend=0))
                keys.append(set_keys(values, ends))
                for key, own in zip(keys[-1].tolist(), bitmaps(values, ends)):
                    bits.append(None if key in seen else own)
                    seen.add(key)
            keys = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(sizes)), pa.array(keys.view(np.int64), mask=keys == 0), batch.column(2), pa.array(bits, pa.binary())],
                names=["doc_id", "n_shingles", "cls", "mark", "bits"],
            )

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(lean(run), "doc_id long, n_shingles long, cls long, mark long, bits binary")


def _frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent n-grams, sorted, from counts over all documents.

    A task adds up what it sees more than once in a run of documents; single sightings are left
    out. The list decides only how many candidates there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed():
            values = np.concatenate(held)
            held.clear()
            values.sort()
            often = np.unique(values[2:][values[2:] == values[:-2]])
            counts = np.searchsorted(values, often, "right") - np.searchsorted(values, often)
            return pa.RecordBatch.from_arrays([_signed(often), pa.array(counts)], names=["gram", "n"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                values, _ = sets_of(data, offsets)
                held.append(values)
                size += len(values)
                if size >= _FLUSH:
                    yield flushed()
                    size = 0
        if size:
            yield flushed()

    counts = stored(
        docs.mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams"
    )
    least = 8
    while counts.where(F.col("n") >= least).count() > MOST_FREQUENT:
        least *= 2
    found = counts.where(F.col("n") >= least).select("gram").toArrow().column("gram")
    return np.sort(found.to_numpy().astype(np.int64).view(np.uint64))


_FIELDS = [("cls", "<i8"), ("n", "<u4"), ("pos", "<u2")]
_LAST_PLACE = 0xFFFF


def _prefix(values: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams of a set, of which a similar set must share one."""
    n = len(values)
    size = n - -(-n * percent // 100) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        late = frequent[at] == values
        if late.any():
            values = np.concatenate((values[~late], values[late]))
    return values[:size]


def _shared_rows(docs: DataFrame, frequent, parts: int, percent: int) -> DataFrame:
    """``gram, cls, n, pos`` of every prefix n-gram that two or more classes hold, ``pos`` from 0.

    Places beyond 65,535 are given as that: a smaller place only lets more pairs through.
    """
    seen: set[int] = set()  # of the task, once it is there

    def emit(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_slices(batch.column(1)):
            values, ends = sets_of(data, offsets)
            begin, parts_of = 0, []
            for cls, end in zip(set_keys(values, ends).view(np.int64).tolist(), ends.tolist()):
                if end > begin and cls not in seen:
                    seen.add(cls)
                    own = _prefix(values[begin:end], frequent.value, percent)
                    rows = np.empty(len(own), [("key", "<u8"), *_FIELDS])
                    rows["key"], rows["cls"], rows["n"] = own, cls, end - begin
                    rows["pos"] = np.minimum(np.arange(len(own)), _LAST_PLACE)
                    parts_of.append(rows)
                begin = end
            if parts_of:
                yield np.concatenate(parts_of)

    def useful(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether two sets that alone hold an n-gram can link (see ``_Candidates``)."""
        n, other, pos, at = (r[f].astype(np.int64) for f in ("n", "pos") for r in (x, y))
        swap = (other < n) | ((other == n) & (y["cls"] < x["cls"]))
        small, large = np.where(swap, other, n), np.where(swap, n, other)
        lead = np.where(swap, at, pos) < small - -(-2 * percent * small // (100 + percent)) + 1
        reach = np.minimum(n - pos, other - at) * (100 + percent) >= percent * (n + other)
        return (x["cls"] != y["cls"]) & lead & reach & (100 * small >= percent * large)

    return shared_rows(docs, emit, _FIELDS, parts, useful).withColumnRenamed("key", "gram").distinct()


def _overlaps(docs: DataFrame, table: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, shared`` of each pair of classes, the overlaps of all fragments summed."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    of_class = table.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("mark", "doc_id")).alias("row"))
    ids = stored(
        of_class.join(wanted, "cls").select(
            F.col("row.mark").alias("mark"), F.col("row.doc_id").alias("id"), F.col("cls").alias("own")
        ),
        "wanted",
    )
    small = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    marked = docs.withColumn("own_mark", F.xxhash64("text"))
    texts = marked.join(
        small, (marked["own_mark"] == small["mark"]) & marked["doc_id"].eqNullSafe(small["id"])
    ).select("text", "own")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column(0)):
                values, ends = sets_of(data, offsets)
                keys = set_keys(values, ends).view(np.int64)
                begin, rows = 0, ([], [], [])
                for k, (key, end) in enumerate(zip(keys.tolist(), ends.tolist())):
                    if key == batch.column(1)[first + k].as_py() and key not in seen:
                        seen.add(key)
                        own = values[begin:end]
                        edges = np.searchsorted(own >> np.uint64(62), np.arange(FRAGMENTS + 1, dtype=np.uint64))
                        for f in range(FRAGMENTS):
                            rows[0].append(key)
                            rows[1].append(f)
                            rows[2].append(own[edges[f] : edges[f + 1]].tobytes())
                    begin = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())],
                    names=["cls", "fragment", "part"],
                )

    # rows that repeat an id and its text give a part again; it stands beside the first and is passed over
    parts = stored(texts.mapInArrow(lean(cut), "cls long, fragment int, part binary"), "parts")
    return _summed(pairs, parts, _both_hold).withColumnRenamed("value", "shared")


def _near(bits: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps differ in no more bits than sets that link can, stored."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "wanted")
    own = joined_by(bits, wanted, "cls", wanted.count()).select("cls", F.lit(0).alias("fragment"), "part")
    differ = _summed(pairs, own, _bits_apart)
    # 100 * shared >= percent * union, written for the n-grams that one of the two sets holds
    near = (100 + percent) * F.col("value") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    return stored(pairs.join(differ, ["a", "b"]).where(near).drop("value"), "near")


def _summed(pairs: DataFrame, parts: DataFrame, compare: Callable[[bytes, bytes], int]) -> DataFrame:
    """``a, b, value`` per pair: ``compare`` of their parts in ``parts(cls, fragment, part)``, summed over fragments."""
    per_leader = pairs.groupBy("a").agg(F.ceil(F.count("*") / _MEMBERS).alias("salts"))
    members = (
        pairs.join(per_leader, "a")
        .select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.col("b").alias("cls"))
        .join(parts, "cls")
        .select("a", "salt", "fragment", F.col("cls").alias("b"), "part")
    )
    leaders = (
        per_leader.select(F.col("a").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        .join(parts, "cls")
        .select(F.col("cls").alias("a"), "salt", "fragment", F.lit(None).cast("long").alias("b"), "part")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = b"", None
        for batch in batches:
            a, b, value = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("a", "salt", "fragment", "b", "part"))
            for leader, salt, fragment, member, blob in zip(*columns):
                if last == (leader, salt, fragment, member):
                    continue
                last = leader, salt, fragment, member
                if member is None:
                    own = blob
                    continue
                a.append(leader)
                b.append(member)
                value.append(compare(own, blob))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (a, b, value)], names=["a", "b", "value"]
            )

    spark = pairs.sparkSession
    partial = (
        members.unionByName(leaders)
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "salt", "fragment")
        .sortWithinPartitions("a", "salt", "fragment", F.asc_nulls_first("b"))
        .mapInArrow(lean(compared), "a long, b long, value long")
    )
    return partial.groupBy("a", "b").agg(F.sum("value").alias("value"))


def _linked(docs: DataFrame, table: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, stored."""
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    found = pairs.join(_overlaps(docs, table, pairs.select("a", "b")), ["a", "b"])
    return stored(found.where(100 * F.col("shared") >= percent * union).select("a", "b"), "links")


class _Candidates:
    """Which rows of an n-gram make a pair worth comparing. ``a`` is the smaller set."""

    def __init__(self, percent: int):
        self.percent = percent
        #: places among which the smaller set of a similar pair shares an n-gram
        self.lead = F.expr(f"pos < n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1")

    def pairs(self, met: DataFrame, a: str, b: str) -> DataFrame:
        """``a, b, n_a, n_b`` of the structs ``a`` and ``b`` (``n, cls, pos``) that can still link."""
        x, y = F.col(a), F.col(b)
        reach = F.least(x["n"] - x["pos"], y["n"] - y["pos"]) * (100 + self.percent)
        return (
            met.where(F.struct(x["n"], x["cls"]) < F.struct(y["n"], y["cls"]))
            .where(100 * x["n"] >= self.percent * y["n"])
            .where(reach >= self.percent * (x["n"] + y["n"]))
            .select(x["cls"].alias("a"), y["cls"].alias("b"), x["n"].alias("n_a"), y["n"].alias("n_b"))
            .distinct()
        )


def _apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of n-grams whose classes lie in several components: ``gram, cls, n, pos, lead, component, m``, stored."""
    placed = rows.join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    split = placed.groupBy("gram").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")
    )
    return stored(
        placed.join(split.where("low < high").select("gram", "m"), "gram").select(
            "gram", "cls", "n", "pos", "lead", "component", "m"
        ),
        "apart",
    )


def _neighbours(apart: DataFrame, width: int, turn: int) -> DataFrame:
    """Pairs ``x, y`` of rows in different components, at most ``width`` per class.

    Each class takes the one of its n-grams that comes first in a random order of all, as texts that
    are alike mostly do, and stands beside the next few classes there, in a random order again.
    """
    block = F.pmod(F.xxhash64("cls", F.lit(-turn)), F.ceil(F.col("m") / _BLOCK))
    me = F.struct("row", "lead", "component")
    window = Window.partitionBy("gram", "block").orderBy(F.xxhash64("row.cls", F.lit(turn)), "row.cls")
    met = (
        apart.groupBy("cls")
        .agg(F.min_by(F.struct("gram", "n", "pos", "lead", "component", "m"), F.xxhash64("gram", F.lit(turn))).alias("own"))
        .select("cls", "own.*")
        .select("gram", F.struct("n", "cls", "pos").alias("row"), "lead", "component", block.alias("block"))
        .select("lead", "component", "row", F.collect_list(me).over(window.rowsBetween(1, width)).alias("others"))
        .select("lead", "component", "row", F.explode("others").alias("other"))
        .where(F.col("component") != F.col("other.component"))
    )
    return met.select("row", "lead", "other").where(
        F.when(F.struct("row.n", "row.cls") < F.struct("other.row.n", "other.row.cls"), F.col("lead")).otherwise(
            F.col("other.lead")
        )
    ).select(F.least("row", "other.row").alias("x"), F.greatest("row", "other.row").alias("y"))


def similar_sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id``.

    A document's set holds the hashes of its distinct five-word shingles, A-Z lower-cased; with
    fewer words the whole sequence is one. Two documents link when ``100 * shared >= percent *
    union``; ``component_id`` is the smallest ``doc_id`` that links lead to, itself included.

    Null, empty and blank texts have no shingles and link with nothing. A row with a null
    ``doc_id`` has its count, and a null component unless it equals others. Repeated rows are all
    returned; an empty table gives no rows; other columns are ignored; long texts are read whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = stored(set_table(docs), "sets")
    total = table.agg(F.sum("n_shingles")).first()[0] or 0
    frequent = spark.sparkContext.broadcast(_frequent(docs))
    prefix_rows = total * (100 - percent) // 100
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prefix_rows // _FRAGMENT_ROWS))
    candidates = _Candidates(percent)
    rows = stored(_shared_rows(docs, frequent, parts, percent).withColumn("lead", candidates.lead), "prefixes")
    row = F.struct("n", "cls", "pos")
    leader = rows.groupBy("gram").agg(
        F.min(F.when(F.col("lead"), row)).alias("x"), F.min("cls").alias("low"), F.max("cls").alias("high")
    )
    # n-grams of one class, or that no smaller set can lead with, make no pair
    rows = stored(rows.join(leader.where("x IS NOT NULL AND low < high").select("gram", "x"), "gram"), "met")
    compared = stored(candidates.pairs(rows.select("x", row.alias("y")), "x", "y"), "pairs")
    rows = rows.drop("x")
    bits = table.where("bits IS NOT NULL").join(rows.select("cls").distinct(), "cls")
    bits = stored(bits.groupBy("cls").agg(F.min("bits").alias("part")), "bitmaps")
    links = _linked(docs, table, _near(bits, compared, percent), percent)
    for turn, width in enumerate([*NEIGHBOURS, None]):
        groups = stored(components(links), "groups")
        # components only grow, so what is apart later is apart now
        rows = apart = _apart(rows.select("gram", "cls", "n", "pos", "lead"), groups)
        if width is None:
            x = apart.where("lead").select("gram", row.alias("x"), F.col("component").alias("of_x"))
            y = apart.select("gram", row.alias("y"), F.col("component").alias("of_y"))
            met = x.join(y, "gram").where("of_x != of_y")
        else:
            met = _neighbours(apart, width, turn + 1)
        pairs = stored(candidates.pairs(met, "x", "y").join(compared, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        links = links.unionByName(_linked(docs, table, _near(bits, pairs, percent), percent))
        compared = compared.unionByName(pairs)
    groups = stored(components(links), "groups")
    per_class = (
        table.where("cls IS NOT NULL")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("least"))
        .join(groups.withColumnRenamed("id", "cls"), "cls", "left")
        .withColumn("component", F.coalesce("component", "cls"))
    )
    least = per_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = per_class.select("cls", "component").join(least, "component").select("cls", "component_id")
    return table.join(of_class, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
