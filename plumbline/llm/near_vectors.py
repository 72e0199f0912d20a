"""Near-duplicate embeddings by tiled comparison in the order of principal components.

Vectors are scaled to length one and turned into the basis of their principal components, most
variance first. Tiles of bounded size hold neighbours along the leading components; pairs of tiles
whose boxes are too far apart there are left out. In a pair of tiles the products of the leading
dimensions are summed first. What the other dimensions can add is at most the product of the two
norms over them (Cauchy and Schwarz), so a pair stops as soon as its cosine cannot reach the
threshold. Pairs that are left get their cosine from the vectors as given, in double precision.

Every tile has to meet every other, but no more than a few copies of them exist at a time. Runs of
tiles form blocks. A task holds one block, and tiles of others go past it; tasks come in rounds, and
the shuffle files of a round go when it ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean
from plumbline.llm.components import components
from plumbline.session import stored, stored_parts

#: vectors of a tile, leading components that its box covers, and those along which it is cut out
TILE, BOX_AXES, CUT_AXES = 512, 8, 3
#: bytes of the vectors of a block, and blocks of a small table
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 12
#: copies of all tiles that a round deals out, or these bytes of them if that is more
ROUND_COPIES, ROUND_BYTES = 2, 128 << 20
#: rows of a tile that are compared at a time
_ROWS = 512


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Columns are the principal axes, most variance first; only ``size``² sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0), size))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["place", "value"]
        )

    sums = (
        vectors.select("vector")
        .mapInArrow(run, "place long, value double")
        .groupBy("place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    moment = np.zeros(size * size)
    for row in sums:
        moment[row.place] = row.value
    _, axes = np.linalg.eigh(moment.reshape(size, size))
    return axes[:, ::-1]


_TILES = "shard long, tile long, n long, low array<double>, high array<double>, ids binary, counts binary, vectors binary"


def _runs(x: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """Places of neighbouring vectors, at most ``rows`` each: cut in the middle of the widest axis until short."""
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= rows:
            yield own
            continue
        axis = int(np.argmax(np.ptp(x[own], axis=0)))
        cut = -(-len(own) // (2 * rows)) * rows
        order = own[np.argpartition(x[own, axis], cut)]
        todo += [order[cut:], order[:cut]]


def _tiles(reps: DataFrame, axes: np.ndarray, rows: int, parts: int) -> DataFrame:
    """Tiles of up to ``rows`` vectors; those of a shard lie next to each other along the first axis."""
    size = len(axes)
    lead = axes[:, :BOX_AXES].copy()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _unit(_matrix(batch.column("vector"), size)) @ lead[:, 0] if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"]
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        del held
        reps, many = (whole.column(c).to_numpy().astype("<i8") for c in ("rep", "many"))
        flat = whole.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        turned = np.concatenate(
            [_unit(flat[at : at + rows].astype(np.float64)) @ lead for at in range(0, len(flat), rows)]
        )
        for tile, own in enumerate(_runs(turned[:, :CUT_AXES], rows)):
            wide = flat[own].astype("<f8")
            kept = wide.astype("<f4")
            kept = kept if np.array_equal(kept.astype("<f8"), wide) else wide
            cells = [
                pa.array([shard], pa.int64()), pa.array([(shard << 32) + tile], pa.int64()), pa.array([len(own)], pa.int64()),
                *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (turned[own].min(axis=0), turned[own].max(axis=0))),
                *(pa.array([x.tobytes()], pa.binary()) for x in (reps[own], many[own], kept)),
            ]
            yield pa.RecordBatch.from_arrays(
                cells, names=["shard", "tile", "n", "low", "high", "ids", "counts", "vectors"]
            )

    schema = f"rep long, many long, vector {reps.schema['vector'].dataType.simpleString()}, place double"
    return (
        reps.mapInArrow(placed, schema)
        .repartitionByRange(parts, "place", "rep")
        .sortWithinPartitions("place", "rep")
        .mapInArrow(lean(packed), _TILES)
    )


class _Tile:
    """Vectors of a tile as a task compares them: of length one, and turned into the principal axes."""

    def __init__(self, row: dict, axes: np.ndarray):
        self.ids, self.counts = (np.frombuffer(row[c], "<i8") for c in ("ids", "counts"))
        self.low, self.high = np.array(row["low"]), np.array(row["high"])
        wide = len(row["vectors"]) == 8 * len(axes) * len(self.ids)
        raw = np.frombuffer(row["vectors"], "<f8" if wide else "<f4").reshape(len(self.ids), -1)
        self.unit = _unit(raw.astype(np.float64))
        turned = self.unit @ axes
        self.first = _side(turned, _steps(len(axes))[0])
        self.turned = turned.astype(np.float32)


def _steps(size: int) -> list[int]:
    """Leading dimensions that are compared first, then, and at last."""
    return [s for s in (max(4, size * 3 // 8), size * 5 // 8) if s < size] + [size]


def _side(turned: np.ndarray, step: int) -> np.ndarray:
    """Leading dimensions and the norm of the others: products of such rows are never below the cosine."""
    rest = np.sqrt((turned[:, step:] ** 2).sum(axis=1, keepdims=True))
    return np.concatenate([turned[:, :step], rest], axis=1).astype(np.float32)


def _links(a: _Tile, b: _Tile, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked rows of two tiles; each pair once if they are the ``same``."""
    size = a.unit.shape[1]
    # more than single precision can be off in a product of two rows of length one
    slack = (size + 16) * 2.0**-23
    low, steps = least - slack, _steps(size)
    part = max(1, (1 << 22) // size)
    buffer = np.empty((_ROWS, len(b.unit)), np.float32)
    for at in range(0, len(a.unit), _ROWS):
        rows = slice(at, at + _ROWS)
        near = buffer[: len(a.unit[rows])]
        for step in steps:
            if step == steps[0]:
                np.matmul(a.first[rows], b.first.T, out=near)
            else:
                np.matmul(_side(a.turned[rows], step), _side(b.turned, step).T, out=near)
            some = np.flatnonzero(near.max(axis=1) >= low) if near.max() >= low else np.empty(0, np.int64)
            few = near[some] >= low
            if step == size or np.count_nonzero(few) * 50 < near.size:
                break
        if not len(some):
            continue
        i, j = np.nonzero(few)
        sure = near[some][few] >= least + slack if step == size else np.zeros(len(i), bool)
        i = some[i] + at
        if same:
            keep = i < j
            i, j, sure = i[keep], j[keep], sure[keep]
        open_ = np.flatnonzero(~sure)
        for k in range(0, len(open_), part):
            these = open_[k : k + part]
            sure[these] = np.einsum("ij,ij->i", a.unit[i[these]], b.unit[j[these]]) >= least
        if sure.any():
            yield i[sure], j[sure]


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root``, the smallest place that each place is connected to, after these pairs are connected too."""
    apart = root[i] != root[j]
    i, j = i[apart], j[apart]
    while len(i):
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _apart(a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray, reach: float) -> np.ndarray:
    """Whether boxes are further apart than ``reach``."""
    gap = np.maximum(0.0, np.maximum(a_low - b_high, b_low - a_high))
    return np.sqrt((gap * gap).sum(axis=-1)) > reach


_FOUND = "rep long, links long, other long"


class _Block:
    """The tiles that a task holds, what their rows link with, and the smallest place each leads to."""

    def __init__(self, least: float, reach: float):
        self.least, self.reach = least, reach
        self.tiles: list[_Tile] = []
        self.starts: list[int] = []
        self.ids, self.counts, self.links, self.root = (np.empty(0, np.int64) for _ in range(4))

    def _met(self, tile: _Tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of held rows and of the tile's that link."""
        low, high = np.array([t.low for t in self.tiles]), np.array([t.high for t in self.tiles])
        for k in np.flatnonzero(~_apart(low, high, tile.low, tile.high, self.reach)):
            for i, j in _links(self.tiles[k], tile, self.least, self.tiles[k] is tile):
                yield i + self.starts[k], j

    def hold(self, tile: _Tile, compared: bool) -> None:
        """Adds a tile; it is ``compared`` with itself and those held before, unless another task does that."""
        start = len(self.ids)
        self.tiles.append(tile)
        self.starts.append(start)
        self.ids, self.counts = np.concatenate([self.ids, tile.ids]), np.concatenate([self.counts, tile.counts])
        self.links = np.concatenate([self.links, np.zeros(len(tile.ids), np.int64)])
        self.root = np.concatenate([self.root, np.arange(start, len(self.ids))])
        for i, j in self._met(tile) if compared else ():
            np.add.at(self.links, i, tile.counts[j])
            np.add.at(self.links, j + start, self.counts[i])
            self.root = _joined(self.root, i, j + start)

    def meet(self, tile: _Tile) -> pa.RecordBatch:
        """What the rows of a tile of another block link with, and one held row each leads to."""
        links, leads = np.zeros(len(tile.ids), np.int64), np.full(len(tile.ids), -1)
        for i, j in self._met(tile):
            np.add.at(self.links, i, tile.counts[j])
            np.add.at(links, j, self.counts[i])
            new = leads[j] < 0
            leads[j[new]] = i[new]
            self.root = _joined(self.root, i, leads[j])
        own = np.flatnonzero(leads >= 0)
        return _found(tile.ids[own], links[own], self.ids[leads[own]])

    def end(self) -> pa.RecordBatch:
        own = np.flatnonzero(self.links)
        return _found(self.ids[own], self.links[own], self.ids[self.root[own]])


def _found(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "links", "other"])


def _compared(axes: np.ndarray, least: float, reach: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles of the block that the task holds come first."""
        block = _Block(least, reach)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                tile = _Tile(row, axes)
                if row["part"] < 2:
                    block.hold(tile, row["part"] == 0)
                else:
                    yield block.meet(tile)
        yield block.end()

    return lean(run)


def _blocks(shards: list, rows: int) -> list[dict]:
    """Runs of shards with about ``rows`` vectors, with their boxes."""
    blocks, held = [], 0
    for s in sorted(shards, key=lambda s: s.shard):
        place, held = (held + s.n // 2) // rows, held + s.n
        if not blocks or blocks[-1]["place"] != place:
            blocks.append({"place": place, "shards": [], "n": 0, "low": np.array(s.low), "high": np.array(s.high)})
        own = blocks[-1]
        own["shards"].append(s.shard)
        own["n"] += s.n
        own["low"], own["high"] = np.minimum(own["low"], s.low), np.maximum(own["high"], s.high)
    return blocks


def _rounds(blocks: list[dict], reach: float, most: int) -> Iterator[list[tuple[int, bool, list[int]]]]:
    """Rounds of tasks: the block that a task holds, whether it is compared with itself, and the blocks that go past.

    Two blocks meet once, in the task of that which is followed by the other within half a turn. The
    blocks of a round hold ``most`` vectors, unless one task has more.
    """
    count, total = len(blocks), sum(b["n"] for b in blocks)
    run = max(1, most // total - 1)
    tasks: list[tuple[int, bool, list[int]]] = []
    dealt = 0
    for first in range(1, max(1, count // 2) + 1, run):
        for held, own in enumerate(blocks):
            steps = [d for d in range(first, min(first + run, count // 2 + 1)) if 2 * d < count or held < d]
            past = [(held + d) % count for d in steps]
            past = [p for p in past if not _apart(own["low"], own["high"], blocks[p]["low"], blocks[p]["high"], reach)]
            if not past and first > 1:
                continue
            n = own["n"] + sum(blocks[p]["n"] for p in past)
            if tasks and dealt + n > most:
                yield tasks
                tasks, dealt = [], 0
            tasks.append((held, first == 1, past))
            dealt += n
    if tasks:
        yield tasks


def _dealt(tiles: DataFrame, blocks: list[dict], tasks: list[tuple[int, bool, list[int]]]) -> DataFrame:
    """The tiles of each task in a partition: part 0 or 1 are held, compared with each other or not, 2 go past."""
    plan = [
        (shard, task, 2 if at else 1 - compared)
        for task, (held, compared, past) in enumerate(tasks)
        for at, block in enumerate([held, *past])
        for shard in blocks[block]["shards"]
    ]
    plan = tiles.sparkSession.createDataFrame(plan, "shard long, task int, part int")
    return (
        tiles.join(F.broadcast(plan), "shard")
        .repartitionById(len(tasks), "task")
        .sortWithinPartitions("part", "tile")
        .select("part", "low", "high", "ids", "counts", "vectors")
    )


def near_vectors(table: DataFrame, least: float = 0.95, tile: int = TILE) -> DataFrame:
    """Per row of ``table(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Two vectors link if their cosine, in double precision, is ``least`` or more. ``n_links``
    counts the other rows a row links with, ``component_id`` is the smallest ``vec_id`` that links
    lead to, itself included, ``kept`` says that it is the row's own. All pairs are decided.

    A vector that is null, empty, zero, or holds null or non-finite components links with nothing,
    and so does one whose ``vec_id`` is null. Vectors of equal length are compared, each length on its
    own. Equal vectors are compared once and counted as often as they occur; repeated rows link with each
    other. An empty table gives no rows; other columns are ignored.
    """
    floats = table.select("embedding").schema[0].dataType.simpleString() == "array<float>"
    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        # single precision stays as it is: half the bytes, the same numbers
        F.col("embedding").cast("array<float>" if floats else "array<double>").alias("vector"),
    )
    sound = (
        F.col("vec_id").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vector", lambda v: v != 0)
    )
    marked = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    marks = [F.when(F.col("sound"), F.xxhash64(F.lit(s), "vector")).alias(f"mark{s}") for s in (1, 2)]
    valid = marked.where("sound").select("vec_id", "vector", *marks)
    lengths = [r[0] for r in valid.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    per_rep = reduce(
        DataFrame.unionByName, [_of_length(valid.where(F.size("vector") == n), n, least, tile) for n in lengths]
    )
    return (
        marked.select("vec_id", *marks)
        .join(per_rep, ["mark1", "mark2"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def _of_length(valid: DataFrame, size: int, least: float, tile: int) -> DataFrame:
    """``mark1, mark2, n_links, component_id`` of each distinct vector, all of them ``size`` long."""
    spark = valid.sparkSession
    reps = stored(
        valid.groupBy("mark1", "mark2").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("vector").alias("vector")
        ),
        "vectors",
    )
    axes = principal_axes(reps, size)
    count = reps.count()
    rows = max(min(tile, BLOCK_BYTES // (4 * size)), 1)
    per_block = max(rows, min(BLOCK_BYTES // (4 * size), -(-count // LEAST_BLOCKS)))
    tiles = stored(_tiles(reps.select("rep", "many", "vector"), axes, rows, -(-count // per_block)), "tiles")
    box = range(min(BOX_AXES, size))
    shards = tiles.groupBy("shard").agg(
        F.sum("n").alias("n"),
        F.array(*[F.min(F.col("low")[k]) for k in box]).alias("low"),
        F.array(*[F.max(F.col("high")[k]) for k in box]).alias("high"),
    )
    blocks = _blocks(shards.collect(), per_block)
    # unit vectors further apart than this cannot link
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * least))) + 1e-6
    most = max(ROUND_COPIES * count, ROUND_BYTES // (4 * size + 16))
    compared = stored_parts(
        spark,
        (
            _dealt(tiles, blocks, tasks).mapInArrow(_compared(axes, least, reach), _FOUND)
            for tasks in _rounds(blocks, reach, most)
        ),
        "compared",
        _FOUND,
    )
    groups = components(compared, "rep", "other")
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    return (
        reps.select("mark1", "mark2", "rep", "many")
        .join(links, "rep", "left")
        .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "mark1", "mark2",
            (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
