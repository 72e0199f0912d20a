"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations.

A document of a source is wanted ``target / source size`` times, the same for all of its source.
The whole part is given at once. The fractions are rounded together: two documents meet, mass
moves at random from one to the other until one of them is integral, and the other goes on to the
next. Expected copies stay as they are, and the number of copies of every group of documents
differs by less than one from what was wanted. Documents meet others of about their size, so
that the words differ little too. Groups of bounded size are rounded on their own; what is left
of each, one fractional document, is rounded with the rest of other groups up a reduction tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS
from plumbline.session import stored

WORD = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-9


def _uniform(*parts) -> Column:
    """A number in [0, 1) that depends on nothing but ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def source_targets(
    bands: DataFrame, weights: tuple[float, ...], share: float, most: float
) -> DataFrame:
    """``source, sid, source_size, target`` of each source, from counts per source and band.

    A window over one row per source. ``share`` of all words is dealt by weight; a target
    stops at ``most`` times its source's size. The level that the others reach is the largest of
    the levels found by taking the sources as full one after another.
    """
    sources = bands.groupBy("source").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sources.withColumn("sid", F.row_number().over(order)).withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            ((F.col("sid") - 1) % len(weights) + 1).cast("int"),
        ),
    )
    limit = F.lit(float(most)) * F.col("source_size")
    fullest = Window.orderBy(limit / F.col("weight"), "sid")
    every = Window.partitionBy()
    before = F.sum(limit).over(fullest.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("weight").over(fullest.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(before, F.lit(0.0))) / left
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(every))
        .select("source", "sid", "source_size", F.least(limit, F.col("level") * F.col("weight")).alias("target"))
    )


def _rounded(items: Column, seed: int) -> Column:
    """Folds ``items`` (with a share ``p`` in [0, 1)) pair by pair.

    Gives ``held`` (place of the one that is still fractional, else -1), its ``p``, and ``won``,
    the places that became one.
    """
    nothing = F.struct(F.lit(-1).alias("held"), F.lit(0.0).alias("p"), F.array().cast("array<int>").alias("won"))

    def state(held, p, won):
        return F.struct(held.cast("int").alias("held"), p.cast("double").alias("p"), won.alias("won"))

    def meet(s: Column, i: Column) -> Column:
        item = F.get(items, i)
        p, total = item["p"], s["p"] + item["p"]
        u = _uniform(item, i, F.lit(seed))
        keeps = u * total < s["p"]
        old_wins = u * (2.0 - total) < 1.0 - p
        loser = F.when(old_wins, i).otherwise(s["held"])
        winner = F.when(old_wins, s["held"]).otherwise(i)
        rest = total - 1.0
        return (
            F.when(p <= _NEAR, s)
            .when(s["held"] < 0, state(i, p, s["won"]))
            .when(rest < -_NEAR, state(F.when(keeps, s["held"]).otherwise(i), total, s["won"]))
            .when(
                rest <= _NEAR,
                state(F.lit(-1), F.lit(0.0), F.concat(s["won"], F.array(winner.cast("int")))),
            )
            .otherwise(state(loser, rest, F.concat(s["won"], F.array(winner.cast("int")))))
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), nothing, meet)


def _level(nodes: DataFrame, seed: int) -> DataFrame:
    """``nodes`` with ``items``, rounded; stored, since the way down reads it again."""
    done = nodes.withColumn("fold", _rounded(F.col("items"), seed))
    return stored(
        done.select(
            "sid", "band", "node", "items", "fold.held", "fold.p", "fold.won",
            F.get("items", "fold.held")["size"].alias("held_size"),
        ),
        "mixing",
    )


def _settled(level: DataFrame, decided: DataFrame) -> DataFrame:
    """One row per item of ``level``, with its ``bit``."""
    return (
        level.join(decided, "node", "left")
        .select("sid", "won", "held", "bit", F.posexplode("items").alias("place", "item"))
        .select(
            "sid",
            "item",
            F.when(F.array_contains("won", F.col("place")), 1)
            .when(F.col("place") == F.col("held"), F.coalesce("bit", F.lit(0)))
            .otherwise(0)
            .alias("bit"),
        )
    )


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    group: int = 512,
    seed: int = 7,
) -> DataFrame:
    """Per row: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` counts the words of ``text``; sources in the order of their code points, null last,
    take the weights in turn. ``copies`` is the whole part of ``target / source_size`` or one
    more, ``taken`` is ``copies * size``. Random numbers come from a hash of ids and ``seed``, so
    reruns agree however the rows are partitioned; ``group`` is the expected size of a group.

    Null and empty texts have size 0 and take part; a null source is a source; a null ``doc_id``
    is an id; each repeated row is a row. A source without words has target 0, an empty table
    gives no rows. Other columns are ignored.
    """
    sizes = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("band", F.length(F.bin("size"))),
        "sizes",
    )
    bands = sizes.groupBy("source", "band").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    bands = stored(bands, "bands")
    targets = source_targets(bands, weights, share, most).withColumnRenamed("source", "own_source")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted + _NEAR)
    plan = stored(
        bands.join(targets, F.col("source").eqNullSafe(F.col("own_source")))
        .select(
            F.col("source").alias("own_source"), F.col("band").alias("own_band"), "sid", "source_size", "target",
            whole.cast("long").alias("whole"),
            F.greatest(wanted - whole, F.lit(0.0)).alias("p"),
            F.ceil(F.col("n") / group).cast("long").alias("groups"),
        ),
        "plan",
    )
    few = plan.count() <= BROADCAST_ROWS
    place = sizes.join(
        F.broadcast(plan) if few else plan,
        F.col("source").eqNullSafe(F.col("own_source")) & (F.col("band") == F.col("own_band")),
    )
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("groups"))
    item = F.struct("size", F.xxhash64("doc_id", F.lit(seed + 1)).alias("mark"), "doc_id", "p")
    first = (
        place.groupBy("sid", "band", bucket.alias("bucket"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .withColumn("node", F.concat_ws(":", F.lit("0"), "sid", "band", "bucket"))
    )
    levels = [_level(first, seed)]
    while True:
        open_ = levels[-1].where(F.col("held") >= 0)
        counts = open_.groupBy("sid", "band").agg(F.count("*").alias("n"))
        crowded, wide = counts.agg(F.max("n"), F.count("*") > F.count_distinct("sid")).first()
        if crowded is None or (crowded == 1 and not wide):
            break
        if crowded == 1:  # the bands of a source meet last
            open_ = open_.withColumn("band", F.lit(0))
            counts = open_.groupBy("sid", "band").agg(F.count("*").alias("n"))
        child = F.struct(F.col("held_size").alias("size"), F.col("node"), F.col("p"))
        up = (
            open_.join(counts, ["sid", "band"])
            .withColumn("bucket", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / group)))
            .groupBy("sid", "band", "bucket")
            .agg(F.sort_array(F.collect_list(child)).alias("items"))
            .withColumn("node", F.concat_ws(":", F.lit(str(len(levels))), "sid", "band", "bucket"))
        )
        levels.append(_level(up, seed + len(levels)))
    decided = (
        levels[-1]
        .where(F.col("held") >= 0)
        .select("node", (_uniform("node", F.lit(seed)) < F.col("p")).cast("int").alias("bit"))
    )
    for below in range(len(levels) - 1, 0, -1):
        decided = _settled(levels[below], decided).select(F.col("item.node").alias("node"), "bit")
    per_source = plan.select("sid", F.col("own_source").alias("source"), "source_size", "target", "whole").distinct()
    copies = F.col("whole") + F.col("bit")
    return (
        _settled(levels[0], decided)
        .join(F.broadcast(per_source) if few else per_source, "sid")
        .select(
            F.col("item.doc_id").alias("doc_id"),
            "source",
            F.col("item.size").alias("size"),
            "source_size",
            "target",
            copies.alias("copies"),
            (copies * F.col("item.size")).alias("taken"),
        )
    )


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns they came with.

    Rows that share a ``doc_id`` get the copies decided for it in the order of source and size.
    """
    own = docs.columns
    same = Window.partitionBy("_id").orderBy(F.asc_nulls_last("_source"), "_size")
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.col("source").cast("string").alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
    ).withColumn("_nth", F.row_number().over(same))
    decided = (
        mixed(docs, **parameters)
        .select(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
            F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies"),
        )
        .withColumn("_nth", F.row_number().over(same.orderBy(F.asc_nulls_last("_source"), "_size", "_copies")))
        .where(F.col("_copies") > 0)
        .select("_id", "_nth", "_copies")
    )
    return (
        sized.join(decided, ["_id", "_nth"])
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
        .select("_row.*")
    )
