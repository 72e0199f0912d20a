"""Rows that share a key with others, found in one shuffle of packed rows.

Most keys of a corpus (hashes of n-grams, fingerprints of passages) occur once. Rows travel as
packed blocks to the fragment of their key, where sorting finds the keys that meet; only those
come out as rows. A task sends one row per key to the key's fragment. Rows whose key it has seen
twice are known to meet; they go to fragments by turns, so that a key that a third of all rows
have reaches its own fragment once per task and its rows are spread over all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import lean

#: bytes of rows that a task gathers before it sends them on
FLUSH_BYTES = 16 << 20
_SPREAD_ROWS = 50_000


def shared_rows(
    docs: DataFrame,
    emit: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
    fields: list[tuple[str, str]],
    parts: int,
    useful: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """``key`` and ``fields`` of the rows from ``emit`` whose key has two or more rows.

    ``emit`` gives structured arrays with a ``key`` (64 bits) and ``fields``, each a name and a
    numpy type, for a batch of ``docs``. A key comes out as 32 of its bits and its fragment: rows
    of different keys may, rarely, come out under one. A row may come out twice. ``useful`` says of
    arrays of first and second rows which pairs are worth having, for keys that have two rows in all.
    """
    packed = np.dtype([("key", "<u4"), *fields, ("more", "?")])
    names = [name for name, _ in fields]
    spread = np.uint64(parts)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = turn = 0

        def flushed():
            nonlocal turn
            rows = np.concatenate(held)
            held.clear()
            order = np.argsort(rows["key"], kind="stable")
            key = rows["key"][order]
            fragment = (((key >> np.uint64(32)) * spread) >> np.uint64(32)).astype(np.int64)
            out = np.empty(len(rows), packed)
            out["key"] = key & np.uint64(0xFFFFFFFF)
            for name in names:
                out[name] = rows[name][order]
            del rows, order
            new = np.concatenate(([True], key[1:] != key[:-1]))
            known = ~new
            known[:-1] |= ~new[1:]
            out["more"] = known
            target, sure, blobs = [], [], []

            def add(places: np.ndarray, is_known: bool):
                nonlocal turn
                for own in np.split(places, np.flatnonzero(np.diff(fragment[places])) + 1):
                    if len(own):
                        own_fragment = int(fragment[own[0]])
                        turn += 1
                        target.append((own_fragment + turn) % parts if is_known else own_fragment)
                        sure.append(is_known)
                        blobs.append(own_fragment.to_bytes(4, "little") + out[own].tobytes())

            add(np.flatnonzero(new), False)
            both = np.flatnonzero(known)
            for first in range(0, len(both), _SPREAD_ROWS):
                add(both[first : first + _SPREAD_ROWS], True)
            return pa.RecordBatch.from_arrays(
                [pa.array(target, pa.int32()), pa.array(sure, pa.bool_()), pa.array(blobs, pa.binary())],
                names=["part", "known", "rows"],
            )

        for batch in batches:
            for rows in emit(batch):
                held.append(rows)
                size += rows.nbytes
                if size >= FLUSH_BYTES:
                    yield flushed()
                    size = 0
        if size:
            yield flushed()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def out(fragment: int, rows: np.ndarray):
            key = (rows["key"].astype(np.int64) << 31) + fragment
            return pa.RecordBatch.from_arrays(
                [pa.array(key), *(pa.array(rows[n].astype(np.int64)) for n in names)], names=["key", *names]
            )

        def joined():
            rows = np.concatenate(held)
            held.clear()
            order = np.argsort(rows["key"], kind="stable")
            key = rows["key"][order]
            keep = np.zeros(len(rows), bool)
            keep[1:] = key[1:] == key[:-1]
            keep[:-1] |= keep[1:]
            rows = rows[order[keep]]
            if useful is not None and len(rows):
                key = rows["key"]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                two = first[np.diff(np.append(first, len(rows))) == 2]
                two = two[~rows["more"][two] & ~rows["more"][two + 1]]
                vain = two[~useful(rows[two], rows[two + 1])]
                stay = np.ones(len(rows), bool)
                stay[vain] = stay[vain + 1] = False
                rows = rows[stay]
            return out(part, rows)

        for batch in batches:
            for known, blob in zip(batch.column("known").to_pylist(), batch.column("rows").to_pylist()):
                fragment, rows = int.from_bytes(blob[:4], "little"), np.frombuffer(blob, packed, offset=4)
                if known:
                    yield out(fragment, rows)
                    continue
                if fragment != part:
                    if held:
                        yield joined()
                    part, held = fragment, []
                held.append(rows)
        if held:
            yield joined()

    return (
        docs.mapInArrow(lean(sent), "part int, known boolean, rows binary")
        .repartition(parts, "part")
        .sortWithinPartitions("known", "part")
        .mapInArrow(lean(met), ", ".join(["key long", *(f"{n} long" for n in names)]))
    )
