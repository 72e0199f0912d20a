"""Compares two results whose rows and columns may come in any order."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sorted_result(names, rows):
    """Columns by name, rows by their text."""
    places = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(row[i] for i in places) for row in rows]
    return sorted(names), sorted(cells, key=lambda r: tuple((v is None, str(v)) for v in r))


def equal(a, b, tolerance: float = 0.0) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        both_nan = math.isnan(a) and math.isnan(b)
        return a == b or both_nan or math.isclose(a, b, rel_tol=tolerance)
    return a == b


def differences(got, want, tolerance: float = 0.0) -> list:
    """Pairs of rows that differ; names or counts that differ come first."""
    if got[0] != want[0] or len(got[1]) != len(want[1]):
        return [((got[0], len(got[1])), (want[0], len(want[1])))]
    return [
        (a, b)
        for a, b in zip(got[1], want[1])
        if not all(equal(x, y, tolerance) for x, y in zip(a, b))
    ]
