"""Column and dataset names from file headers. Schema metadata only, so plain Python."""

from __future__ import annotations

import re
from collections.abc import Iterable

# The name of something nameless, and what goes before a leading digit.
NAMELESS = "dataset"


def slug(text: str) -> str:
    """Lower-case words joined by underscores."""
    words = "_".join(re.findall(r"[a-z0-9]+", text.lower())) or NAMELESS
    return f"{NAMELESS}_{words}" if words[0].isdigit() else words


def display_names(headers: Iterable[str | None]) -> list[str]:
    """Header texts, a blank one being named by its position."""
    texts = [(h or "").strip().lstrip("﻿").strip() for h in headers]
    return [text or f"column {place}" for place, text in enumerate(texts, 1)]


def column_names(headers: Iterable[str | None]) -> list[str]:
    """Unique identifiers for headers: a repeated name gets ``_2``, ``_3`` and so on."""
    taken: list[str] = []
    for text in display_names(headers):
        name, copies = slug(text), 1
        unique = name
        while unique in taken:
            copies += 1
            unique = f"{name}_{copies}"
        taken.append(unique)
    return taken
