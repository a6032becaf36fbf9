"""Column names that every destination accepts."""

from __future__ import annotations

import re
from collections.abc import Iterable

MAX_LENGTH = 300


def clean_name(name: str) -> str:
    """Letters, digits and single underscores, lower case, not starting with a digit, never empty."""
    words = [w for w in re.split(r"[^A-Za-z0-9]+", name) if w]
    out = "_".join(words) or "column"
    if out[0].isdigit():
        out = "col_" + out
    return out[:MAX_LENGTH].rstrip("_").lower()


def clean_names(names: Iterable[str]) -> dict[str, str]:
    """Original to clean name; a name that is already taken gets a number."""
    taken: set[str] = set()
    out = {}
    for name in names:
        base = candidate = clean_name(name)
        n = 2
        while candidate in taken:
            candidate = f"{base}_{n}"
            n += 1
        taken.add(candidate)
        out[name] = candidate
    return out
