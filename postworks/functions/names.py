"""Names of columns that pass."""

from __future__ import annotations

from collections.abc import Iterable


def free(name: str, taken: Iterable[str]) -> str:
    """A name that no column has yet."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name
