"""Column names that clash with none there are."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(name: str, columns: Iterable[str]) -> str:
    """name, with underscores in front until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
