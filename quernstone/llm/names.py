"""Names for columns that operators add for their own use, so that no column of the caller's table can clash."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(columns: list[str] | DataFrame, *stems: str) -> list[str]:
    """One name per stem that no column has, whatever its case: the stem with as many underscores as it takes."""
    taken = {c.lower() for c in (columns.columns if isinstance(columns, DataFrame) else columns)}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
