"""Names for internal columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until `docs` has no column of that name."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
