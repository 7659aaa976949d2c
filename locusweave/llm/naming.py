"""Column names that cannot clash with the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted name one that no column of ``df`` has (case ignored), made by adding underscores."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def set_apart(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with its columns named given_0, given_1, ..., those names, and the old ones in their order, so that no name clashes with the operator's."""
    safe = [f"given_{k}" for k in range(len(df.columns))]
    return df.toDF(*safe), safe, df.columns
