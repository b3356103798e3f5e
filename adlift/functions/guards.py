"""Input guards that run on the driver before any job starts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    """Raise ``ValueError`` naming the first missing column (schema only, no job)."""
    present = set(df.columns)
    missing = [c for c in columns if c not in present]
    if missing:
        raise ValueError(f"{what} is missing column: {missing[0]}" if len(missing) == 1
                         else f"{what} is missing columns: {missing}")
