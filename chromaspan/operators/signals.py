"""Activity columns: their grammar, their names, and long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_columns(spec: str, width: int) -> list[int]:
    """1-based column numbers of a selection: ``4``, ``4,6``, ``4-6`` or ``4+`` (to the last); 0 or empty is none.

    A hyphen makes a range, tested before a plus, that before a comma. Lists drop numbers beyond the file.
    """
    spec = spec.strip()
    if spec in ("", "0"):
        return []
    if "-" in spec:
        parts = spec.replace(",", "-").split("-")
        return list(range(int(parts[0]), int(parts[-1]) + 1))
    if "+" in spec:
        return list(range(int(spec.split("+")[0]), width + 1))
    if "," in spec:
        return [n for n in map(int, filter(None, spec.split(","))) if n <= width]
    return [int(spec)]


def column_name(header: str | None, number: int) -> str:
    """Suffix for a column's outputs: from the header, or from its number if there is none."""
    name = (header or "").strip().replace(" ", "_")
    return f"_{name}" if name else f"_c{number}"


def unpivot_signals(peaks: DataFrame, columns: list[str], key: str = "peak_id") -> DataFrame:
    """(key, column, signal) in long form: the activity column becomes a grouping key."""
    return peaks.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "column", "signal")
