"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import shared_folder as scratch  # noqa: F401
from ..functions.stages import written as materialise  # noqa: F401

#: Separators of the ASCII word rule: everything ASCII but digits and lower-case letters.
ALNUM_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Separators of the white-space word rule.
SPACE_SEPARATORS = r"[\x20\x09-\x0D]+"
#: Tables of up to so many bytes, by count and width of a row in a hash table, are broadcast.
BROADCAST_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts that are wholly ASCII take the fast built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separators: str) -> Column:
    """Words of a text (null: none); ``text`` is already lower-cased where that matters."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times within ``body``."""
    return F.transform(F.array(value), body)[0]


def small(rows: int, row_bytes: int) -> bool:
    """Whether so many rows may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows are few; else joins with it are shuffle joins."""
    return F.broadcast(df) if small(df.count(), row_bytes) else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    tail = ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def slices(texts: pa.Array, rows: int = 500, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a text column of up to ``rows`` rows and about ``size`` bytes; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = done = 0
    while first < len(ends):
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, done + size, "right"))))
        yield first, last
        first, done = last, int(ends[last - 1])
