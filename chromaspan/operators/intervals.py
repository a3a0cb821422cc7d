"""Interval joins on (chr, start, end), half-open.

Without a range-join operator, the chromosome alone would be the join key: few keys, each with a
large part of the rows. The binned form gives every interval one row for each bin it touches and
joins on (chr, bin), so that work is spread by position and a dense chromosome is no hot key. A
pair that shares several bins is kept in one of them only, the first that both touch, so no
distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import dealt, fresh, is_small

#: Bin width where none is given.
WIDTH = 5000
#: Suffixes of the right side's columns while a join runs.
_R = "__r_"


def _binned(df: DataFrame, start: str, end: str, width: int, names: list[str]) -> DataFrame:
    """Adds the first bin and, in a row each, the bins that an interval touches, under two new names."""
    first = F.floor(F.col(start) / width).cast("long")
    last = F.greatest(first, F.floor((F.col(end) - 1) / width).cast("long"))
    return df.withColumn(names[0], first).withColumn(names[1], F.explode(F.sequence(first, last)))


def _renamed(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(_R + c) for c in df.columns])


def _overlap(start: str, end: str) -> Column:
    return (F.col(start) < F.col(_R + end)) & (F.col(_R + start) < F.col(end))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", width: int | None = 5000, start: str = "start", end: str = "end", prefix: str = "r_", parts: int | None = None) -> DataFrame:
    """Rows of ``left`` with overlapping rows of ``right`` on the same ``chr``.

    ``how``: ``inner`` gives all pairs (the right side's columns get ``prefix``), ``left_semi`` and
    ``left_anti`` rows of ``left`` with and without a partner, each row once. ``width`` is the bin
    width. None is for a small right side: if its count allows that it is broadcast and held against
    its chromosome's rows; else bins of WIDTH are taken. All pairs are made in ``parts`` partitions, if given. Null chromosomes or bounds overlap nothing.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unknown join {how}")
    same_chr = F.col("chr") == F.col(_R + "chr")
    out = [*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"`{_R}{c}`").alias(prefix + c) for c in right.columns]]
    if width is None and is_small(right):
        joined = left.join(F.broadcast(_renamed(right)), same_chr & _overlap(start, end), how)
        return joined.select(out) if how == "inner" else joined
    width = width or WIDTH
    if how != "inner":
        # A row has a partner if any of its bins has one; places are joined back to the rows.
        names = ["first_", "bin_"]
        hits = _binned(left.select("chr", start, end).distinct(), start, end, width, names)
        found = hits.join(_renamed(_binned(right.select("chr", start, end), start, end, width, names)), same_chr & (F.col("bin_") == F.col(_R + "bin_")) & _overlap(start, end), "left_semi")
        return keep_places(left, found, how, start, end)
    l_names, r_names = fresh(left, "first_", "bin_"), fresh(right, "first_", "bin_")
    l, r = _binned(left, start, end, width, l_names), _renamed(_binned(right, start, end, width, r_names))
    if parts:
        l = dealt(l, parts, "chr", l_names[1])
    once = F.col(l_names[1]) == F.greatest(l_names[0], _R + r_names[0])
    return l.join(r, same_chr & (F.col(l_names[1]) == F.col(_R + r_names[1])) & _overlap(start, end) & once).select(out)


def paired_bytes(left: DataFrame, right: DataFrame, row_bytes: Column, width: int | None = None) -> float:
    """An upper bound of the bytes of all overlapping pairs, of ``row_bytes`` each, from the numbers of intervals in bins."""
    width = width or WIDTH
    names = ["first_", "bin_"]
    l = _binned(left.select("chr", "start", "end", row_bytes.cast("double").alias("bytes_")), "start", "end", width, names).groupBy("chr", "bin_").agg(F.sum("bytes_").alias("bytes_"))
    r = _binned(right.select("chr", "start", "end"), "start", "end", width, names).groupBy("chr", "bin_").agg(F.count("*").alias("n_"))
    return l.join(r, ["chr", "bin_"]).agg(F.sum(F.col("bytes_") * F.col("n_"))).first()[0] or 0.0


def keep_places(left: DataFrame, found: DataFrame, how: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows of ``left`` whose place is (``left_semi``) or is not (``left_anti``) among those of ``found``."""
    c, s, e = fresh(left, "c_", "s_", "e_")
    places = found.select(F.col("chr").alias(c), F.col(start).alias(s), F.col(end).alias(e)).distinct()
    return left.join(places, (F.col("chr") == F.col(c)) & (F.col(start) == F.col(s)) & (F.col(end) == F.col(e)), how)


def equal_join(left: DataFrame, right: DataFrame, prefix: str = "r_", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs that cover each other wholly, that is, equal intervals: a plain equi-join."""
    r = _renamed(right)
    on = (F.col("chr") == F.col(_R + "chr")) & (F.col(start) == F.col(_R + start)) & (F.col(end) == F.col(_R + end))
    return left.join(r, on).select(*left.columns, *[F.col(_R + c).alias(prefix + c) for c in right.columns])


def exclude_regions(regions: DataFrame, excluded: DataFrame, width: int | None = 5000) -> DataFrame:
    """Regions that no excluded interval overlaps."""
    return overlap_join(regions, excluded, "left_anti", width)
