"""Chromatin contacts in coordinate form: canonical cells, distance profile, power-law fit, diagonal, lookup.

Matrices are never densified: a cell is a row (chr, bin1, bin2, contact) with bin1 <= bin2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MEGABASE, bin_of, power_law_pseudocount
from ..functions.stages import dealt, fresh


def canonical(raw: DataFrame, bin_size: int) -> DataFrame:
    """Cells from (chr, pos1, pos2, contact): positions to bins, the smaller first, NaN and non-positive contacts left out."""
    a, b = bin_of("pos1", bin_size), bin_of("pos2", bin_size)
    ok = F.col("contact").isNotNull() & ~F.isnan(F.col("contact").cast("double")) & (F.col("contact") > 0)
    return raw.where(ok).select("chr", F.least(a, b).alias("bin1"), F.greatest(a, b).alias("bin2"), F.col("contact").cast("double").alias("contact"), *[c for c in raw.columns if c == "ord"])


def last_cells(cells: DataFrame) -> DataFrame:
    """One row a cell; of repeated ones (with a file order ``ord``) the last. Without ``ord`` cells are taken as unique."""
    if "ord" not in cells.columns:
        return cells
    return cells.groupBy("chr", "bin1", "bin2").agg(F.max_by("contact", "ord").alias("contact"))


def span(cells: DataFrame) -> DataFrame:
    """(chr, min_bin, max_bin) over all contacts."""
    return cells.groupBy("chr").agg(F.min("bin1").alias("min_bin"), F.max("bin2").alias("max_bin"))


def distance_profile(cells: DataFrame, bin_size: int) -> DataFrame:
    """(chr, d, total, mean): contact sums by bin distance from 1 to below a megabase, over the number of possible pairs.

    The number is max_bin - min_bin - d; where it is not positive the mean is null.
    """
    d = F.col("bin2") - F.col("bin1")
    sums = cells.where((d >= 1) & (d * bin_size < MEGABASE)).groupBy("chr", d.alias("d")).agg(F.sum("contact").alias("total"))
    possible = F.col("max_bin") - F.col("min_bin") - F.col("d")
    spans = span(cells).withColumnRenamed("chr", "__c")
    return sums.join(spans, F.col("chr") == F.col("__c")).select("chr", "d", "total", F.when(possible > 0, F.col("total") / possible).alias("mean"), (possible <= 0).alias("degenerate"))


def power_law(cells: DataFrame, bin_size: int) -> DataFrame:
    """(chr, slope, intercept) of ln(mean contact) over ln(distance); null where no fit is possible."""
    profile = distance_profile(cells, bin_size).where("total > 0")
    x, y = F.log(F.col("d") * bin_size), F.log("mean")
    fit = profile.groupBy("chr").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max("degenerate").alias("bad"), F.count("*").alias("n"))
    ok = ~F.col("bad") & (F.col("n") > 1) & ~F.isnan("slope")
    return fit.select("chr", F.when(ok, F.col("slope")).alias("slope"), F.when(ok, F.col("intercept")).alias("intercept"))


def with_diagonal(cells: DataFrame) -> DataFrame:
    """Cells with a new diagonal: the larger of each bin's two neighbours in the first off-diagonal; the given one is dropped."""
    off = cells.where("bin1 <> bin2").select("chr", "bin1", "bin2", "contact")
    near = off.where("bin2 = bin1 + 1")
    both = near.select("chr", F.explode(F.array("bin1", "bin2")).alias("bin"), "contact")
    diagonal = both.groupBy("chr", "bin").agg(F.max("contact").alias("contact")).select("chr", F.col("bin").alias("bin1"), F.col("bin").alias("bin2"), "contact")
    return off.union(diagonal)


def lookup(pairs: DataFrame, cells: DataFrame, bin_a: str, bin_b: str, parts: int | None = None) -> DataFrame:
    """``pairs`` (chr and two bins) with ``contact``, 0 where there is no cell; a column of that name is replaced, others may have any name; in ``parts`` partitions, if given."""
    names = fresh(pairs, "c_", "b1_", "b2_", "found_")
    c = cells.select("chr", "bin1", "bin2", "contact").toDF(*names)
    chrom, low, high, found = map(F.col, names)
    if parts:
        pairs = dealt(pairs, parts, "chr", F.least(bin_a, bin_b), F.greatest(bin_a, bin_b))
    on = (F.col("chr") == chrom) & (F.least(bin_a, bin_b) == low) & (F.greatest(bin_a, bin_b) == high)
    return pairs.join(c, on, "left").select(*[F.col(f"`{x}`") for x in pairs.columns if x != "contact"], F.coalesce(found, F.lit(0.0)).alias("contact"))


def pseudocount(distance_bins: Column, bin_size: int, slope: Column, intercept: Column) -> Column:
    """Expected contact at a distance in bins, 0 without a fit."""
    return power_law_pseudocount(F.abs(distance_bins) * bin_size, slope, intercept)
