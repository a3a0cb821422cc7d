"""Scalar building blocks; all of them are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The decay length of a region's weight, and the least distance and the reach of the contact models.
DECAY_LENGTH = 5000.0
LEAST_DISTANCE = 5000
MEGABASE = 1_000_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_chr(name: Column | str) -> Column:
    """A chromosome name without its ``chr`` prefix."""
    return F.regexp_replace(_c(name), "^chr", "")


def gtf_attribute(attributes: Column | str, key: str) -> Column:
    """The quoted value of one attribute, empty if it is missing."""
    return F.regexp_extract(_c(attributes), f'(?:^|[;\\s]){key} "([^"]*)"', 1)


def gene_symbol(name: Column | str, gene_id: Column | str) -> Column:
    """The gene's name, or its id where it has none."""
    return F.coalesce(F.nullif(_c(name), F.lit("")), _c(gene_id))


def strand_tss(strand: Column | str, start: Column | str, end: Column | str) -> Column:
    """Transcription start: the first base on the plus strand, else the last."""
    return F.when(_c(strand) == "+", _c(start)).otherwise(_c(end))


def peak_id(chrom: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(_c(chrom), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"))


def parse_peak_id(value: Column | str) -> list[Column]:
    """chr, start and end of a ``chr:start-end`` identifier."""
    pattern = r"^(?:chr)?(.+):(\d+)-(\d+)$"
    part = lambda i: F.regexp_extract(_c(value), pattern, i)
    return [part(1).alias("chr"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")]


def tss_distance(start: Column | str, end: Column | str, tss: Column | str) -> Column:
    """Distance of a half-open region to a 1-based position, 0 if the position is strictly inside."""
    s, e, t = _c(start), _c(end), _c(tss)
    inside = (F.least(s, e) < t) & (t < F.greatest(s, e))
    return F.when(inside, F.lit(0)).otherwise(F.least(F.abs(t - 1 - s), F.abs(t - e))).cast("long")


def window_around(tss_low: Column | str, tss_high: Column | str, half: int) -> tuple[Column, Column]:
    """Half-open window of ``half`` bases to both sides of a 1-based position or hull, not below 0."""
    return F.greatest(F.lit(0), _c(tss_low) - half - 1).cast("long"), (_c(tss_high) + half).cast("long")


def distance_decay(distance: Column | str) -> Column:
    return F.exp(-_c(distance) / DECAY_LENGTH)


def fractal_contact(distance: Column | str) -> Column:
    """Contact estimated from the distance alone, for runs without contact data."""
    return 1.0 / F.greatest(_c(distance), F.lit(LEAST_DISTANCE))


def bin_of(position: Column | str, size: int) -> Column:
    """Index of the bin a non-negative position falls into."""
    return F.floor(_c(position) / size).cast("long")


def midpoint_bin(start: Column | str, end: Column | str, size: int) -> Column:
    return bin_of(F.floor((_c(start) + _c(end)) / 2), size)


def power_law_pseudocount(bin_distance: Column, slope: Column, intercept: Column) -> Column:
    """Expected contact by the chromosome's power law: constant up to a megabase, then by distance."""
    at = lambda d: F.exp(slope * F.log(d) + intercept)
    far = F.when(bin_distance > MEGABASE, at(bin_distance.cast("double"))).otherwise(at(F.lit(float(MEGABASE))))
    return F.coalesce(far, F.lit(0.0))


def clean_bases(sequence: Column | str) -> Column:
    """Upper case, and N for everything but A, C, G and T."""
    return F.regexp_replace(F.upper(_c(sequence)), "[^ACGT]", "N")


def reverse_complement(sequence: Column | str) -> Column:
    return F.reverse(F.translate(_c(sequence), "ACGT", "TGCA"))


def significant(value: Column | str, digits: int) -> Column:
    """A double rounded to so many significant digits, as text interchange would leave it."""
    return F.format_string(f"%.{digits - 1}e", _c(value).cast("double")).cast("double")


def significant_text(value: Column | str, digits: int) -> Column:
    """A double as text with so many significant digits and no trailing zeros, with an exponent if it is under 1e-4 or has more digits."""
    x = significant(value, digits)
    no_zeros = lambda t: F.regexp_replace(t, r"\.?0+$", "")
    plain = x.cast("decimal(38,14)").cast("string")
    parts = F.split(F.format_string(f"%.{digits - 1}e", x), "e")
    short = (F.abs(x) >= 1e-4) & (F.abs(x) < 10.0**digits)
    return F.when(x == 0, F.lit("0")).when(F.isnan(x), F.lit("nan")).when(short, no_zeros(plain)).otherwise(F.concat(F.regexp_replace(parts[0], r"\.?0+$", ""), F.lit("e"), parts[1]))


def as_flag(value: str | bool | None, default: bool) -> bool:
    """Booleans as command lines spell them; anything unknown is the default."""
    if isinstance(value, bool):
        return value
    if value in ("True", "TRUE", "true", "T", "1"):
        return True
    if value in ("False", "FALSE", "false", "F", "0"):
        return False
    return default
