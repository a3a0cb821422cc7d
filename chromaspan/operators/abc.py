"""Activity-by-contact scores of region-gene pairs.

The score of a region for a gene is its activity times its contact, as a part of the gene's sum
over all regions. In the adapted form a region's activity is first dealt out over all its contacts,
summed over all genes; so gene filters may only be applied at the end. Genes may have several
starts: values are averaged over them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MEGABASE, bin_of, fractal_contact, midpoint_bin, tss_distance
from ..functions.stages import dealt, parts_for, written, written_small
from . import contacts as C
from .genes import filter_genes, gene_windows
from .intervals import overlap_join, paired_bytes
from .places import place_hits
from .sweep import sweep_join
from .tiles import ContactTiles, lookup_tiles


#: Fields of an interaction.
HIT_FIELDS = ["column", "chr", "start", "end", "gene_id", "gene_name", "peak_id", "signal", "contact", "activity", "scaled_contact", "intergenic_score", "tss_distance", "abc_score"]


@dataclass(frozen=True)
class AbcSettings:
    """Window sizes are half widths in bases. Without contacts, contact is estimated from the distance.

    Two switches repeat quirks of earlier programs: ``ordered_max`` scales the signals of the original
    form by a maximum that depends on the order of the regions, and ``unit_far_pseudocount`` adds 1
    beyond a megabase where a chromosome has no fit, or pseudocounts are off. ``sweep`` joins windows and
    regions by a sweep over slots of equal size instead of bins of ``join_width``.
    """

    gene_window: int = 2_500_000
    enhancer_window: int = 2_500_000
    bin_size: int = 5000
    cutoff: float = 0.02
    adapted: bool = True
    pseudocount: bool = True
    join_width: int | None = 100_000
    ordered_max: bool = False
    unit_far_pseudocount: bool = False
    sweep: bool = False


#: Bytes of a pair on its way, and of each of its starts.
_PAIR_BYTES, _START_BYTES = 300, 24


def pair_contacts(genes: DataFrame, peaks: DataFrame, settings: AbcSettings, contacts: DataFrame | ContactTiles | None = None) -> DataFrame:
    """(chr, gene_id, n_tss, tss_ord, peak_id, near, distance, contact) for every start and region of a gene's hull window.

    ``genes`` has gene_id, chr and tss (array); ``peaks`` has peak_id, chr, start, end. A region
    counts as near if it is within the gene window of the outermost starts; others add to the
    region's contacts with the first start only. ``contacts`` are cells or their tiles.
    """
    pairs, _ = _pair_rows(genes, peaks, settings, contacts)
    return _by_start(pairs, F.explode(F.arrays_zip("ords", "tss")).alias("x"), F.col("x.tss"), F.col("x.ords").alias("tss_ord"))


def _by_start(pairs: DataFrame, start: Column | None = None, tss: Column | None = None, *more: Column) -> DataFrame:
    """Rows of ``_pair_rows`` (or some of their fields) by start, with ``distance`` and ``contact``, without the arrays of starts."""
    keep = [c for c in pairs.columns if c not in ("tss", "ords", "contact")]
    rows = pairs.select(*[c for c in pairs.columns if c not in ("tss", "ords")], F.explode("tss").alias("x") if start is None else start)
    rows = rows.select("*", tss_distance("start", "end", F.col("x") if tss is None else tss).alias("distance"))
    return rows.select(*keep, *more, "distance", F.col("contact") if "contact" in rows.columns else fractal_contact("distance").alias("contact"))


def _starts(pairs: DataFrame) -> DataFrame:
    """Near rows with ``starts``, ``dist`` and ``contact``: as they are where those are known, else a row for each start."""
    return pairs if "starts" in pairs.columns else _by_start(pairs).withColumnRenamed("distance", "dist").withColumn("starts", F.lit(1))


def _pair_rows(genes: DataFrame, peaks: DataFrame, settings: AbcSettings, contacts: DataFrame | ContactTiles | None, placed: bool = False, summed: bool = False) -> tuple[DataFrame, float]:
    """(chr, gene_id, n_tss, peak_id, start, end, near, tss, ords[, contact]), and an upper bound of the bytes of all rows.

    With ``summed`` and measured contacts the number ``starts`` of a row's starts and the sum ``dist`` of their distances instead of tss and ords.

    With ``placed`` also ``place``, a number that one gene_id has in all its rows and that is near that of its neighbours.

    A gene's starts and their places stay arrays, so they multiply no rows until those are where
    they are summed. With measured contacts a pair has a row for each bin that its gene's starts lie
    in, since all starts of a bin have the same contact.
    """
    reach = max(settings.gene_window, settings.enhancer_window) if settings.adapted else settings.gene_window
    hull = gene_windows(genes.select("gene_id", "chr", "tss"), reach)
    # The outermost starts are fields, as the same few lines for each of their uses make a generated method that the JVM does not compile.
    hull = hull.withColumn("low", F.array_min("tss")).withColumn("high", F.array_max("tss"))
    if placed:
        place = F.pmod(F.hash("chr"), F.lit(1 << 20)) * (1 << 40) + F.col("low")
        hull = hull.withColumn("place", F.min(place).over(Window.partitionBy("gene_id")))
    hull = written(hull, "gene-windows")  # read by the join, by its bound and by what is known by chromosome
    regions = peaks.select("peak_id", "chr", "start", "end")
    size = paired_bytes(hull, regions, F.lit(_PAIR_BYTES) + F.size("tss") * _START_BYTES, settings.join_width)
    parts = parts_for(hull.sparkSession, size)
    measured_by_chr = contacts is not None
    tiled = isinstance(contacts, ContactTiles)
    b = settings.bin_size
    if measured_by_chr:
        if not tiled:
            contacts = written(contacts, "cells")  # read by the fit, the spans, the diagonal and the lookup
        # What is known by chromosome goes to the genes before the join, so that no join of pairs is by chromosome.
        hull = _with_chromosome_facts(hull, contacts, settings)
        own = lambda k: F.filter(F.transform("tss", lambda t, i: F.struct(i.alias("ord"), t.alias("t"))), lambda x: bin_of(x["t"], b).eqNullSafe(k))
        of_bin = lambda k, starts: F.struct(k.alias("bin"), F.transform(starts, lambda x: x["t"]).alias("tss"), F.transform(starts, lambda x: x["ord"]).alias("ords"))
        hull = hull.withColumn("by_bin", F.transform(F.array_distinct(F.transform("tss", lambda t: bin_of(t, b))), lambda k: of_bin(k, own(k))))
    pairs = sweep_join(hull, regions, parts=parts) if settings.sweep else overlap_join(hull, regions, "inner", settings.join_width, parts=parts)
    near = F.least(tss_distance("r_start", "r_end", "low"), tss_distance("r_start", "r_end", "high")) <= settings.gene_window
    first = F.slice("tss", 1, 1)
    pairs = pairs.select("chr", "gene_id", F.size("tss").alias("n_tss"), F.col("r_peak_id").alias("peak_id"), F.col("r_start").alias("start"), F.col("r_end").alias("end"), near.alias("near"), "tss", *(["place"] if placed else []), *([*_FACTS, "by_bin"] if measured_by_chr else []))
    if not measured_by_chr:
        ords = F.when(F.col("near"), F.sequence(F.lit(0), F.size("tss") - 1)).otherwise(F.array(F.lit(0)))
        return pairs.withColumn("ords", ords).withColumn("tss", F.when(F.col("near"), F.col("tss")).otherwise(first)), size
    one = F.array(F.struct(bin_of(F.get("tss", F.lit(0)), b).alias("bin"), first.alias("tss"), F.array(F.lit(0)).alias("ords")))
    rows = pairs.select(*[c for c in pairs.columns if c not in ("tss", "by_bin")], F.explode(F.when(F.col("near"), F.col("by_bin")).otherwise(one)).alias("x"))
    own = [F.col("x.tss"), F.col("x.ords")]
    if summed:
        total = F.aggregate("x.tss", F.lit(0).cast("long"), lambda sum_, t: sum_ + F.coalesce(tss_distance("start", "end", t), F.lit(0)).cast("long"))
        own = [F.size("x.tss").alias("starts"), total.alias("dist")]
    rows = rows.select(*[c for c in rows.columns if c != "x"], *own, F.col("x.bin").alias("gene_bin"), midpoint_bin("start", "end", b).alias("peak_bin"))
    # What the chromosome's facts say of a row is two fields of it, so that they are not moved with it.
    far = F.when(F.abs(F.col("gene_bin") - F.col("peak_bin")) * b > MEGABASE, F.lit(1.0)).otherwise(F.lit(0.0))
    expected = far if settings.unit_far_pseudocount else F.lit(0.0)
    if settings.pseudocount:
        fitted = C.pseudocount(F.col("gene_bin") - F.col("peak_bin"), b, F.col("slope"), F.col("intercept"))
        expected = F.when(F.col("slope").isNull(), far).otherwise(fitted) if settings.unit_far_pseudocount else fitted
    rows = rows.select(*[c for c in rows.columns if c not in _FACTS], expected.alias("expected"), (F.col("peak_bin") <= F.col("last_bin")).alias("inside"))
    found = lookup_tiles(rows, contacts, "gene_bin", "peak_bin", parts) if tiled else C.lookup(rows, C.with_diagonal(C.last_cells(contacts)), "gene_bin", "peak_bin", parts)
    # Regions beyond the last gene window's bin have the expected contact only.
    contact = F.when(F.col("inside"), F.col("contact")).otherwise(F.lit(0.0)) + F.col("expected")
    return found.withColumn("contact", contact).select(*[c for c in rows.columns if c not in ("gene_bin", "peak_bin", "expected", "inside")], "contact"), size


def _near_pairs(genes: DataFrame, peaks: DataFrame, settings: AbcSettings, contacts: DataFrame | ContactTiles | None, beside: DataFrame | None = None, placed: bool = False) -> tuple[DataFrame, float]:
    """Near rows of ``_pair_rows``; in the adapted form with ``contact_sum``, the region's over all its pairs, and the fields of ``beside``; and the bound of bytes.

    ``beside`` has a row for each region, with its peak_id as ``p_``.
    """
    pairs, size = _pair_rows(genes, peaks, settings, contacts, placed, summed=True)
    pairs = pairs.drop("ords")
    parts = parts_for(pairs.sparkSession, size)
    if not settings.adapted:
        near = pairs.where("near")
    elif contacts is not None:
        # Each region's total stands beside its pairs; near pairs are all that goes on.
        total = F.sum(F.col("contact") * F.col("starts")).over(Window.partitionBy("peak_id", "chr"))
        near = dealt(pairs, parts, "peak_id").withColumn("contact_sum", total).where("near")
        near = near if beside is None else near.join(beside, F.col("peak_id") == F.col("p_")).drop("p_")
    else:
        # Estimated contacts are much the same, and shares of them exact fractions: they are added one by one, so that how these round does not depend on sums of sums.
        each = _by_start(dealt(pairs.select("peak_id", "chr", "start", "end", "tss"), parts, "peak_id", "chr"))
        sums = each.groupBy(F.col("peak_id").alias("q_"), F.col("chr").alias("c_")).agg(F.sum("contact").alias("contact_sum"))
        sums = sums if beside is None else sums.join(beside, F.col("q_") == F.col("p_")).drop("p_")
        near = dealt(pairs.where("near"), parts, "peak_id", "chr").join(sums, (F.col("peak_id") == F.col("q_")) & (F.col("chr") == F.col("c_"))).drop("q_", "c_")
    return near.drop("near"), size


#: What ``_with_chromosome_facts`` adds to genes.
_FACTS = ["last_bin", "slope", "intercept"]


def _with_chromosome_facts(hull: DataFrame, contacts: DataFrame | ContactTiles, settings: AbcSettings) -> DataFrame:
    """Genes with their chromosome's last window bin and power law (null without a fit, or where it is not asked for)."""
    last = written_small(hull.groupBy(F.col("chr").alias("chr_")).agg(bin_of(F.max("end"), settings.bin_size).alias("last_bin")), "last-bins")
    hull = hull.join(last, F.col("chr") == F.col("chr_")).drop("chr_")
    if not settings.pseudocount:
        return hull.withColumn("slope", F.lit(None).cast("double")).withColumn("intercept", F.lit(None).cast("double"))
    fit = contacts.fit() if isinstance(contacts, ContactTiles) else C.power_law(contacts, settings.bin_size)
    fit = written_small(fit.withColumnRenamed("chr", "chr_"), "fit")
    return hull.join(fit, F.col("chr") == F.col("chr_"), "left").drop("chr_")


def peak_contact_sums(pairs: DataFrame) -> DataFrame:
    """(chr, peak_id, contact_sum) over all genes' starts."""
    return pairs.groupBy("chr", "peak_id").agg(F.sum("contact").alias("contact_sum"))


def _signal_max(settings: AbcSettings, gene) -> Column:
    """The largest signal of a gene's regions.

    With ``ordered_max``, a fold in the order of the regions: a region whose signals, summed over the
    gene's starts, exceed what is held puts its mean signal there, though that may be less.
    """
    if not settings.ordered_max:
        return F.max("signal").over(gene)
    inorder = gene.orderBy("start", "end", "peak_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = F.collect_list(F.struct("n_tss", "signal")).over(inorder)
    return F.aggregate(listed, F.lit(0.0), lambda held, x: F.when(x["n_tss"] * x["signal"] > held, x["signal"]).otherwise(held))


def score(genes: DataFrame, peaks: DataFrame, signals: DataFrame, settings: AbcSettings, contacts: DataFrame | ContactTiles | None = None, gene_keys: DataFrame | None = None) -> DataFrame:
    """Interactions that reach the cutoff, by activity column.

    ``signals`` is long (peak_id, column, signal). Columns: column, chr, start, end, gene_id,
    gene_name, peak_id, signal, contact, activity, scaled_contact, intergenic_score, tss_distance,
    abc_score. A region without any contact makes its gene's sum undefined; such genes have no rows.
    """
    # A region's signals are one array, and a gene's starts another, until its pairs are with their genes, where all the rest is done.
    s = signals.groupBy(F.col("peak_id").alias("p_")).agg(F.collect_list(F.struct("column", F.col("signal").cast("float").cast("double").alias("signal"))).alias("signals"))
    near, size = _near_pairs(genes, peaks, settings, contacts, s if settings.adapted else None)
    parts = parts_for(near.sparkSession, size)
    if not settings.adapted:
        near = written(near, "near-pairs")  # read by the chromosomes' largest contacts and by the scores
        top = written_small(_starts(near).groupBy(F.col("chr").alias("__c")).agg(F.max("contact").alias("chr_max")), "chromosome-maxima")
        near = dealt(near, parts, "peak_id").join(s, F.col("peak_id") == F.col("p_")).drop("p_")
    near = dealt(near, parts, "gene_id")
    rows = near.select("*", F.explode("signals").alias("s")).select(*[c for c in near.columns if c != "signals"], "s.column", "s.signal")
    part = F.col("signal") * F.try_divide("contact", "contact_sum") if settings.adapted else F.col("signal")
    times = F.col("starts")
    by_pair = _starts(rows).withColumn("a", part).groupBy("column", "chr", "gene_id", "peak_id", "start", "end", "n_tss", "signal").agg(
        F.sum(F.col("contact") * times).alias("c"), F.sum(F.col("a") * times).alias("act"), F.sum(F.col("a") * F.col("contact") * times).alias("ac"), F.sum("dist").alias("dist"), F.max(F.col("a").isNull()).alias("undefined")
    )
    gene = Window.partitionBy("column", "gene_id")
    total, highest = F.sum("ac").over(gene), F.max(F.col("c") / F.col("n_tss")).over(gene)
    by_pair = by_pair.select("*", total.alias("total"), highest.alias("c_max"), _signal_max(settings, gene).alias("s_max"), F.max("undefined").over(gene).alias("gene_undefined"))
    contact, activity = F.col("c") / F.col("n_tss"), F.col("act") / F.col("n_tss")
    scored = by_pair.where(~F.col("gene_undefined")).select(
        "column", "chr", "start", "end", "gene_id", "peak_id", "signal", contact.alias("contact"), activity.alias("mean_activity"),
        F.coalesce(F.try_divide(contact * 100.0, F.col("c_max")), F.lit(0.0)).alias("scaled_contact"),
        F.try_divide(F.col("signal") * 100.0, F.col("s_max")).alias("scaled_signal"),
        (F.col("dist") / F.col("n_tss")).alias("tss_distance"), F.try_divide("ac", "total").alias("abc_score"),
    )
    cutoff = F.lit(settings.cutoff).cast("float").cast("double")
    hits = scored.where((F.col("mean_activity") > 0) & F.col("abc_score").isNotNull() & ~F.isnan("abc_score") & (F.col("abc_score") >= cutoff))
    if settings.adapted:
        hits = hits.withColumn("activity", F.col("mean_activity")).withColumn("intergenic_score", F.col("mean_activity"))
    else:
        hits = hits.join(top, F.col("chr") == F.col("__c")).drop("__c")
        hits = hits.withColumn("activity", F.col("scaled_signal")).withColumn("intergenic_score", F.try_divide("contact", "chr_max") * F.col("signal"))
    names = genes if gene_keys is None else filter_genes(genes, gene_keys)
    names = names.select(F.col("gene_id").alias("__g"), "gene_name")
    return hits.join(names, F.col("gene_id") == F.col("__g")).select(*HIT_FIELDS)


def score_columns(genes: DataFrame, peaks: DataFrame, columns: list[str], settings: AbcSettings, contacts: DataFrame | ContactTiles | None = None, gene_keys: DataFrame | None = None) -> DataFrame:
    """``score`` for any number of activity columns, which are fields of ``peaks``; the same rows and columns.

    A region's activities stay one array. What depends on the pair alone (its contacts, and their
    shares of the region's) is summed over starts first; a pair's activities are multiples of the
    region's, so pairs are shuffled without them, in ranges of their genes' places, and a range gets
    each of its regions' arrays once (``places``). So as many rows are shuffled for five hundred
    columns as for one, and only interactions become rows by column. Null and NaN activities leave a
    gene without rows in that column.
    """
    if settings.ordered_max:
        raise ValueError("the ordered maximum is for single columns: use score")
    near, size = _near_pairs(genes, peaks, settings, contacts, placed=True)
    n, spark = len(columns), near.sparkSession
    share = F.try_divide("contact", "contact_sum") if settings.adapted else F.lit(1.0)
    rows, times = _starts(near if settings.adapted else dealt(near, parts_for(spark, size), "peak_id")), F.col("starts")
    by_pair = rows.withColumn("share", share).groupBy("chr", "place", "gene_id", "peak_id", "start", "end", "n_tss").agg(
        F.sum(F.col("contact") * times).alias("c"), F.sum(F.col("share") * times).alias("act"), F.sum(F.col("share") * F.col("contact") * times).alias("ac"), F.sum("dist").alias("dist"), F.max(F.col("share").isNull()).alias("undefined"), F.max("contact").alias("top")
    )
    by_pair = written(by_pair, "near-pairs")
    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("float").cast("double"), F.lit(float("nan"))) for c in columns])
    names = (genes if gene_keys is None else filter_genes(genes, gene_keys)).select("gene_id", "gene_name")
    # A range of places has no more regions than pairs, so their arrays are bounded with them.
    parts = parts_for(spark, size * (1 + 8 * n / _PAIR_BYTES)) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cutoff = struct.unpack("f", struct.pack("f", settings.cutoff))[0]
    found = place_hits(by_pair, peaks.select("peak_id", values.alias("signals")), names, n, cutoff, not settings.adapted, parts)
    if not settings.adapted:
        top = written_small(by_pair.groupBy(F.col("chr").alias("c_")).agg(F.max("top").alias("chr_max")), "chromosome-maxima")
        found = found.join(top, F.col("chr") == F.col("c_"))
    hits = found.withColumn("x", F.explode("hit")).drop("hit")
    named = F.get(F.array(*[F.lit(c) for c in columns]), F.col("x.i"))
    hits = hits.select("*", named.alias("column"), F.col("x.signal").alias("signal"), F.col("x.score").alias("abc_score"))
    if settings.adapted:
        hits = hits.withColumn("activity", F.col("signal") * F.col("share")).withColumn("intergenic_score", F.col("activity"))
    else:
        hits = hits.withColumn("activity", F.try_divide(F.col("signal") * 100.0, F.col("x.best"))).withColumn("intergenic_score", F.try_divide("contact", "chr_max") * F.col("signal"))
    return hits.select(*HIT_FIELDS)


def gene_info(hits: DataFrame, genes: DataFrame, columns: list[str], candidates: DataFrame, contact_chrs: DataFrame | None = None) -> DataFrame:
    """A row for each gene and column: number of enhancers and their mean activity, contact and distance, or the reason of none.

    ``candidates`` has the gene_ids with a region in their window, ``contact_chrs`` the chromosomes with contacts (None: all).
    """
    stats = hits.groupBy("column", "gene_id").agg(F.count("*").alias("n_enhancer"), F.avg("activity").alias("avg_activity"), F.avg("contact").alias("avg_contact"), F.avg("tss_distance").alias("avg_distance"))
    stats = stats.select(F.col("column").alias("__col"), F.col("gene_id").alias("__g"), "n_enhancer", "avg_activity", "avg_contact", "avg_distance")
    base = genes.withColumn("column", F.explode(F.array(*[F.lit(c) for c in columns])))
    joined = base.join(stats, (F.col("gene_id") == F.col("__g")) & (F.col("column") == F.col("__col")), "left")
    some = candidates.select(F.col("gene_id").alias("__cand")).distinct()
    joined = joined.join(some, F.col("gene_id") == F.col("__cand"), "left")
    if contact_chrs is None:
        joined = joined.withColumn("__chr", F.col("chr"))
    else:
        joined = joined.join(contact_chrs.select(F.col("chr").alias("__chr")).distinct(), F.col("chr") == F.col("__chr"), "left")
    failure = (
        F.when(F.col("n_enhancer").isNotNull(), F.lit("-"))
        .when(F.col("__chr").isNull(), F.lit("Missing normalized contact file"))
        .when(F.col("__cand").isNull(), F.lit("No candidate regions in gene window"))
        .otherwise(F.lit("Score of candidate regions too low"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    tss = F.array_join(F.transform("tss", lambda t: t.cast("string")), ",")
    return joined.select("column", "gene_id", "gene_name", "chr", tss.alias("tss"), F.coalesce("n_enhancer", F.lit(0)).alias("n_enhancer"), zero("avg_activity"), zero("avg_contact"), zero("avg_distance"), failure.alias("failure"))
