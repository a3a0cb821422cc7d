"""Genes, transcription starts and gene windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import strand_tss, window_around
from ..functions.stages import fresh


def five_prime_tss(genes: DataFrame) -> DataFrame:
    """One row a gene from annotation rows (ord, gene_id, gene_name, chr, strand, start, end).

    The first row, by ``ord``, gives name, chromosome and the start; later rows on the same
    chromosome replace the start if theirs lies further upstream on their strand.
    """
    tss = genes.withColumn("tss", strand_tss("strand", "start", "end"))
    first = tss.groupBy("gene_id").agg(F.min_by("gene_name", "ord").alias("gene_name"), F.min_by("chr", "ord").alias("chr"), F.min_by("strand", "ord").alias("strand"))
    here = tss.select(F.col("gene_id").alias("g"), F.col("chr").alias("c"), "strand", "tss", "ord").withColumnRenamed("strand", "st")
    same = first.join(here, (F.col("gene_id") == F.col("g")) & (F.col("chr") == F.col("c")))
    best = F.when(F.max_by("st", "ord") == "+", F.min("tss")).otherwise(F.max("tss"))
    return same.groupBy("gene_id", "gene_name", "chr", "strand").agg(best.alias("tss"))


def all_tss(transcripts: DataFrame) -> DataFrame:
    """(gene_id, gene_name, chr, tss) with every transcript's start in file order, repeated ones included.

    ``transcripts`` has ord, gene_id, gene_name, chr and tss; those on another chromosome than the gene's first are left out.
    """
    first = transcripts.groupBy("gene_id").agg(F.min_by("gene_name", "ord").alias("gene_name"), F.min_by("chr", "ord").alias("chr"))
    rows = transcripts.select(F.col("gene_id").alias("g"), F.col("chr").alias("c"), "ord", "tss")
    same = first.join(rows, (F.col("gene_id") == F.col("g")) & (F.col("chr") == F.col("c")))
    listed = same.groupBy("gene_id", "gene_name", "chr").agg(F.array_sort(F.collect_list(F.struct("ord", "tss"))).alias("t"))
    return listed.select("gene_id", "gene_name", "chr", F.transform("t", lambda x: x["tss"]).alias("tss"))


def gene_windows(genes: DataFrame, half: int) -> DataFrame:
    """Windows of ``half`` bases around a gene's start, or around the hull of its starts; with ``start`` and ``end``."""
    listed = dict(genes.dtypes)["tss"].startswith("array")
    low, high = (F.array_min("tss"), F.array_max("tss")) if listed else (F.col("tss"), F.col("tss"))
    start, end = window_around(low, high, half)
    return genes.withColumn("start", start).withColumn("end", end)


def promoter_windows(genes: DataFrame, half: int) -> DataFrame:
    """Distinct (chr, start, end) windows around the 5' starts."""
    return gene_windows(genes, half).select("chr", "start", "end").distinct()


def filter_genes(genes: DataFrame, keys: DataFrame) -> DataFrame:
    """Genes whose id or name is in ``keys`` (one column ``key``): two equi-joins instead of one with OR."""
    key, own = fresh(genes, "key_", "id_")
    k = keys.select(F.col("key").alias(key)).where(F.col(key).isNotNull()).distinct()
    by_id = genes.join(k, F.col("gene_id") == F.col(key), "left_semi").select("gene_id")
    by_name = genes.join(k, F.col("gene_name") == F.col(key), "left_semi").select("gene_id")
    ids = by_id.union(by_name).select(F.col("gene_id").alias(own)).distinct()
    return genes.join(ids, F.col("gene_id") == F.col(own), "left_semi")
