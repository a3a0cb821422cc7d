"""Text sources as DataFrames; gzip is transparent, and malformed lines are left out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import gene_symbol, gtf_attribute, peak_id, strand_tss, strip_chr
from ..operators.sequence import CHUNK, chunk_lines
from ..operators.signals import column_name, parse_columns


def read_gtf(spark: SparkSession, path: str, feature: str = "gene") -> DataFrame:
    """(ord, gene_id, gene_name, chr, strand, start, end, tss) of the rows of a feature, ``gene`` or ``transcript``.

    ``ord`` follows the lines: files by name, blocks of a file by place, and within a block the scan.
    """
    lines = spark.read.text(path).select("value", file_order().alias("ord")).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    rows = lines.where((F.size(f) >= 9) & (F.get(f, F.lit(2)) == feature)).select("ord", f.alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    gene_id = gtf_attribute(at(8), "gene_id")
    start, end = at(3).cast("long"), at(4).cast("long")
    return rows.select("ord", gene_id.alias("gene_id"), gene_symbol(gtf_attribute(at(8), "gene_name"), gene_id).alias("gene_name"), strip_chr(at(0)).alias("chr"), at(6).alias("strand"), start.alias("start"), end.alias("end"), strand_tss(at(6), start, end).alias("tss"))


def file_order() -> Column:
    """The place of a line in a folder, as a struct that sorts: splits of a scan are packed by size, so the order of partitions is not that of files."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("i"))


def _rank(place: str) -> Column:
    """0, 1, ... in the order of ``place``; for motifs, of which there are some thousand."""
    return (F.row_number().over(Window.orderBy(place)) - 1).cast("long")


def read_bed(spark: SparkSession, path: str, columns: str = "0") -> tuple[DataFrame, dict[str, str]]:
    """Regions (peak_id, chr, start, end, signal fields) and the output suffix of each signal field.

    ``columns`` is a selection as in ``parse_columns``. A first line with # gives the names. Whole
    lines that repeat are taken once. Lines with the same place but other signals would multiply rows
    in every join on the region, so such a file is refused.
    """
    head = spark.read.text(path).limit(1).collect()
    header = head[0][0].lstrip("# ").split("\t") if head and head[0][0].startswith("#") else []
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).distinct()
    first = lines.limit(1).collect()
    width = len(first[0][0].split("\t")) if first else 3
    numbers = parse_columns(columns, width)
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    chrom, start, end = strip_chr(at(0)), at(1).cast("long"), at(2).cast("long")
    names = {f"c{n}": column_name(header[n - 1] if n <= len(header) else None, n) for n in numbers}
    regions = lines.select(peak_id(chrom, start, end).alias("peak_id"), chrom.alias("chr"), start.alias("start"), end.alias("end"), *[at(n - 1).cast("double").alias(f"c{n}") for n in numbers])
    if numbers:
        twice = regions.groupBy("peak_id").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"region {twice[0]['peak_id']} has several lines with different signals")
    else:
        regions = regions.dropDuplicates(["peak_id"])
    return regions, names


def read_fasta(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(chr, seq): one row a record of a file of short sequences, line breaks taken out; names end at the first blank. Sequences under ``least`` are left out."""
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    name = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    return records.select(strip_chr(name).alias("chr"), body.alias("seq")).where(F.length("seq") >= least)


def read_genome(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(chr, chunk, length, part): the contigs of sequence files in chunks, read line by line and in parallel."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.btrim("value", F.lit(" \t\r")).alias("value"))
    head = F.when(F.col("value").startswith(">"), strip_chr(F.regexp_extract("value", r"^>\s*(\S+)", 1)))
    return chunk_lines(text.where(~F.col("value").startswith("#")).withColumn("head", head), size)


def read_transfac(spark: SparkSession, path: str) -> DataFrame:
    """Count matrices (motif_ord, ac, name, pos, a, c, g, t) of a TRANSFAC file, records end with //."""
    records = spark.read.option("lineSep", "//").text(path).select("value", file_order().alias("place")).where(F.col("value").rlike(r"(?m)^\s*P[0O]\s")).withColumn("motif_ord", _rank("place"))
    field = lambda tag: F.regexp_extract("value", rf"(?m)^\s*{tag}\s+(\S+)", 1)
    body = F.regexp_extract("value", r"(?s)(?:^|\n)\s*P[0O]\s[^\n]*\n(.*?)(?:\n\s*XX|$)", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*[0-9]+(\s+[-+0-9.eE]+){4}"))
    rows = records.select("motif_ord", field("AC").alias("ac"), field("ID").alias("name"), F.posexplode(lines).alias("pos", "line"))
    n = F.split(F.trim("line"), r"\s+")
    return rows.select("motif_ord", "ac", "name", "pos", *[F.get(n, F.lit(i + 1)).cast("double").alias(b) for i, b in enumerate("acgt")])


def read_energy_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(motif_ord, ac, name, lnr0, length, energy) of a file of energy matrices, whose records start with >."""
    records = spark.read.option("lineSep", ">").text(path).select("value", file_order().alias("place")).where(F.col("value").rlike("lnR0:")).withColumn("motif_ord", _rank("place"))
    head = F.split(F.get(F.split("value", "\n"), F.lit(0)), r"\s+")
    lnr0 = F.regexp_extract("value", r"lnR0:\s*(\S+)", 1).cast("double")
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^\s*[-+0-9.]") & ~x.contains("lnR0:"))
    energy = F.transform(lines, lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast("double")))
    return records.select("motif_ord", F.get(head, F.lit(0)).alias("ac"), F.get(head, F.lit(1)).alias("name"), lnr0.alias("lnr0"), F.size(energy).alias("length"), energy.alias("energy"))


def read_contacts(spark: SparkSession, folder: str, chromosomes: list[str] | None = None) -> DataFrame:
    """(chr, pos1, pos2, contact, ord) of a folder of gzipped per-chromosome files; ``ord`` is the order of the lines.

    Of two files for one chromosome the last by name counts, among those whose first line begins
    with a digit: others are not readable as contacts. With ``chromosomes``, files of others are not
    opened: the condition is on the file's name alone, so Spark leaves them out of the scan.
    """
    text = spark.read.text(folder, pathGlobFilter="*[cC]hr*gz")
    chrom = F.regexp_extract(F.col("_metadata.file_name"), r"[cC]hr([0-9]+|[A-Za-z]+)[^0-9].*gz$", 1)
    text = text.where(chrom != "") if chromosomes is None else text.where(chrom.isin([c for c in chromosomes if c]))
    rows = text.select(chrom.alias("chr"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("ord"), "value")
    files = rows.groupBy("chr", "path").agg(F.min_by("value", "ord").alias("first")).where(F.col("first").rlike("^[0-9]"))
    last = files.groupBy(F.col("chr").alias("__c")).agg(F.max("path").alias("__p"))
    rows = rows.join(last, (F.col("chr") == F.col("__c")) & (F.col("path") == F.col("__p"))).select("chr", "ord", F.split("value", "\t").alias("f"))
    at = lambda i, t: F.get("f", F.lit(i)).try_cast(t)
    return rows.select("chr", at(0, "long").alias("pos1"), at(1, "long").alias("pos2"), at(2, "float").cast("double").alias("contact"), "ord").where("pos1 IS NOT NULL AND pos2 IS NOT NULL")


def interaction_files(path: str, names: dict[str, str]) -> dict[str, str]:
    """The file of each activity column (``names``: column and its suffix), from that of any of them.

    One column takes the path as it is. Files may be named by number (``_c4.txt.gz``) or by header
    (``_red.txt.gz``); a path with neither has the suffix put before its ending.
    """
    end = ".txt.gz"
    if len(names) == 1:
        return dict.fromkeys(names, path)
    stem = re.sub(r"_c[0-9]+\.txt\.gz$", "", path)
    if stem != path:
        return {c: f"{stem}_{c}{end}" for c in names}
    stem = next((path.removesuffix(suffix + end) for suffix in names.values() if path.endswith(suffix + end)), path.removesuffix(end))
    return {c: stem + suffix + end for c, suffix in names.items()}


def read_interactions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(column, gene_id, peak_id, intergenic_score) from scored interaction files, one for each activity column."""
    parts = []
    for column, path in paths.items():
        df = spark.read.option("sep", "\t").option("header", True).csv(path)
        df = df.toDF(*[c.replace("#", "") for c in df.columns])
        parts.append(df.select(F.lit(column).alias("column"), F.col("Ensembl ID").alias("gene_id"), strip_chr("PeakID").alias("peak_id"), F.col("intergenicScore").cast("double").alias("intergenic_score")))
    return reduce(DataFrame.unionByName, parts)


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(key): gene ids or names, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("key")).where("key <> ''").distinct()
