"""Genes, regions, contacts, sequences and motifs derived from the driver's tables.

``*_CTE`` are the same views in DuckDB SQL.
"""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import peak_id, strand_tss
from ..functions.stages import shared_folder
from ..sinks import store

BIN = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, chrom = F.col("p_partkey") * 37, (F.col("p_partkey") % 5).cast("string")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), chrom.alias("chr"), start.alias("start"), (start + F.col("p_size") * 10).alias("end"), F.col("p_size").cast("double").alias("sig1"), F.col("p_retailprice").alias("sig2"))
    return p.withColumn("peak_id", peak_id("chr", "start", "end"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("c_custkey") * 49 + 1
    g = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("gene_id"), F.col("c_mktsegment").alias("gene_name"), (F.col("c_custkey") % 5).cast("string").alias("chr"),
        F.when(F.col("c_nationkey") % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start"), (start + F.col("c_nationkey") * 20).alias("end"),
    )
    return g.withColumn("tss", strand_tss("strand", "start", "end"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("ord"), F.col("c_name").alias("gene_id"), F.col("c_mktsegment").alias("gene_name"), (F.col("o_custkey") % 5).cast("string").alias("chr"), (F.col("o_custkey") * 49 + 1 + (F.col("o_orderkey") % 7) * 200).alias("tss")
    )


def raw_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos1 = F.floor(F.col("l_partkey") * 37 / BIN) * BIN
    return read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5).cast("string").alias("chr"), pos1.alias("pos1"), (pos1 + (F.col("l_suppkey") % 30) * BIN).alias("pos2"), F.col("l_quantity").alias("contact")).groupBy("chr", "pos1", "pos2").agg(F.sum("contact").alias("contact"))


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("s_suppkey") * 701
    return read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).cast("string").alias("chr"), start.alias("start"), (start + 60).alias("end"))


def _bases(text: str) -> Column:
    """A text's ASCII letters, upper-cased, dealt out to the four bases."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.translate(letters, "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sequences: whole documents."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chr"), _bases("text").alias("seq"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region sequences: whole turns of conversations."""
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 8 + F.col("turn")).cast("string").alias("peak_id"), _bases("text").alias("seq"))


def masked_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region sequences with unknown bases: the letters J, Q, X and Z are N."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    seq = F.translate(letters, "BDEFHIKLMNOPRSUVWYJQXZ", "ACGTACGTACGTACGTACNNNN")
    return read(spark, sf_dir, "conversations").select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("peak_id"), seq.alias("seq"))


def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count matrices: every embedding, 16 positions of 4 bases."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("motif_ord"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"))
    at = lambda b: F.floor(F.abs(F.get("embedding", F.col("pos") * 4 + b).cast("double")) * 10).cast("double")
    name = F.concat(F.lit("TF"), F.col("motif_ord").cast("string"))
    return rows.select("motif_ord", name.alias("ac"), name.alias("name"), "pos", at(0).alias("a"), at(1).alias("c"), at(2).alias("g"), at(3).alias("t"))


def motif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy rows: a motif of 16 positions for each region of the sales tables."""
    k, p = F.col("motif_ord"), F.col("pos")
    rows = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("motif_ord"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"))
    name = F.concat(F.lit("TF"), k.cast("string"))
    at = lambda x, m: (x % m) * 0.06
    return rows.select("motif_ord", name.alias("ac"), name.alias("name"), "pos", at((k + 1) * (7 * p + 3), 11).alias("a"), at((k + 2) * (5 * p + 1), 13).alias("c"), at((k + 3) * (3 * p + 2), 7).alias("g"), at((k + 1) * (2 * p + 5), 9).alias("t"))


def text_folder(lines: DataFrame, label: str) -> str:
    """Lines (value) written as text to a fresh folder, which is given."""
    path = shared_folder(lines.sparkSession, label)
    lines.select("value").write.text(path)
    return path


def gtf_file(spark: SparkSession, sf_dir: str) -> str:
    """Genes and transcripts as annotation lines."""
    field = lambda *x: F.concat_ws("\t", *[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    attr = F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('"; gene_name "'), F.col("gene_name"), F.lit('";'))
    chrom = F.concat(F.lit("chr"), F.col("chr"))
    g = genes(spark, sf_dir).select(field(chrom, "x", "gene", F.col("start"), F.col("end"), ".", F.col("strand"), ".", attr).alias("value"))
    t = transcripts(spark, sf_dir).select(field(chrom, "x", "transcript", F.col("tss"), F.col("tss") + 10, ".", "+", ".", attr).alias("value"))
    return text_folder(g.union(t).union(spark.createDataFrame([("# made of tables",), ("too\tshort",)], "value string")), "annotation")


def bed_file(spark: SparkSession, sf_dir: str) -> str:
    """Regions with two signals below a header."""
    head = spark.createDataFrame([("# chr\tstart\tend\tsig one\tprice",)], "value string")
    rows = peaks(spark, sf_dir).select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chr")), F.col("start").cast("string"), F.col("end").cast("string"), F.col("sig1").cast("string"), F.col("sig2").cast("string")).alias("value"))
    return text_folder(head.union(rows).coalesce(1), "regions")  # the header is the first line of one file


def transfac_file(spark: SparkSession, sf_dir: str) -> str:
    """Count matrices as records."""
    line = F.concat_ws(" ", F.lpad((F.col("pos") + 1).cast("string"), 2, "0"), *[F.col(b).cast("long").cast("string") for b in "acgt"])
    m = count_rows(spark, sf_dir).groupBy("motif_ord", "ac", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("rows"))
    return text_folder(m.select(F.concat(F.lit("AC "), F.col("ac"), F.lit("\nID "), F.col("name"), F.lit("\nP0 A C G T\n"), F.col("rows"), F.lit("\nXX\n//")).alias("value")), "count-matrices")


def contact_folder(spark: SparkSession, sf_dir: str) -> str:
    """A gzipped file a chromosome. Each cell stands twice, the later line is right; files that are to be passed over stand beside."""
    raw = raw_contacts(spark, sf_dir)
    twice = raw.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    line = F.concat_ws("\t", F.col("pos1").cast("string"), F.col("pos2").cast("string"), (F.col("contact") + 5 * (1 - F.col("turn"))).cast("string"))
    folder = shared_folder(spark, "contacts")
    twice.repartition("chr").sortWithinPartitions("chr", "turn", "pos1", "pos2").select("chr", line.alias("value")).write.option("compression", "gzip").partitionBy("chr").text(folder + "-parts")
    system, place = store.located(folder)
    system.create_dir(place, recursive=True)
    for part in (n for n in store.names(folder + "-parts") if n.startswith("chr=")):  # one file for each chromosome
        chrom = part.removeprefix("chr=")
        for name in (n for n in store.names(f"{folder}-parts/{part}") if n.endswith(".gz") and not n.startswith(".")):
            store.move(f"{folder}-parts/{part}/{name}", f"{folder}/chr{chrom}_b.gz")
            store.write_bytes(f"{folder}/chr{chrom}_a.gz", gzip.compress(b"0\t0\t77\n"))
            store.write_bytes(f"{folder}/chr{chrom}_c.gz", gzip.compress(b"not readable\n0\t0\t99\n"))
    return folder


def genome_file(spark: SparkSession, sf_dir: str) -> str:
    """Contigs in lines of 60."""
    wrapped = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    return text_folder(contigs(spark, sf_dir).select(F.concat(F.lit(">chr"), F.col("chr"), F.lit(" made of a text\n"), wrapped).alias("value")), "genome")


PEAKS_CTE = """peaks AS (SELECT *, chr || ':' || s || '-' || e AS peak_id FROM (SELECT p_partkey AS ord, CAST(p_partkey % 5 AS VARCHAR) AS chr, p_partkey * 37 AS s, p_partkey * 37 + p_size * 10 AS e, CAST(p_size AS DOUBLE) AS sig1, p_retailprice AS sig2 FROM part))"""
GENES_CTE = """genes AS (SELECT *, CASE WHEN strand = '+' THEN s ELSE e END AS tss FROM (SELECT c_custkey AS ord, c_name AS gene_id, c_mktsegment AS gene_name, CAST(c_custkey % 5 AS VARCHAR) AS chr, CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand, c_custkey * 49 + 1 AS s, c_custkey * 49 + 1 + c_nationkey * 20 AS e FROM customer))"""
TRANSCRIPTS_CTE = """transcripts AS (SELECT o_orderkey AS ord, c_name AS gene_id, c_mktsegment AS gene_name, CAST(o_custkey % 5 AS VARCHAR) AS chr, o_custkey * 49 + 1 + (o_orderkey % 7) * 200 AS tss FROM orders JOIN customer ON o_custkey = c_custkey)"""
CELLS_CTE = """cells AS (SELECT CAST(l_partkey % 5 AS VARCHAR) AS chr, CAST(floor(l_partkey * 37 / 1000) AS BIGINT) AS bin1, CAST(floor(l_partkey * 37 / 1000) AS BIGINT) + l_suppkey % 30 AS bin2, sum(l_quantity) AS contact FROM lineitem GROUP BY ALL)"""
EXCLUDED_CTE = """excluded AS (SELECT CAST(s_suppkey % 5 AS VARCHAR) AS chr, s_suppkey * 701 AS s, s_suppkey * 701 + 60 AS e FROM supplier)"""
CONTIGS_CTE = """contigs AS (SELECT CAST(doc_id AS VARCHAR) AS chr, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS seq FROM documents)"""
SEQUENCES_CTE = """seqs AS (SELECT CAST(conv_id * 8 + turn AS VARCHAR) AS peak_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS seq FROM conversations)"""
MASKED_CTE = """seqs AS (SELECT conv_id || '.' || turn AS peak_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIKLMNOPRSUVWYJQXZ', 'ACGTACGTACGTACGTACNNNN') AS seq FROM conversations)"""
COUNTS_CTE = """crows AS (SELECT vec_id AS motif_ord, 'TF' || vec_id AS name, p AS pos, floor(abs(CAST(embedding[4 * p + 1] AS DOUBLE)) * 10) AS a, floor(abs(CAST(embedding[4 * p + 2] AS DOUBLE)) * 10) AS c, floor(abs(CAST(embedding[4 * p + 3] AS DOUBLE)) * 10) AS g, floor(abs(CAST(embedding[4 * p + 4] AS DOUBLE)) * 10) AS t FROM embeddings, range(16) r(p))"""
MOTIFS_CTE = """mrows AS (SELECT CAST(r_regionkey AS BIGINT) AS motif_ord, 'TF' || r_regionkey AS name, p AS pos, CAST(((r_regionkey + 1) * (7 * p + 3)) % 11 AS DOUBLE) * 0.06 AS a, CAST(((r_regionkey + 2) * (5 * p + 1)) % 13 AS DOUBLE) * 0.06 AS c, CAST(((r_regionkey + 3) * (3 * p + 2)) % 7 AS DOUBLE) * 0.06 AS g, CAST(((r_regionkey + 1) * (2 * p + 5)) % 9 AS DOUBLE) * 0.06 AS t FROM region, range(16) r(p))"""
