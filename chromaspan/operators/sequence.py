"""Region sequences: a genome in chunks, regions cut from it, cleaned, and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_bases

CHUNK = 1 << 16


def _pieces(seq: Column, size: int) -> Column:
    """A string cut into pieces of ``size``, in one pass over it."""
    return F.when(F.length(seq) > size, F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).otherwise(F.array(seq))


def chunk_genome(genome: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chr, chunk, length, part): contigs (chr, seq), each held by one row, in pieces of ``size`` bases. For whole chromosomes see ``chunk_lines``."""
    cut = genome.where(F.length("seq") > 0).select("chr", F.length("seq").cast("long").alias("length"), F.posexplode(_pieces(F.col("seq"), size)).alias("chunk", "part"))
    return cut.select("chr", F.col("chunk").cast("long").alias("chunk"), "length", "part")


def chunk_lines(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chr, chunk, length, part) from lines (file, block, i, head, value) of sequence files; no row holds more than a line or a chunk.

    ``block`` and ``i`` order the lines of a file, ``head`` is a contig's name on the line that
    begins it and null on others. Lines are numbered by running lengths within their block, and a
    table with a row for each contig in each block carries names and lengths over to later blocks.
    Contigs have names of their own; lines before the first name are left out.
    """
    here = ["file", "block"]
    ordered = Window.partitionBy(*here).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("seg", F.count("head").over(ordered)).withColumn("n", F.when(F.col("head").isNull(), F.length("value")).otherwise(0).cast("long"))
    segs = rows.groupBy(*here, "seg").agg(F.sum("n").alias("n"), F.max("head").alias("name"))
    blocks = segs.groupBy(*here).agg(F.max("seg").alias("heads"), F.max_by("n", "seg").alias("tail"), F.max_by("name", "seg").alias("last"))
    by_file = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("run", F.sum(F.when(F.col("heads") > 0, 1).otherwise(0)).over(by_file))
    in_run = Window.partitionBy("file", "run").orderBy("block")
    blocks = blocks.withColumn("held", F.sum("tail").over(in_run)).withColumn("open", F.first("last").over(in_run))
    blocks = blocks.select(*[F.col(c).alias(f"b_{c}") for c in here], F.coalesce(F.lag("held").over(by_file), F.lit(0)).alias("carry"), F.lag("open").over(by_file).alias("before"))
    within = Window.partitionBy(*here, "seg").orderBy("i")
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("name", F.max("head").over(Window.partitionBy(*here, "seg")))
    rows = rows.where("n > 0").join(blocks, (F.col("file") == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    first = F.col("seg") == 0
    placed = rows.select(F.when(first, F.col("before")).otherwise(F.col("name")).alias("chr"), (F.col("at") + F.when(first, F.col("carry")).otherwise(0)).alias("at"), "value").where("chr IS NOT NULL")
    cut = placed.select("chr", "at", F.posexplode(_pieces(F.col("value"), size)).alias("k", "p")).select("chr", (F.col("at") + F.col("k") * size).alias("at"), "p")
    low, high = F.floor(F.col("at") / size), F.floor((F.col("at") + F.length("p") - 1) / size)
    parts = cut.select("chr", "at", "p", F.explode(F.array_distinct(F.array(low, high))).alias("chunk"))
    start = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0)).cast("int")
    stop = F.least((F.col("chunk") + 1) * size - F.col("at"), F.length("p")).cast("int")
    parts = parts.select("chr", "chunk", "at", F.substring("p", start + 1, stop - start).alias("p"))
    chunks = parts.groupBy("chr", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("ps"))
    chunks = chunks.select("chr", "chunk", F.array_join(F.transform("ps", lambda x: x["p"]), "").alias("part"))
    lengths = cut.groupBy(F.col("chr").alias("c")).agg(F.max(F.col("at") + F.length("p")).alias("length"))
    return chunks.join(lengths, F.col("chr") == F.col("c")).select("chr", "chunk", "length", "part")


def extract(regions: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(peak_id, chr, start, end, seq) of regions that lie within their contig; others are left out.

    ``chunks`` has pieces of the same size. A region is joined to the chunks it touches by an
    equi-join, and its parts are put together in order.
    """
    touched = regions.select("peak_id", "chr", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size).cast("long"), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / size).cast("long"))).alias("chunk"))
    c = chunks.select(F.col("chr").alias("__c"), F.col("chunk").alias("__k"), "length", "part")
    rows = touched.join(c, (F.col("chr") == F.col("__c")) & (F.col("chunk") == F.col("__k"))).where(F.col("end") <= F.col("length"))
    low = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0))
    high = F.least(F.col("end") - F.col("chunk") * size, F.lit(size))
    piece = F.substring(F.col("part"), (low + 1).cast("int"), (high - low).cast("int"))
    parts = rows.groupBy("peak_id", "chr", "start", "end").agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))).alias("ps"))
    return parts.select("peak_id", "chr", "start", "end", F.array_join(F.transform("ps", lambda x: x["p"]), "").alias("seq"))


def clean(sequences: DataFrame) -> DataFrame:
    """``sequences`` with ``seq`` in upper case and N for unknown bases."""
    return sequences.withColumn("seq", clean_bases("seq"))


def statistics(sequences: DataFrame) -> DataFrame:
    """One row (max_len, gc): longest sequence, and the part of C and G in all known bases."""
    bases = lambda keep: F.sum(F.length(F.regexp_replace("seq", f"[^{keep}]", "")))
    return sequences.agg(F.max(F.length("seq")).cast("long").alias("max_len"), F.try_divide(bases("CG").cast("double"), bases("ACGT")).alias("gc"))
