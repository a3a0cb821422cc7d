"""Regions of a genome by its index: only the bytes of the regions are read.

An index tells for each contig where its bases begin in the file and how long its lines are, so a
region is a range of bytes. Ranges are sorted by place and dealt out evenly; a task reads ranges
that lie close together in one piece. What is read follows the regions, not the genome.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strip_chr
from ..functions.stages import fresh

#: Ranges that are no further apart than this are read together, up to so many bytes at once.
GAP, AT_ONCE = 1 << 16, 4 << 20
INDEX = "file string, chr string, length long, offset long, line_bases long, line_bytes long"


def read_index(spark: SparkSession, genome: str, index: str | None = None) -> DataFrame:
    """INDEX rows of a sequence file from its index (by default, the file's name and ``.fai``): name, length, offset, bases and bytes of a line."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = spark.read.text(index or f"{genome}.fai").where(F.size(f) >= 5)
    return rows.select(F.lit(genome).alias("file"), strip_chr(at(0)).alias("chr"), *[at(i + 1).cast("long").alias(n) for i, n in enumerate(("length", "offset", "line_bases", "line_bytes"))])


def index_genome(spark: SparkSession, files: list[str]) -> DataFrame:
    """INDEX rows of sequence files without an index, each file streamed by one task.

    All lines of a contig but its last have one length, as an index needs; else it is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("file").to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_stream(place, compression=None, buffer_size=1 << 20) as source:
                    rows = list(_contigs(source, path))
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("chr", pa.string()), *[(n, pa.int64()) for n in ("length", "offset", "line_bases", "line_bytes")]]))

    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    return named.mapInArrow(run, INDEX).withColumn("chr", strip_chr("chr"))


def _lines(source) -> Iterator[bytes]:
    """Lines of a stream with their ends."""
    rest = b""
    while block := source.read(1 << 20):
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        for line in lines:
            yield line + b"\n"
    if rest:
        yield rest


def _contigs(source, path: str) -> Iterator[dict]:
    held, at, ended = None, 0, False
    for line in _lines(source):
        at += len(line)
        bases = len(line.rstrip(b"\r\n"))
        if line.startswith(b">"):
            if held:
                yield held
            held, ended = {"file": path, "chr": (line[1:].split() or [b""])[0].decode(), "length": 0, "offset": at, "line_bases": 0, "line_bytes": 0}, False
        elif held and bases:
            if ended or (held["line_bases"] and bases > held["line_bases"]):
                raise ValueError(f"lines of {held['chr']} in {path} differ in length")
            held["line_bases"], held["line_bytes"] = held["line_bases"] or bases, held["line_bytes"] or len(line)
            ended = bases < held["line_bases"]
            held["length"] += bases
        elif held:
            ended = True
    if held:
        yield held


def extract_indexed(regions: DataFrame, index: DataFrame) -> DataFrame:
    """(peak_id, chr, start, end, seq) of regions that lie within their contig, as ``sequence.extract``; others are left out.

    The files must be plain text that Arrow's file systems open; for others there is ``readers.read_genome``.
    """
    c, low, high = fresh(regions, "c_", "low_", "high_")
    known = index.withColumnRenamed("chr", c)
    joined = regions.select("peak_id", "chr", "start", "end").join(known, F.col("chr") == F.col(c)).where((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("length")))
    byte = lambda b: F.col("offset") + F.floor(b / F.greatest("line_bases", F.lit(1))).cast("long") * F.col("line_bytes") + b % F.greatest("line_bases", F.lit(1))
    ranges = joined.select("peak_id", "chr", "start", "end", "file", byte(F.col("start")).alias(low), F.when(F.col("end") > F.col("start"), byte(F.col("end") - 1) + 1).otherwise(byte(F.col("start"))).alias(high))
    dealt = ranges.repartitionByRange("file", low).sortWithinPartitions("file", low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name = source = None
        for batch in batches:
            files, lows, highs = (batch.column(n).to_pylist() for n in ("file", low, high))
            seqs, first = [], 0
            while first < len(files):
                if files[first] != name:
                    name = files[first]
                    system, place = fs.FileSystem.from_uri(name)
                    source = system.open_input_file(place)
                last, end = first + 1, highs[first]
                while last < len(files) and files[last] == name and lows[last] <= end + GAP and max(end, highs[last]) - lows[first] <= AT_ONCE:
                    end = max(end, highs[last])
                    last += 1
                data = source.read_at(end - lows[first], lows[first])
                for a, b in zip(lows[first:last], highs[first:last], strict=True):
                    seqs.append(data[a - lows[first] : b - lows[first]].translate(None, b"\r\n").decode())
                first = last
            yield pa.RecordBatch.from_arrays([*batch.select(["peak_id", "chr", "start", "end"]).columns, pa.array(seqs, pa.string())], ["peak_id", "chr", "start", "end", "seq"])

    schema = ", ".join(f"{n} {t}" for n, t in dealt.select("peak_id", "chr", "start", "end").dtypes)
    return dealt.mapInArrow(run, f"{schema}, seq string")
