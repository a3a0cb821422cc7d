"""Outputs of a run. Every writer refuses an existing target."""

from __future__ import annotations

import gzip
import math
import struct
import uuid
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import significant_text
from ..functions.stages import bounded, written
from ..operators.matrix import wide_vectors
from . import store

#: Field names of the published tables.
INTERACTION_FIELDS = {
    "chr": "#chr", "start": "start", "end": "end", "gene_id": "Ensembl ID", "gene_name": "Gene Name", "peak_id": "PeakID", "signal": "signalValue", "contact": "Contact",
    "activity": "adaptedActivity", "scaled_contact": "scaledContact", "intergenic_score": "intergenicScore", "tss_distance": "TSS-dist", "abc_score": "ABC-Score",
}
GENE_INFO_FIELDS = {
    "gene_id": "Ensembl ID", "gene_name": "Gene Name", "chr": "chr", "tss": "TSS", "n_enhancer": "#Enhancer", "avg_activity": "Avg_EnhancerActivity",
    "avg_contact": "Avg_EnhancerContact", "avg_distance": "Avg_EnhancerDistance", "failure": "Failure",
}


#: Names and digits of the published files, and the numbers of the check of the byte order.
INTERACTIONS, GENE_INFO, GENE_TF, DISCARDED, BED = "ABCpp_scoredInteractions", "GeneInfo", "TF_Gene_Affinities", "discarded_Genes", "PromoterWindows"
INTERACTION_DIGITS, GENE_INFO_DIGITS, GENE_TF_DECIMALS = 8, 6, 10
ORDER_CHECK = [0.25, -0.75, 128.5, -8.5]


#: Genes of one member of the binary matrix, and what is kept of members.
MEMBER_GENES = 256
#: Members that are told of at once, bytes of neighbouring members that are read at once, values that one task reads.
TOLD_MEMBERS, SPAN_BYTES, TASK_VALUES = 1000, 1 << 20, 1 << 20
MEMBERS = "name string, place long, bytes long, genes array<long>, n long"
_MEMBER = pa.schema([("name", pa.string()), ("place", pa.int64()), ("bytes", pa.int64()), ("genes", pa.list_(pa.int64())), ("n", pa.int64())])


def write_tsv(df: DataFrame, path: str, fields: dict[str, str] | None = None, partition: str | None = None) -> None:
    """Gzipped tab-separated parts with a header, one folder by value of ``partition`` if given."""
    if fields:
        df = df.select(*([partition] if partition else []), *[F.col(c).alias(name) for c, name in fields.items()])
    writer = df.write.mode("errorifexists").option("sep", "\t").option("header", True).option("compression", "gzip").option("emptyValue", "")
    (writer.partitionBy(partition) if partition else writer).csv(path)


def _digits(df: DataFrame, digits: int) -> DataFrame:
    """Doubles of a table with so many significant digits, as text."""
    return df.select(*[significant_text(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def write_interactions(hits: DataFrame, path: str, adapted: bool = True) -> None:
    """Scored interactions with eight significant digits, one folder a column."""
    write_tsv(_digits(hits, INTERACTION_DIGITS), path, INTERACTION_FIELDS if adapted else INTERACTION_FIELDS | {"activity": "scaledActivity"}, "column")


def write_gene_info(info: DataFrame, path: str) -> None:
    """Summaries of genes with six significant digits, one folder a column."""
    write_tsv(_digits(info, GENE_INFO_DIGITS), path, GENE_INFO_FIELDS, "column")


def write_gene_tf(matrix: DataFrame, path: str) -> None:
    """The gene by factor matrix with ten decimals, ``geneID`` first, one folder a column."""
    write_tsv(_decimals(matrix).withColumnRenamed("gene_id", "geneID"), path, partition="column")


def _decimals(matrix: DataFrame) -> DataFrame:
    """Doubles of the gene by factor matrix with ten decimals, as text."""
    return matrix.select(*[F.format_string(f"%.{GENE_TF_DECIMALS}f", F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in matrix.dtypes])


def write_discarded(discarded: DataFrame, path: str) -> None:
    """Genes without a region and the reason, tab-separated, without a header."""
    discarded.select("gene_id", "reason").write.mode("errorifexists").option("sep", "\t").csv(path)


def write_files(df: DataFrame, folder: str, files: dict[str, str], fields: dict[str, str]) -> None:
    """One gzipped table with a header for each activity column, under the exact names of ``files`` (column: name) in ``folder``.

    Each column is one task's output, committed by Spark, so a failed attempt leaves nothing; then it
    is moved to its name. A column without rows gets a file with the header alone.
    """
    columns = list(files)
    parts = f"{folder}/parts-{uuid.uuid4().hex}"
    number = (F.array_position(F.array(*map(F.lit, columns)), F.col("column")) - 1).cast("int")
    table = df.select(number.alias("column_number"), *[F.col(f"`{c}`").alias(name) for c, name in fields.items()]).where("column_number >= 0")
    writer = table.repartition("column_number").write.option("sep", "\t").option("header", True).option("compression", "gzip").option("emptyValue", "").option("maxRecordsPerFile", 0)
    writer.partitionBy("column_number").csv(parts)
    for k, column in enumerate(columns):
        found = [n for n in store.names(f"{parts}/column_number={k}") if n.startswith("part-")]
        if len(found) > 1:
            raise ValueError(f"{files[column]} came in {len(found)} parts")
        if found:
            store.move(f"{parts}/column_number={k}/{found[0]}", f"{folder}/{files[column]}")
        else:
            store.write_bytes(f"{folder}/{files[column]}", gzip.compress(("\t".join(fields.values()) + "\n").encode()))
    store.delete_folder(parts)


def file_names(prefix: str, table: str, columns: dict[str, str]) -> dict[str, str]:
    """The published name of a table's file for each activity column (column: suffix)."""
    return {c: f"{prefix}_{table}{suffix}.txt.gz" for c, suffix in columns.items()}


def write_run(result, folder: str, prefix: str, adapted: bool = True) -> dict[str, str | dict[str, str]]:
    """All tables of a run under their published names in ``folder``, which must not exist; gives the names, by column where there is one file for each.

    The folder is put together beside its place and appears when all is written.
    """
    columns = result.columns or {"": ""}
    out: dict = {}
    with store.staged(folder) as staging:
        if result.interactions is not None:
            out[INTERACTIONS] = file_names(prefix, INTERACTIONS, columns)
            fields = INTERACTION_FIELDS if adapted else INTERACTION_FIELDS | {"activity": "scaledActivity"}
            hits = result.interactions
            if set(fields) <= set(hits.columns):  # interactions that were given have fewer fields, and files of their own
                write_files(_digits(hits, INTERACTION_DIGITS), staging, out[INTERACTIONS], fields)
            else:
                del out[INTERACTIONS]
        if result.gene_info is not None:
            out[GENE_INFO] = file_names(prefix, GENE_INFO, columns)
            write_files(_digits(result.gene_info, GENE_INFO_DIGITS), staging, out[GENE_INFO], GENE_INFO_FIELDS)
        out[GENE_TF] = file_names(prefix, GENE_TF, columns)
        table = _decimals(wide_vectors(result.gene_tf_vectors, result.factors, result.features))
        write_files(table, staging, out[GENE_TF], {c: "geneID" if c == "gene_id" else c for c in table.columns if c != "column"})
        out[DISCARDED] = f"{prefix}_{DISCARDED}.txt"
        write_discarded(result.discarded.coalesce(1), f"{staging}/discarded")  # genes of one annotation
        found = [n for n in store.names(f"{staging}/discarded") if n.startswith("part-")]
        store.write_bytes(f"{staging}/{out[DISCARDED]}", b"") if not found else store.move(f"{staging}/discarded/{found[0]}", f"{staging}/{out[DISCARDED]}")
        store.delete_folder(f"{staging}/discarded")
    return {name: {c: f"{folder.rstrip('/')}/{n}" for c, n in x.items()} if isinstance(x, dict) else f"{folder.rstrip('/')}/{x}" for name, x in out.items()}


def write_bed(regions: DataFrame, path: str) -> None:
    regions.select("chr", "start", "end").write.mode("errorifexists").option("sep", "\t").csv(path)


def write_energy_matrices(matrices: DataFrame, path: str, gc: float) -> None:
    """Energy matrices as text records, six significant digits."""
    digits = lambda x: significant_text(x, 6)
    rows = F.array_join(F.transform("energy", lambda r: F.array_join(F.transform(r, digits), "\t")), "\n")
    head = F.concat(F.lit(">"), F.col("ac"), F.lit("\t"), F.col("name"), F.lit("\tlnR0: "), digits(F.col("lnr0")))
    matrices.orderBy("motif_ord").select(F.concat(head, F.lit("\n"), rows).alias("value")).write.mode("errorifexists").text(path)


def write_binary(wide: DataFrame, genes: DataFrame, columns: list[str], fields: list[str], path: str, member_genes: int = MEMBER_GENES) -> int:
    """The matrix as little-endian 32-bit floats: factor fastest, then column, then gene; gives the number of values.

    ``genes`` has gene_id and ord, their order; ``columns`` and ``fields`` are as few as activity
    columns and motifs. The rows are written once, ranged by gene, and each task writes its range as a part of
    gzip members, each of some whole genes; the parts in order of their names are one gzip stream.
    The table ``members`` tells where each member lies and which genes it holds. The folder appears
    when all is written; a repeated attempt writes under a name of its own, which no member names.
    """
    with store.staged(path) as staging:
        data = f"{staging}/Reshape_Binary.bin.gz"
        named = genes.select(F.col("gene_id").alias("g"), F.col("ord").alias("gi"))
        col_ord = F.array_position(F.array(*map(F.lit, columns)), F.col("column"))
        rows = wide.join(named, F.col("gene_id") == F.col("g")).select("gi", col_ord.alias("ci"), F.array(*[F.col(f"`{f}`").cast("float") for f in fields]).alias("v"))
        rows = written(rows, "binary-rows")  # to be ranged, rows are read twice

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task = TaskContext.get()
            name, place, held = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.gz", 0, []
            system, folder = store.located(data)
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
                told: list[dict] = []
                for values, own in chain(_members(batches, held, member_genes), _rest(held)):
                    member = gzip.compress(values.astype("<f4").tobytes())
                    out.write(member)
                    told.append({"name": name, "place": place, "bytes": len(member), "genes": own, "n": len(values)})
                    place += len(member)
                    if len(told) == TOLD_MEMBERS:
                        yield pa.RecordBatch.from_pylist(told, schema=_MEMBER)
                        told = []
                if told:
                    yield pa.RecordBatch.from_pylist(told, schema=_MEMBER)

        ranged = rows.repartitionByRange("gi").sortWithinPartitions("gi", "ci").select("gi", "v")
        ranged.mapInArrow(run, MEMBERS).write.parquet(f"{staging}/members")
        listed = wide.sparkSession.read.schema(MEMBERS).parquet(f"{staging}/members")
        counted = {r["name"]: r["n"] for r in listed.groupBy("name").agg(F.sum("n").alias("n")).collect()}  # one row a part
        for name in set(store.names(data)) - set(counted):  # attempts that do not count, and parts without a gene
            system, place = store.located(f"{data}/{name}")
            system.delete_file(place)
        count = sum(counted.values())
        system, place = store.located(f"{staging}/Reshape_Meta.txt")
        with system.open_output_stream(place, compression=None) as meta:
            meta.write("\n".join([str(count), "\t".join(fields), "\t".join(columns), ""]).encode())
            # Names only, partition by partition.
            for k, row in enumerate(genes.orderBy("ord").select("gene_id").toLocalIterator()):
                meta.write(("\t" * (k > 0) + row["gene_id"]).encode())
            meta.write(b"\n")
        store.write_bytes(f"{staging}/Endianness_check.txt", ("\n".join(["LITTLE_ENDIAN", *map(str, ORDER_CHECK)]) + "\n").encode())
        store.write_bytes(f"{staging}/Endianness_check.bin", struct.pack("<4f", *ORDER_CHECK))
    return count


def _members(batches: Iterator[pa.RecordBatch], held: list[pa.RecordBatch], genes: int) -> Iterator[tuple]:
    """Values and genes of one member after the other; what does not fill one stays in ``held``."""
    import numpy as np

    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        gene = table.column("gi").to_numpy()
        starts = np.flatnonzero(np.diff(gene, prepend=gene[0] - 1)) if len(gene) else []
        if len(starts) > genes:
            cuts = [*starts[::genes].tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield _member(table.slice(a, b - a))
            held[:] = table.slice(cuts[-1]).combine_chunks().to_batches()


def _rest(held: list[pa.RecordBatch]) -> Iterator[tuple]:
    if sum(x.num_rows for x in held):
        yield _member(pa.Table.from_batches(held))


def _member(table: pa.Table) -> tuple:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), list(dict.fromkeys(table.column("gi").to_pylist()))


def _wanted(spark: SparkSession, genes: list[int] | DataFrame) -> DataFrame:
    """(g_): the places of genes, of a list or of the one column of a table, each once; broadcast if they are few."""
    table = genes if isinstance(genes, DataFrame) else spark.createDataFrame([(int(g),) for g in genes], "g_ long")
    return bounded(table.select(F.col(f"`{table.columns[0]}`").cast("long").alias("g_")).distinct())


def binary_members(spark: SparkSession, path: str, genes: list[int] | DataFrame | None = None) -> DataFrame:
    """(name, place, bytes, genes, n): the members of a folder of ``write_binary``, or those that hold any of the given genes."""
    members = spark.read.schema(MEMBERS).parquet(f"{path.rstrip('/')}/members")
    if genes is None:
        return members
    hit = members.select("name", "place", F.explode("genes").alias("gene")).join(_wanted(spark, genes), F.col("gene") == F.col("g_"), "left_semi")
    return members.join(hit.select("name", "place").distinct(), ["name", "place"], "left_semi")


def read_binary(spark: SparkSession, path: str, genes: list[int] | DataFrame | None = None) -> DataFrame:
    """(gene_ord, column, field, value) of a folder of ``write_binary``; with ``genes``, a list or a table of one column, only their members are read.

    Members are dealt by their place to as many tasks as all values ask for, and neighbours are read at once.
    """
    fields, columns = (line.split("\t") for line in _meta_lines(path))
    data, width = f"{path.rstrip('/')}/Reshape_Binary.bin.gz", len(fields)
    per_gene = width * len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for name, spans in groupby(_spans(row for batch in batches for row in batch.to_pylist()), lambda span: span[0]["name"]):
            system, folder = store.located(f"{data}/{name}")
            with system.open_input_file(folder) as source:
                for span in spans:
                    source.seek(span[0]["place"])
                    values = np.frombuffer(gzip.decompress(source.read(sum(row["bytes"] for row in span))), "<f4")
                    own = np.repeat(np.concatenate([row["genes"] for row in span]), per_gene)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.arange(len(values)) % per_gene), pa.array(values)], ["gene_ord", "at", "value"])

    members = binary_members(spark, path, genes)
    count = binary_members(spark, path).agg(F.sum("n")).first()[0] or 0
    dealt = members.repartition(max(1, math.ceil(count / TASK_VALUES)), "name", F.floor(F.col("place") / SPAN_BYTES)).sortWithinPartitions("name", "place")
    values = dealt.mapInArrow(run, "gene_ord long, at long, value float")
    if genes is not None:
        values = values.join(_wanted(spark, genes), F.col("gene_ord") == F.col("g_"), "left_semi")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    return values.select("gene_ord", pick(columns, F.floor(F.col("at") / width)).alias("column"), pick(fields, F.col("at") % width).alias("field"), "value")


def _spans(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Members in order by name and place, those together that lie side by side, up to SPAN_BYTES and TOLD_MEMBERS."""
    span: list[dict] = []
    used = 0
    for row in rows:
        if span and (row["name"] != span[-1]["name"] or row["place"] != span[-1]["place"] + span[-1]["bytes"] or used + row["bytes"] > SPAN_BYTES or len(span) == TOLD_MEMBERS):
            yield span
            span, used = [], 0
        span.append(row)
        used += row["bytes"]
    if span:
        yield span


def _meta_lines(path: str) -> list[str]:
    """The lines of fields and of columns; the line of genes is not read."""
    system, place = store.located(f"{path.rstrip('/')}/Reshape_Meta.txt")
    with system.open_input_stream(place, compression=None) as source:
        text = b""
        while text.count(b"\n") < 3 and (block := source.read(1 << 16)):
            text += block
    return text.decode(errors="ignore").split("\n")[1:3]


def write_metadata(path: str, sections: dict[str, dict | list]) -> None:
    """Metadata of a run as text: sections in brackets, then a line for each entry; refuses an existing file."""
    store.refuse_existing(path)
    lines = []
    for name, entries in sections.items():
        lines += [f"[{name}]", *([f"{k}\t{v}" for k, v in entries.items()] if isinstance(entries, dict) else map(str, entries)), ""]
    store.write_bytes(path, "\n".join(lines).encode())


def read_metadata(path: str) -> dict[str, dict]:
    """Sections of a metadata file."""
    out: dict[str, dict] = {}
    for line in store.read_bytes(path).decode().splitlines():
        if line.startswith("["):
            out[line.strip("[]")] = section = {}
        elif line:
            key, _, value = line.partition("\t")
            section[key] = value
    return out
