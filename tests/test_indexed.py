"""Regions by a genome's index, and the order of files, against plain versions."""

import random

import pytest
from pyarrow import fs

from chromaspan.operators import genes, sequence
from chromaspan.sources import indexed, readers


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    rng, folder, contigs = random.Random(6), tmp_path_factory.mktemp("genome"), {}
    text, index, at = "", "", 0
    for name, n in (("chr1", 1000), ("chr2", 61), ("chrX", 60), ("chrY", 1)):
        seq = "".join(rng.choice("ACGTNacgt") for _ in range(n))
        contigs[name[3:]] = seq
        head = f">{name} something\n"
        index += f"{name}\t{n}\t{len(text) + len(head)}\t{min(n, 60)}\t{min(n, 60) + 1}\n"
        text += head + "".join(seq[i : i + 60] + "\n" for i in range(0, n, 60))
    (folder / "g.fa").write_text(text)
    (folder / "g.fa.fai").write_text(index)
    return str(folder / "g.fa"), contigs


def regions_of(spark, contigs):
    rng = random.Random(1)
    rows = [(c, s, min(len(seq) + 3, s + rng.randrange(0, 200))) for c, seq in contigs.items() for s in (0, 59, 60, *[rng.randrange(len(seq)) for _ in range(30)])] + [("9", 0, 5), ("1", 990, 1001), ("1", -5, 5)]
    rows = sorted(set(rows))
    return rows, spark.createDataFrame([(f"{c}:{s}-{e}", c, s, e) for c, s, e in rows], "peak_id string, chr string, start long, end long")


def test_indexed_extract(spark, genome):
    path, contigs = genome
    rows, df = regions_of(spark, contigs)
    want = {f"{c}:{s}-{e}": contigs[c][s:e] for c, s, e in rows if c in contigs and 0 <= s <= e <= len(contigs[c])}
    for index in (indexed.read_index(spark, path), indexed.index_genome(spark, [path])):
        got = indexed.extract_indexed(df, index)
        assert got.dtypes == sequence.extract(df, readers.read_genome(spark, path)).dtypes
        assert {r["peak_id"]: r["seq"] for r in got.collect()} == want
    assert indexed.extract_indexed(df.limit(0), indexed.read_index(spark, path)).count() == 0
    assert sorted(map(tuple, indexed.index_genome(spark, [path]).collect())) == sorted(map(tuple, indexed.read_index(spark, path).collect()))


def test_bytes_read_follow_the_regions(spark, tmp_path):
    """Two small regions of a file whose other bytes are no text at all."""
    lines = b"".join(b"ACGTACGTAC\n" for _ in range(1000))
    (tmp_path / "g.fa").write_bytes(b"\xff" * 200_000 + lines + b"\xfe" * 200_000)
    index = spark.createDataFrame([(str(tmp_path / "g.fa"), "1", 10_000, 200_000, 10, 11)], indexed.INDEX)
    df = spark.createDataFrame([("a", "1", 8, 12), ("b", "1", 9_990, 10_000)], "peak_id string, chr string, start long, end long")
    assert {r["peak_id"]: r["seq"] for r in indexed.extract_indexed(df, index).collect()} == {"a": "ACAC", "b": "ACGTACGTAC"}


def test_index_refuses_uneven_lines(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a\nACGT\nAC\nACGT\n")
    assert fs.LocalFileSystem().get_file_info(str(tmp_path / "g.fa")).is_file
    with pytest.raises(Exception, match="differ in length"):
        indexed.index_genome(spark, [str(tmp_path / "g.fa")]).collect()


def test_annotation_order_is_that_of_files(spark, tmp_path):
    line = lambda chrom, start, gene: f'{chrom}\tx\tgene\t{start}\t{start + 9}\t.\t+\t.\tgene_id "{gene}";\n'
    (tmp_path / "a.gtf").write_text(line("chr1", 50, "g"))
    (tmp_path / "b.gtf").write_text("".join(line("chr2", 7 + k, "g" if not k else f"o{k}") for k in range(3000)))
    rows = readers.read_gtf(spark, str(tmp_path))
    got = {r["gene_id"]: (r["chr"], r["tss"]) for r in genes.five_prime_tss(rows).where("gene_id = 'g'").collect()}
    assert got == {"g": ("1", 50)}
