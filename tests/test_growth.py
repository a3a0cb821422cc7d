"""What must not grow with the input: a task's share of pairs, files of tiles, rows moved by column, bytes held by key."""

import random

import numpy as np
import pyarrow as pa
import pytest

from chromaspan.functions import stages
from chromaspan.operators import abc, contacts, motifs, tiles, vectors
from chromaspan.sinks import writers


def tables(spark, columns=("u", "v")):
    rng = random.Random(4)
    g = [(f"g{i}", f"n{i}", str(i % 2), [rng.randrange(1, 60_000) for _ in range(1 + i % 4)]) for i in range(20)]
    p = [(f"p{i}", str(i % 2), s := rng.randrange(60_000), s + 400, *[float(rng.randrange(50)) for _ in columns]) for i in range(60)]
    cells = [(c, a, b, float(rng.randrange(1, 90))) for c in "01" for a in range(60) for b in range(a, 60) if rng.random() < 0.5]
    peaks = spark.createDataFrame(p, "peak_id string, chr string, start long, end long, " + ", ".join(f"{c} double" for c in columns))
    long = spark.createDataFrame([(r[0], c, v) for r in p for c, v in zip(columns, r[4:], strict=True)], "peak_id string, column string, signal double")
    return spark.createDataFrame(g, "gene_id string, gene_name string, chr string, tss array<long>"), peaks, long, spark.createDataFrame(cells, "chr string, bin1 long, bin2 long, contact double")


@pytest.mark.parametrize(("adapted", "measured", "sweep"), [(True, True, False), (True, False, False), (False, True, True)])
def test_partitions_follow_the_pairs(spark, monkeypatch, adapted, measured, sweep):
    """The same rows from many small partitions as from few."""
    g, p, s, c = tables(spark)
    settings = abc.AbcSettings(20_000, 20_000, 1000, 0.01, adapted, join_width=5000, sweep=sweep)
    rows, parts = [], []
    for most in (stages.TASK_BYTES, 20_000):
        monkeypatch.setattr(stages, "TASK_BYTES", most)
        hits = abc.score(g, p, s, settings, c if measured else None)
        fields = ("contact", "activity", "tss_distance", "abc_score")
        rows.append({(r["column"], r["gene_id"], r["peak_id"], f): r[f] for r in hits.collect() for f in fields})
        parts.append(hits.rdd.getNumPartitions())
    assert rows[1] == pytest.approx(rows[0], rel=1e-9) and len(rows[0]) > 50
    assert parts[0] <= 4 and parts[1] > 8


def test_no_join_moves_hits_by_column(spark):
    """What hits need is joined before pairs become rows by column."""
    names = [f"c{k}" for k in range(9)]
    g, p, _, c = tables(spark, names)
    for adapted in (True, False):
        hits = abc.score_columns(g, p, names, abc.AbcSettings(20_000, 20_000, 1000, 0.01, adapted, join_width=5000), c)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        assert hits.count() and plan.index("Generate") < plan.index("Join")


def test_tiles_have_few_files(spark, monkeypatch):
    """A folder has the files of two squares, not of all tasks, and folders are as many as are allowed."""
    rows = [("1", b, b + d, float(b + d)) for b in range(4000) for d in (0, 1, 3)] + [("2", b, b + 1, 1.0) for b in range(2000)]
    cells = spark.createDataFrame(rows, "chr string, bin1 long, bin2 long, contact double").repartition(16)
    made = tiles.write_tiles(cells, 1000, side=8, stripe=2)
    folders = {f.rpartition("/")[0] for f in made.tiles().inputFiles()}
    assert len(folders) == 377 and len(made.tiles().inputFiles()) <= 2 * len(folders)
    monkeypatch.setattr(tiles, "MOST_STRIPES", 20)
    few = tiles.write_tiles(cells, 1000, side=8, stripe=2)
    assert len({f.rpartition("/")[0] for f in few.tiles().inputFiles()}) <= 22
    key = lambda df: sorted((r["chr"], r["bin1"], r["bin2"], r["contact"]) for r in df.collect())
    assert key(few.cells()) == key(made.cells()) == key(contacts.with_diagonal(cells))
    pairs = spark.createDataFrame([("1", 3100, 3103), ("2", 1, 9)], "chr string, a long, b long")
    assert sorted(r["contact"] for r in tiles.lookup_tiles(pairs, few, "a", "b").collect()) == [0.0, 3103.0]


def test_held_bytes_count_keys():
    """Short arrays under many keys: the keys are most of what a task holds."""
    held = vectors._Held(2)
    n = 1000
    held.add(pa.RecordBatch.from_arrays([pa.array(["a"] * n), pa.array([f"g{i}" for i in range(n)]), pa.array(np.ones((n, 2)).tolist())], ["c", "g", "t"]))
    assert held.bytes > 300 * n


def test_binary_matrix_by_table_of_genes(spark, tmp_path, monkeypatch):
    """Wanted genes may be a table of any size: they are joined, not listed in the plan; neighbouring members are read at once by several tasks."""
    monkeypatch.setattr(writers, "TASK_VALUES", 50)
    n = 90
    wide = spark.createDataFrame([(c, f"g{i}", float(i), float(-i)) for i in range(n) for c in "uv"], "column string, gene_id string, A double, B double").repartition(5)
    genes = spark.createDataFrame([(f"g{i}", 3 * i) for i in range(n)], "gene_id string, ord long")
    assert writers.write_binary(wide, genes, ["u", "v"], ["A", "B"], str(tmp_path / "b"), member_genes=2) == 4 * n
    wanted = genes.where("ord % 7 = 3").select("ord")
    part = writers.read_binary(spark, str(tmp_path / "b"), wanted)
    key = lambda df: sorted((r["gene_ord"], r["column"], r["field"], r["value"]) for r in df.collect())
    want = sorted((3 * i, c, f, float(i if f == "A" else -i)) for i in range(n) if 3 * i % 7 == 3 for c in "uv" for f in "AB")
    assert key(part) == want == key(writers.read_binary(spark, str(tmp_path / "b"), [r["ord"] for r in wanted.collect()]))
    assert "arrays_overlap" not in part._jdf.queryExecution().optimizedPlan().toString()
    whole = writers.read_binary(spark, str(tmp_path / "b"))
    assert whole.rdd.getNumPartitions() > 4 and whole.count() == 4 * n


def test_numbered_in_ranges(spark):
    """Numbers follow the order of the keys, without a window over all rows."""
    rows = [(f"g{i}", (i * 7919) % 10_007) for i in range(500)]
    df = spark.createDataFrame(rows, "gene_id string, k long").repartition(6)
    out = stages.numbered(df, "k", "ord", "genes")
    assert [(r["k"], r["ord"]) for r in out.orderBy("k").collect()] == [(k, i) for i, k in enumerate(sorted(k for _, k in rows))] and out.columns == ["gene_id", "k", "ord"]
    assert stages.numbered(df.limit(0), "k", "ord", "genes").count() == 0


def test_few_motifs_are_dealt_too(spark):
    """One part of sequences is scored by as many tasks as shuffles have."""
    seqs = spark.createDataFrame([(f"s{i}", "ACGTACGT") for i in range(40)], "peak_id string, seq string").coalesce(1)
    m = spark.createDataFrame([(0, "M", "M", 1.0, 1, [[0.0, 1.0, 1.0, 0.0]])], "motif_ord long, ac string, name string, lnr0 double, length int, energy array<array<double>>")
    assert motifs.affinities(seqs, m).rdd.getNumPartitions() >= 4
