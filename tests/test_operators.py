"""Hand-computed and metamorphic tests of the interval part, and a whole run over small files."""

import gzip
import math
import random
import struct
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from chromaspan.functions import columns as X
from chromaspan.operators import abc, contacts, genes, intervals, matrix, motifs, sequence, signals
from chromaspan.plans.pipeline import RunConfig, run_affinities, run_metadata, run_pipeline, run_promoter_windows, run_scores, score_metadata
from chromaspan.sinks import writers
from chromaspan.sources import readers
from chromaspan.streaming.regions import gene_activity


def test_column_grammar():
    assert signals.parse_columns("4", 6) == [4]
    assert signals.parse_columns("4-6", 6) == [4, 5, 6]
    assert signals.parse_columns("4+", 6) == [4, 5, 6]
    assert signals.parse_columns("4,6,9", 6) == [4, 6]
    assert signals.parse_columns("4,6-8", 9) == [4, 5, 6, 7, 8]
    assert signals.parse_columns("0", 6) == signals.parse_columns("", 6) == []
    assert signals.column_name("ice cream", 4) == "_ice_cream" and signals.column_name("", 4) == "_c4"


def test_scalars(spark):
    row = spark.range(1).select(
        X.tss_distance(F.lit(10), F.lit(20), F.lit(15)).alias("inside"), X.tss_distance(F.lit(10), F.lit(20), F.lit(5)).alias("left"), X.tss_distance(F.lit(10), F.lit(20), F.lit(31)).alias("right"),
        X.fractal_contact(F.lit(10)).alias("near"), X.significant(F.lit(123456.789), 3).alias("digits"), X.reverse_complement(F.lit("AACGN")).alias("rc"), X.strip_chr(F.lit("chrchr1")).alias("chr"),
    ).first()
    assert (row["inside"], row["left"], row["right"]) == (0, 6, 11)
    assert (row["near"], row["digits"], row["rc"], row["chr"]) == (1 / 5000, 123000.0, "NCGTT", "chr1")
    assert X.as_flag("T", False) and not X.as_flag("0", True) and X.as_flag("maybe", True)


@pytest.mark.parametrize("width", [None, 7, 100])
def test_overlap_joins_equal_brute_force(spark, width):
    rnd = random.Random(1)
    make = lambda n: [(i, str(rnd.randrange(3)), s, s + rnd.randrange(1, 60)) for i in range(n) for s in [rnd.randrange(400)]]
    left, right = make(60), [*make(50), (99, None, 1, 2)]
    l, r = spark.createDataFrame(left, "i long, chr string, start long, end long"), spark.createDataFrame(right, "j long, chr string, start long, end long")
    want = {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and b[2] < a[3]}
    assert {(x["i"], x["r_j"]) for x in intervals.overlap_join(l, r, "inner", width).collect()} == want
    assert intervals.overlap_join(l, r, "inner", width).count() == len(want)
    with_partner = {a for a, _ in want}
    assert sorted(x["i"] for x in intervals.overlap_join(l, r, "left_semi", width).collect()) == sorted(with_partner)
    assert sorted(x["i"] for x in intervals.overlap_join(l, r, "left_anti", width).collect()) == sorted({a[0] for a in left} - with_partner)


def test_tss_merge(spark):
    rows = [(0, "g", "G", "1", "+", 100, 200), (1, "g", "G2", "1", "+", 50, 300), (2, "g", "G", "2", "+", 1, 2), (3, "h", "H", "1", "-", 10, 20), (4, "h", "H", "1", "-", 5, 40)]
    got = {r["gene_id"]: r for r in genes.five_prime_tss(spark.createDataFrame(rows, "ord long, gene_id string, gene_name string, chr string, strand string, start long, end long")).collect()}
    assert (got["g"]["tss"], got["g"]["gene_name"], got["g"]["chr"], got["h"]["tss"]) == (50, "G", "1", 40)


def test_energies_and_affinity(spark):
    counts = spark.createDataFrame([(0, "M", "m", 0, 9.0, 0.0, 0.0, 0.0), (0, "M", "m", 1, 0.0, 0.0, 3.0, 0.0), (0, "M", "m", 2, 4.0, 4.0, 0.0, 0.0)], "motif_ord long, ac string, name string, pos int, a double, c double, g double, t double")
    e = {r["pos"]: r for r in motifs.energies(counts, 0.4).collect()}
    assert e[0]["a"] == 0 and e[0]["t"] == pytest.approx(math.log(10) / 0.7) and e[0]["c"] == pytest.approx(math.log(10 * 0.3 / 0.2) ** 1 / 0.7 - 2 * math.log(0.3 / 0.2) / 0.7)
    assert e[2]["a"] == e[2]["c"] == 0
    m = motifs.to_matrices(motifs.energies(counts, 0.4))
    seqs = spark.createDataFrame([("a", "ACGTTGCANNACG"), ("b", "AC"), ("c", None), ("d", "TGCAACGT")], "peak_id string, seq string")
    got = {r["peak_id"]: r["affinity"][0] for r in motifs.affinities(seqs, m).collect()}
    flipped = {r["peak_id"]: r["affinity"][0] for r in motifs.affinities(seqs, motifs.reverse_complement(m)).collect()}
    r0 = 3 * 0.584 - 5.66
    table = [[e[p][b] for b in "acgt"] for p in range(3)]
    back = [row[::-1] for row in table[::-1]]

    def naive(seq):
        total = 0.0
        for i in range(len(seq) - 2):
            site = seq[i : i + 3]
            if set(site) <= set("ACGT"):
                pf, pr = (1 / (1 + math.exp(sum(t[k]["ACGT".index(b)] for k, b in enumerate(site)) - r0)) for t in (table, back))
                total += pf + (1 - pf) * pr
        return total

    assert got["a"] == pytest.approx(naive("ACGTTGCANNACG")) and got["b"] == got["c"] == 0
    assert got == pytest.approx(flipped)


def test_contacts(spark):
    raw = spark.createDataFrame([("1", 5000, 100, 2.0), ("1", 100, 7000, 4.0), ("1", 12000, 100, float("nan")), ("1", 0, 0, 9.0), ("1", 10000, 5000, 3.0), ("1", 0, 15000, 1.0)], "chr string, pos1 long, pos2 long, contact double")
    cells = contacts.canonical(raw, 5000)
    assert cells.count() == 5 and cells.where("bin1 > bin2").count() == 0
    diagonal = {r["bin1"]: r["contact"] for r in contacts.with_diagonal(cells).where("bin1 = bin2").collect()}
    assert diagonal == {0: 4.0, 1: 4.0, 2: 3.0}
    profile = {r["d"]: (r["total"], r["mean"]) for r in contacts.distance_profile(cells, 5000).collect()}
    assert profile == {1: (9.0, 4.5), 3: (1.0, None)}
    assert contacts.power_law(cells, 5000).first()["slope"] is None


@pytest.fixture(scope="module")
def small(spark):
    rnd = random.Random(2)
    g = [(f"g{i}", f"n{i}", str(i % 2), [rnd.randrange(1, 60_000) for _ in range(1 + i % 3)]) for i in range(12)]
    p = [(f"{c}:{s}-{s + 400}", c, s, s + 400) for c, s in {(str(rnd.randrange(2)), rnd.randrange(60_000)) for _ in range(40)}]
    sig = [(x[0], col, float(rnd.randrange(0, 50))) for x in p for col in ("u", "v")]
    cells = [(c, a, b, float(rnd.randrange(1, 90))) for c in "01" for a in range(12) for b in range(a, 12) if rnd.random() < 0.7]
    return (
        spark.createDataFrame(g, "gene_id string, gene_name string, chr string, tss array<long>"), spark.createDataFrame(p, "peak_id string, chr string, start long, end long"),
        spark.createDataFrame(sig, "peak_id string, column string, signal double"), spark.createDataFrame(cells, "chr string, bin1 long, bin2 long, contact double"),
    )


@pytest.mark.parametrize("adapted", [True, False])
def test_abc_sums(spark, small, adapted):
    g, p, s, c = small
    settings = abc.AbcSettings(gene_window=100_000, enhancer_window=100_000, cutoff=0.0, adapted=adapted)
    for cells in (c, None):
        hits = abc.score(g, p, s, settings, cells)
        sums = hits.groupBy("column", "gene_id").agg(F.sum("abc_score").alias("s")).collect()
        assert sums and all(r["s"] == pytest.approx(1) for r in sums)
        if adapted:
            n = g.select("gene_id", F.size("tss").alias("n"))
            dealt = hits.join(n, "gene_id").groupBy("column", "peak_id", "signal").agg(F.sum(F.col("activity") * F.col("n")).alias("a")).collect()
            assert all(r["a"] == pytest.approx(r["signal"]) for r in dealt)
    keys = spark.createDataFrame([("g1",), ("n4",)], "key string")
    some = abc.score(g, p, s, settings, c, keys).select("gene_id").distinct().collect()
    assert {r[0] for r in some} <= {"g1", "g4"}


def test_gene_info_reasons(spark, small):
    g, p, s, c = small
    extra = spark.createDataFrame([("far", "far", "0", [9_000_000]), ("none", "none", "7", [10])], g.schema)
    g = g.union(extra)
    settings = abc.AbcSettings(gene_window=5000, enhancer_window=5000, cutoff=0.0)
    hits = abc.score(g, p, s, settings, c)
    cand = intervals.overlap_join(genes.gene_windows(g, 5000), p)
    got = {r["gene_id"]: r["failure"] for r in abc.gene_info(hits, g, ["u"], cand, c.select("chr")).collect()}
    assert got["far"] == "No candidate regions in gene window" and got["none"] == "Missing normalized contact file" and "-" in got.values()


GTF = """# annotation
chr1\tx\tgene\t101\t900\t.\t+\t.\tgene_id "G1"; gene_name "One";
chr1\tx\ttranscript\t101\t900\t.\t+\t.\tgene_id "G1"; gene_name "One";
chr1\tx\ttranscript\t301\t900\t.\t+\t.\tgene_id "G1"; gene_name "One";
chr1\tx\tgene\t2001\t2900\t.\t-\t.\tgene_id "G2";
chr1\tx\ttranscript\t2001\t2900\t.\t-\t.\tgene_id "G2";
chr1\tx\tgene\t90001\t90900\t.\t-\t.\tgene_id "G3"; gene_name "Three";
"""
TRANSFAC = """AC M1
ID first
P0 A C G T
01 9 0 0 1
02 0 8 1 1
03 0 0 9 1
XX
//
AC M2
ID second
P0 A C G T
01 1 1 1 7
02 5 1 1 3
XX
//
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base, rnd = tmp_path_factory.mktemp("files"), random.Random(4)
    (base / "a.gtf").write_text(GTF)
    (base / "r.bed").write_text("# Chr\tstart\tend\tred\tsky blue\nchr1\t50\t150\t2.5\t1\nchr1\t2850\t2950\t4\t0\nchr1\t2850\t2950\t4\t0\nchr1\t400\t450\t1\t3\n")
    (base / "x.bed").write_text("chr1\t440\t500\n")
    (base / "g.fa").write_text(">chr1 test\n" + "\n".join("".join(rnd.choices("ACGTn", k=60)) for _ in range(60)) + "\n>chr2\nACGT\n")
    (base / "m.txt").write_text(TRANSFAC)
    (base / "hic").mkdir()
    with gzip.open(base / "hic" / "chr1_5kb.gz", "wt") as f:
        f.write("0\t0\t4\n0\t5000\t2.5\n5000\t10000\tNaN\n")
    return base


def test_readers(spark, files):
    assert {(r["gene_id"], r["gene_name"], r["chr"], r["tss"]) for r in readers.read_gtf(spark, str(files / "a.gtf")).collect()} == {("G1", "One", "1", 101), ("G2", "G2", "1", 2900), ("G3", "Three", "1", 90900)}
    bed, names = readers.read_bed(spark, str(files / "r.bed"), "4+")
    assert names == {"c4": "_red", "c5": "_sky_blue"} and bed.count() == 3
    fasta = {r["chr"]: r["seq"] for r in readers.read_fasta(spark, str(files / "g.fa")).collect()}
    assert len(fasta["1"]) == 3600 and fasta["2"] == "ACGT"
    assert contacts.canonical(readers.read_contacts(spark, str(files / "hic")), 5000).count() == 2
    m = motifs.to_matrices(motifs.energies(readers.read_transfac(spark, str(files / "m.txt")))).orderBy("motif_ord").collect()
    assert [(r["ac"], r["name"], r["length"]) for r in m] == [("M1", "first", 3), ("M2", "second", 2)]


def test_genome_by_lines(spark, tmp_path):
    """Contigs over several blocks of a file, in short and in very long lines, equal their text."""
    rnd = random.Random(3)
    contigs = {f"c{k}": "".join(rnd.choices("ACGTN", k=n)) for k, n in enumerate((5, 900, 1, 4000, 300, 2500))}
    text = "".join(f">chr{k} note\n" + ("\n".join(v[i : i + 60] for i in range(0, len(v), 60)) if k != "c3" else v) + "\n" for k, v in contigs.items())
    (tmp_path / "g.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = readers.read_genome(spark, str(tmp_path / "g.fa"), 128).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in sorted(rows, key=lambda r: r["chunk"]):
        assert r["length"] == len(contigs[r["chr"]]) and (len(r["part"]) == 128 or (r["chunk"] + 1) * 128 > r["length"])
        got[r["chr"]] = got.get(r["chr"], "") + r["part"]
    assert got == contigs


def test_gene_tf_blocks_equal_long_sums(spark):
    rnd = random.Random(6)
    affinity = spark.createDataFrame([(f"p{i}", [rnd.random() for _ in range(3)]) for i in range(40)], "peak_id string, affinity array<double>")
    scaled = spark.createDataFrame([(rnd.choice("uv"), f"g{rnd.randrange(6)}", f"p{rnd.randrange(45)}", rnd.random() if rnd.random() < 0.9 else None) for _ in range(300)], "column string, gene_id string, peak_id string, scaler double")
    m = spark.createDataFrame([(i, f"m{i}", i + 2) for i in range(3)], "motif_ord long, name string, length int")
    rows = scaled.join(affinity, "peak_id").select("column", "gene_id", "scaler", F.posexplode("affinity").alias("k", "x")).groupBy("column", "gene_id", "k").agg(F.sum(F.col("x") * F.col("scaler")).alias("t")).collect()
    want = {(r["column"], r["gene_id"], f"m{r['k']}"): r["t"] / (r["k"] + 2) for r in rows}
    assert {(r["column"], r["gene_id"], r["tf"]): r["value"] for r in matrix.gene_tf(scaled, affinity, m).collect()} == pytest.approx(want)


def test_quirk_switches(spark, small):
    """A maximum that depends on the regions' order, and a constant beyond a megabase without a fit."""
    g, p, s, c = small
    base = abc.AbcSettings(gene_window=100_000, enhancer_window=100_000, cutoff=0.0, adapted=False)
    plain, ordered = (abc.score(g, p, s, abc.AbcSettings(**(base.__dict__ | {"ordered_max": x}))) for x in (False, True))
    sig = {(r["peak_id"], r["column"]): r["signal"] for r in s.collect()}
    n = {r["gene_id"]: len(r["tss"]) for r in g.collect()}
    rows = ordered.collect()
    some = 0
    for gene, col in {(r["gene_id"], r["column"]) for r in rows}:
        own = sorted((r for r in rows if (r["gene_id"], r["column"]) == (gene, col)), key=lambda r: (r["start"], r["end"], r["peak_id"]))
        pairs = abc.pair_contacts(g.where(g["gene_id"] == gene), p, base).where("near").select("peak_id", "start", "end").distinct().orderBy("start", "end", "peak_id").collect() if some < 3 else None
        if pairs is None:
            continue
        some += 1
        held = 0.0
        for x in pairs:
            held = sig[x["peak_id"], col] if n[gene] * sig[x["peak_id"], col] > held else held
        assert all(r["activity"] == pytest.approx(100 * r["signal"] / held) for r in own)
    assert plain.count() == len(rows)
    far = spark.createDataFrame([("g", "1", [10])], "gene_id string, chr string, tss array<long>"), spark.createDataFrame([("1:3000000-3000100", "1", 3_000_000, 3_000_100)], "peak_id string, chr string, start long, end long")
    cells = spark.createDataFrame([("1", 0, 1, 2.0)], "chr string, bin1 long, bin2 long, contact double")
    got = [abc.pair_contacts(*far, abc.AbcSettings(4_000_000, 4_000_000, unit_far_pseudocount=x), cells).first()["contact"] for x in (False, True)]
    assert got == [0.0, 1.0]


def test_parts_alone(spark, files):
    """Scores, affinities, windows and gene values by themselves, with their own defaults."""
    cfg = RunConfig(annotation=str(files / "a.gtf"), genome="", bed=str(files / "r.bed"), cutoff=0.0, window=10_000)
    hits, info = run_scores(spark, cfg)
    assert {r["column"] for r in hits.select("column").distinct().collect()} == {"c4"} and info.count() == 2
    assert run_promoter_windows(spark, str(files / "a.gtf")).count() == 3
    assert {r["end"] - r["start"] for r in run_promoter_windows(spark, str(files / "a.gtf")).collect()} <= {5001, 2601}
    (files / "s.fa").write_text(">1:0-4\nACGTACGTTG\n>1:5-6\nA\n")
    writers.write_energy_matrices(motifs.to_matrices(motifs.energies(readers.read_transfac(spark, str(files / "m.txt")))), str(files / "psem"), 0.41)
    aff = run_affinities(spark, str(files / "s.fa"), str(files / "psem"))
    assert [(r["peak_id"], len(r["affinity"])) for r in aff.collect()] == [("1:0-4", 2)]


def test_run_is_written_and_told(spark, files, tmp_path):
    cfg = RunConfig(annotation=str(files / "a.gtf"), genome=str(files / "g.fa"), bed=str(files / "r.bed"), counts=str(files / "m.txt"), columns="4-5", fractal=True, cutoff=0.0, window=10_000)
    result = run_pipeline(spark, cfg)
    paths = writers.write_run(result, str(tmp_path / "out"), "x")
    assert set(paths) == {writers.INTERACTIONS, writers.GENE_INFO, writers.GENE_TF, writers.DISCARDED}
    named = sorted(p.name for p in (tmp_path / "out").iterdir())
    suffixes = list(result.columns.values())
    assert named == sorted(["x_discarded_Genes.txt", *[f"x_{t}{s}.txt.gz" for t in ("ABCpp_scoredInteractions", "GeneInfo", "TF_Gene_Affinities") for s in suffixes]])
    # What was written is found from the name of any of its files.
    again = readers.interaction_files(paths[writers.INTERACTIONS]["c4"], result.columns)
    assert again == paths[writers.INTERACTIONS]
    back = readers.read_interactions(spark, again)
    assert back.count() == result.interactions.count() > 0
    with gzip.open(paths[writers.GENE_TF]["c5"], "rt") as f:
        assert f.readline().rstrip("\n").split("\t") == ["geneID", *result.factors, "NumPeaks", "AvgPeakDistance", "AvgPeakSize"]
    with pytest.raises(FileExistsError):
        writers.write_run(result, (tmp_path / "out").as_uri(), "x")
    broken = replace(result, gene_info=result.gene_info.withColumn("avg_contact", F.when(F.col("gene_id") != "", F.raise_error(F.lit("no"))).otherwise(F.col("avg_contact")).cast("double")))
    with pytest.raises(Exception, match="no"):
        writers.write_run(broken, str(tmp_path / "other"), "x")
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("o")) == ["out"]  # nothing is left
    with pytest.raises(FileExistsError):
        writers.write_run(result, str(tmp_path / "out"), "x")
    told = run_metadata(spark, cfg, result)
    assert told["Metrics"] == {"provided regions": 5, "considered motifs": 2, "regions with a sequence": result.regions.count(), "genes without a region": result.discarded.count(), "interactions": result.interactions.count()}
    writers.write_metadata(str(tmp_path / "meta.tsv"), told)
    back = writers.read_metadata(str(tmp_path / "meta.tsv"))
    assert back["Metrics"]["provided regions"] == "5" and back["Metrics"]["considered motifs"] == "2" and back["Metrics"]["interactions"] == str(result.interactions.count())
    with pytest.raises(ValueError, match="activity"):
        run_pipeline(spark, RunConfig(annotation="a", genome="g", counts="c", bed="b", fractal=True))


def test_energy_file_roundtrip(spark, files, tmp_path):
    m = motifs.to_matrices(motifs.energies(readers.read_transfac(spark, str(files / "m.txt"))))
    writers.write_energy_matrices(m, str(tmp_path / "psem"), 0.41)
    back = readers.read_energy_matrices(spark, str(tmp_path / "psem")).collect()
    want = {r["name"]: r for r in m.collect()}
    assert len(back) == 2
    for r in back:
        assert r["length"] == want[r["name"]]["length"] and r["lnr0"] == pytest.approx(want[r["name"]]["lnr0"], rel=1e-5)
        assert [x for row in r["energy"] for x in row] == pytest.approx([x for row in want[r["name"]]["energy"] for x in row], rel=1e-5, abs=1e-6)


def test_run_window_mode(spark, files, tmp_path):
    cfg = RunConfig(annotation=str(files / "a.gtf"), genome=str(files / "g.fa"), bed=str(files / "r.bed"), counts=str(files / "m.txt"), columns="4+", window=1000, exclude=str(files / "x.bed"))
    out = run_pipeline(spark, cfg)
    assert {r["peak_id"] for r in out.regions.collect()} == {"1:50-150", "1:2850-2950"}
    assert {r["gene_id"] for r in out.discarded.collect()} == {"G3"}
    features = {(r["column"], r["gene_id"]): (r["num_peaks"], r["avg_peak_size"]) for r in out.features.collect()}
    assert features == {("c4", "G1"): (1, 100.0), ("c5", "G1"): (1, 100.0), ("c4", "G2"): (1, 100.0), ("c5", "G2"): (0, 0.0)}
    wide = matrix.wide(out.gene_tf, ["first", "second"], out.features)
    assert wide.columns == ["column", "gene_id", "first", "second", "NumPeaks", "AvgPeakDistance", "AvgPeakSize"]
    fields = wide.columns[2:]
    order = spark.createDataFrame([("G1", 0), ("G2", 1)], "gene_id string, ord long")
    n = writers.write_binary(wide, order, ["c4", "c5"], fields, str(tmp_path / "bin"))
    values = {(r["gene_ord"], r["column"], r["field"]): r["value"] for r in writers.read_binary(spark, str(tmp_path / "bin")).collect()}
    rows = {(r["column"], r["gene_id"]): r for r in wide.collect()}
    assert n == len(values) == 2 * 2 * 5
    one = writers.write_binary(wide, order, ["c4", "c5"], fields, str(tmp_path / "bin1"), member_genes=1)
    assert one == n and writers.binary_members(spark, str(tmp_path / "bin1"), [1]).count() == 1
    some = {(r["gene_ord"], r["column"], r["field"]): r["value"] for r in writers.read_binary(spark, str(tmp_path / "bin1"), [1]).collect()}
    assert some == {k: v for k, v in values.items() if k[0] == 1} and len(some) == 10
    with pytest.raises(FileExistsError):
        writers.write_binary(wide, order, ["c4", "c5"], fields, (tmp_path / "bin1").as_uri())
    assert [values[0, "c5", f] for f in fields] == pytest.approx([float(rows["c5", "G1"][f]) for f in fields], rel=1e-6)
    # The parts are one gzip stream: factor fastest, then column, then gene.
    parts = sorted((tmp_path / "bin" / "Reshape_Binary.bin.gz").glob("*.gz"))
    stream = gzip.decompress(b"".join(p.read_bytes() for p in parts))
    want = [float(rows[c, g][f]) for g in ("G1", "G2") for c in ("c4", "c5") for f in fields]
    assert list(struct.unpack(f"<{n}f", stream)) == pytest.approx(want, rel=1e-6)
    assert (tmp_path / "bin" / "Reshape_Meta.txt").read_text().split("\n")[2:4] == ["c4\tc5", "G1\tG2"]
    assert struct.unpack("<4f", (tmp_path / "bin" / "Endianness_check.bin").read_bytes()) == tuple(writers.ORDER_CHECK)
    writers.write_tsv(wide, str(tmp_path / "tsv"), partition="column")
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_tsv(wide, str(tmp_path / "tsv"), partition="column")


@pytest.mark.parametrize("contact", [False, True])
def test_run_scored_mode(spark, files, tmp_path, contact):
    cfg = RunConfig(annotation=str(files / "a.gtf"), genome=str(files / "g.fa"), bed=str(files / "r.bed"), counts=str(files / "m.txt"), gc=0.41, columns="4-5", fractal=not contact, contacts=str(files / "hic") if contact else None, cutoff=0.0, window=10_000)
    out = run_pipeline(spark, cfg)
    assert out.interactions.count() > 0 and out.gene_info.count() == 2 * 2 and out.gene_tf.count() > 0
    writers.write_interactions(out.interactions, str(tmp_path / "i"))
    paths = {c: str(tmp_path / "i" / f"column={c}") for c in ("c4", "c5")}
    again = run_pipeline(spark, RunConfig(**(cfg.__dict__ | {"interactions": paths, "fractal": False, "contacts": None})))
    key = lambda df: {(r["column"], r["gene_id"], r["tf"]): r["value"] for r in df.collect()}
    assert key(again.gene_tf) == pytest.approx(key(out.gene_tf))


def test_run_promoter_mode(spark, files):
    out = run_pipeline(spark, RunConfig(annotation=str(files / "a.gtf"), genome=str(files / "g.fa"), counts=str(files / "m.txt"), window=200))
    assert {r["gene_id"] for r in out.discarded.collect()} == {"G3"}
    assert {(r["gene_id"], r["num_peaks"]) for r in out.features.collect()} == {("G1", 1), ("G2", 1)}


def test_streaming_equals_batch(spark, tmp_path):
    g = spark.createDataFrame([("g", "1", 500), ("h", "1", 90_000)], "gene_id string, chr string, tss long")
    rows = spark.createDataFrame([("1", 100, 300, 2.0), ("1", 450, 600, 5.0), ("2", 450, 600, 5.0), ("1", 89_000, 89_500, 1.0)], "chr string, start long, end long, signal double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = gene_activity(stream, g, 2500).writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    norm = lambda df: {r["gene_id"]: (r["n_regions"], round(r["activity"], 9)) for r in df.collect()}
    assert norm(spark.table("activity")) == norm(gene_activity(rows, g, 2500)) != {}


def test_sequences_across_chunks(spark):
    genome = spark.createDataFrame([("1", "ACGT" * 30)], "chr string, seq string")
    regions = spark.createDataFrame([("a", "1", 3, 50), ("b", "1", 0, 120), ("c", "1", 100, 121)], "peak_id string, chr string, start long, end long")
    got = {r["peak_id"]: r["seq"] for r in sequence.extract(regions, sequence.chunk_genome(genome, 16), 16).collect()}
    assert got == {"a": ("ACGT" * 30)[3:50], "b": "ACGT" * 30}


FLAGS = [("True", True, True), ("F", False, False), ("1", True, True), ("false", False, False), ("maybe", True, False), ("", True, False)]


@pytest.mark.parametrize(("flag", "or_true", "or_false"), FLAGS)
def test_flag_spellings(flag, or_true, or_false):
    assert (X.as_flag(flag, True), X.as_flag(flag, False)) == (or_true, or_false)


OPTIONS = [
    ({"counts": "c"}, ""),
    ({}, "motifs are required, as energies or counts"),
    ({"genome": "", "counts": "c"}, "genome is required"),
    ({"counts": "c", "contacts": "False"}, "scores need regions and the column of their activity"),
    ({"counts": "c", "contacts": "F", "bed": "b", "columns": "4"}, ""),
    ({"counts": "c", "contacts": "folder", "bed": "b", "columns": "4", "bin_size": "0"}, "measured contacts need the size of their bins"),
    ({"counts": "c", "interactions": "x", "bed": "b"}, "given interactions need regions and the column of their activity"),
    ({"counts": "c", "window": "1e05", "bed": "F"}, ""),
    ({"counts": "c", "wndow": "1"}, "unknown options: wndow"),
]


@pytest.mark.parametrize(("options", "told"), OPTIONS)
def test_option_checks(options, told):
    config = lambda: RunConfig.from_options({"annotation": "a", "genome": "g"} | options).check()
    if told:
        with pytest.raises(ValueError, match=told):
            config()
    else:
        config()


@pytest.mark.parametrize(("options", "half", "scored"), [({}, 25_000, False), ({"contacts": "false"}, 2_500_000, True), ({"window": "1e05"}, 50_000, False)])
def test_option_defaults(options, half, scored):
    config = RunConfig.from_options({"annotation": "a", "genome": "g"} | options)
    assert (config.half, config.scored) == (half, scored)


@pytest.mark.parametrize(("path", "files"), [("x_c4.txt.gz", ["x_c4.txt.gz", "x_c5.txt.gz"]), ("x_red.txt.gz", ["x_red.txt.gz", "x_sky_blue.txt.gz"]), ("x.txt.gz", ["x_red.txt.gz", "x_sky_blue.txt.gz"])])
def test_interaction_siblings(path, files):
    assert list(readers.interaction_files(path, {"c4": "_red", "c5": "_sky_blue"}).values()) == files


def test_score_metadata(tmp_path):
    config = RunConfig(annotation="a.gtf", genome="g", bed="r.bed", columns="4+", window=100_000, fractal=True, counts="c")
    writers.write_metadata(str(tmp_path / "m"), score_metadata(config))
    found = writers.read_metadata(str(tmp_path / "m"))["Scores"]
    given = {"annotation": "a.gtf", "bed": "r.bed", "columns": "4+", "window": "100000", "cutoff": "0.02", "bin_size": "5000", "adapted": "True"}
    assert {k: found[k] for k in given} == given
