"""Whole runs: regions, annotation, motifs, contacts and sequences to interactions and gene by factor values; and each of the parts alone.

Nothing is collected but the motifs that are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_flag
from ..functions.stages import written, written_and_counted
from ..operators import abc, genes, intervals, matrix, motifs, sequence, signals, sweep
from ..operators.contacts import canonical
from ..operators.tiles import write_tiles
from ..sources import indexed, readers


#: From so many activity columns on, scores keep them as one array; up to so many chromosomes are named to the scan of contact files.
MANY_COLUMNS, NAMED = 4, 1000


@dataclass(frozen=True)
class RunConfig:
    """Paths and switches of a run; windows are full widths in bases."""

    annotation: str
    genome: str
    bed: str | None = None
    energies: str | None = None
    counts: str | None = None
    gc: float | None = None
    columns: str = "0"
    window: int | None = None
    cutoff: float = 0.02
    contacts: str | None = None
    fractal: bool = False
    bin_size: int = 5000
    all_tss: bool = True
    decay: bool = True
    adapted: bool = True
    pseudocount: bool = True
    enhancer_window: int = 5_000_000
    exclude: str | None = None
    gene_list: str | None = None
    interactions: dict[str, str] | str = field(default_factory=dict)
    ordered_max: bool = False
    unit_far_pseudocount: bool = False
    genome_index: str | None = None

    @property
    def scored(self) -> bool:
        return (bool(self.contacts) or self.fractal) and not self.interactions

    @property
    def half(self) -> int:
        return (self.window or (5_000_000 if self.contacts or self.fractal else 50_000)) // 2

    @classmethod
    def from_options(cls, options: dict[str, str]) -> RunConfig:
        """A configuration from text options, as command lines give them: flags in any spelling, windows also as ``1e05``; ``contacts`` may be a false flag, which asks for contacts estimated from the distance."""
        kinds = {f.name: str(f.type) for f in fields(cls)}
        unknown = sorted(set(options) - set(kinds))
        if unknown:
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        out: dict = {}
        for name, value in options.items():
            kind = kinds[name]
            if kind == "bool":
                out[name] = as_flag(value, cls.__dataclass_fields__[name].default)
            else:
                out[name] = int(float(value)) if kind.startswith("int") else float(value) if kind.startswith("float") else value
        if not isinstance(out.get("contacts"), type(None)) and as_flag(out["contacts"], True) is False:
            out |= {"contacts": None, "fractal": True}
        if not isinstance(out.get("bed"), type(None)) and as_flag(out["bed"], True) is False:
            out["bed"] = None
        return cls(**out)

    def check(self) -> RunConfig:
        """Itself, or a ValueError that names all that is missing or contradicts."""
        wrong = [f"{name} is required" for name in ("annotation", "genome") if not getattr(self, name)]
        if not (self.energies or self.counts):
            wrong.append("motifs are required, as energies or counts")
        if self.energies and self.counts:
            wrong.append("motifs are either energies or counts")
        with_signal = self.columns.strip() not in ("", "0")
        if self.scored:
            if not self.bed or not with_signal:
                wrong.append("scores need regions and the column of their activity")
            if self.contacts and self.fractal:
                wrong.append("contacts are either measured or estimated")
            if self.contacts and self.bin_size < 1:
                wrong.append("measured contacts need the size of their bins")
        if self.interactions and not (self.bed and with_signal):
            wrong.append("given interactions need regions and the column of their activity")
        if (self.window is not None and self.window < 1) or self.enhancer_window < 1:
            wrong.append("windows have at least one base")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


@dataclass
class RunResult:
    regions: DataFrame
    interactions: DataFrame | None
    gene_info: DataFrame | None
    gene_tf: DataFrame
    features: DataFrame
    discarded: DataFrame
    gene_tf_vectors: DataFrame
    factors: list[str]
    columns: dict[str, str]
    counts: dict[str, int]


def run_pipeline(spark: SparkSession, config: RunConfig) -> RunResult:
    """All results of a run. What several of them read (sequences, scored pairs, region-gene pairs) is written once."""
    config.check()
    one_tss = genes.five_prime_tss(readers.read_gtf(spark, config.annotation, "gene"))
    keys = readers.read_gene_list(spark, config.gene_list) if config.gene_list else None
    wanted = genes.filter_genes(one_tss, keys) if keys is not None else one_tss

    if config.bed:
        peaks, names = readers.read_bed(spark, config.bed, config.columns)
    else:
        windows = genes.promoter_windows(wanted, config.half)
        peaks = windows.withColumn("peak_id", F.concat("chr", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
        names = {}
    if config.exclude:
        peaks = intervals.exclude_regions(peaks, readers.read_bed(spark, config.exclude)[0])

    if config.genome_index:  # only the bytes of the regions are read
        cut = indexed.extract_indexed(peaks, indexed.read_index(spark, config.genome, config.genome_index))
    else:
        cut = sequence.extract(peaks, readers.read_genome(spark, config.genome))
    counts: dict[str, int] = {}
    seqs, counts["regions with a sequence"] = written_and_counted(sequence.clean(cut), "region-sequences")
    if config.energies:
        matrices = readers.read_energy_matrices(spark, config.energies)
    else:
        gc = config.gc if config.gc is not None else sequence.statistics(seqs).first()["gc"]
        matrices = motifs.to_matrices(motifs.energies(readers.read_transfac(spark, config.counts), gc))
    affinity = motifs.affinities(seqs, matrices)
    regions = peaks.join(seqs.select(F.col("peak_id").alias("__p")), F.col("peak_id") == F.col("__p"), "left_semi")

    sig = signals.unpivot_signals(peaks, list(names)) if names else None
    hits = info = None
    if config.interactions:
        paths = config.interactions if isinstance(config.interactions, dict) else readers.interaction_files(config.interactions, names)
        hits, counts["interactions"] = written_and_counted(readers.read_interactions(spark, paths), "given-interactions")
    elif config.scored:
        hits, info, counts["interactions"] = _scored(spark, config, peaks, sig, list(names), one_tss, keys)

    if hits is not None:
        pairs = written(matrix.interaction_pairs(hits, wanted, regions), "pairs")
        scaled = matrix.interaction_scaler(pairs, sig, hits)
    else:
        pairs = written(matrix.window_pairs(wanted, regions, config.half) if config.bed else matrix.promoter_pairs(wanted, regions, config.half), "pairs")
        scaled = matrix.window_scaler(pairs, sig, config.decay and bool(config.bed))
    scaled = written(scaled, "scaled-pairs")
    factors, lengths = matrix.motif_facts(matrices)
    counts["considered motifs"] = len(factors)
    vectors = written(matrix.gene_tf_vectors(scaled, affinity, lengths), "gene-tf")
    discarded, counts["genes without a region"] = written_and_counted(matrix.discarded_genes(wanted, pairs), "discarded-genes")
    return RunResult(regions, hits, info, matrix.long_form(vectors, factors), matrix.peak_features(scaled), discarded, vectors, factors, names, counts)


def _scored(spark: SparkSession, config: RunConfig, peaks: DataFrame, sig: DataFrame, columns: list[str], one_tss: DataFrame, keys: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
    """Interactions, written once, the summary of genes, and the number of interactions."""
    listed = genes.all_tss(readers.read_gtf(spark, config.annotation, "transcript")) if config.all_tss else one_tss.withColumn("tss", F.array("tss"))
    settings = abc.AbcSettings(config.half, config.enhancer_window // 2, config.bin_size, config.cutoff, config.adapted, config.pseudocount, ordered_max=config.ordered_max, unit_far_pseudocount=config.unit_far_pseudocount, sweep=True)
    tiles = None
    if config.contacts:
        near = [r["chr"] for r in listed.select("chr").distinct().limit(NAMED + 1).collect()]
        tiles = write_tiles(canonical(readers.read_contacts(spark, config.contacts, near if len(near) <= NAMED else None), config.bin_size), config.bin_size)
    if len(columns) >= MANY_COLUMNS and not config.ordered_max:
        hits = abc.score_columns(listed, peaks, columns, settings, tiles, keys)
    else:
        hits = abc.score(listed, peaks, sig, settings, tiles, keys)
    hits, n_hits = written_and_counted(hits, "interactions")
    candidates = sweep.sweep_join(genes.gene_windows(listed, settings.gene_window), peaks, "left_semi")
    named = genes.filter_genes(listed, keys) if keys is not None else listed
    return hits, abc.gene_info(hits, named, columns, candidates, tiles.tiles().select("chr") if tiles else None), n_hits


def run_scores(spark: SparkSession, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """Interactions and gene summaries alone; neither genome nor motifs are read. Without a column the fourth is taken, without contacts they are estimated."""
    config = replace(config, columns="4" if config.columns.strip() in ("", "0") else config.columns, genome=config.genome or "-", counts=config.counts or (None if config.energies else "-"), fractal=config.fractal or not config.contacts, window=config.window or 5_000_000, interactions={})
    config.check()
    peaks, names = readers.read_bed(spark, config.bed, config.columns)
    if config.exclude:
        peaks = intervals.exclude_regions(peaks, readers.read_bed(spark, config.exclude)[0])
    keys = readers.read_gene_list(spark, config.gene_list) if config.gene_list else None
    one_tss = genes.five_prime_tss(readers.read_gtf(spark, config.annotation, "gene"))
    return _scored(spark, config, peaks, signals.unpivot_signals(peaks, list(names)), list(names), one_tss, keys)[:2]


def run_affinities(spark: SparkSession, fasta: str, energies: str) -> DataFrame:
    """(peak_id, affinity) of the sequences of a file, each a record, to a file of energy matrices."""
    seqs = sequence.clean(readers.read_fasta(spark, fasta)).withColumnRenamed("chr", "peak_id")
    return motifs.affinities(seqs, readers.read_energy_matrices(spark, energies))


def run_gene_tf(affinity: DataFrame, matrices: DataFrame, genes_: DataFrame, peaks: DataFrame, names: dict[str, str], half: int = 25_000, decay: bool = True, interactions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gene by factor values, peak features and genes without a region, from affinities of regions and their signals."""
    sig = signals.unpivot_signals(peaks, list(names)) if names else None
    known = peaks.join(affinity.select(F.col("peak_id").alias("__p")), F.col("peak_id") == F.col("__p"), "left_semi")
    pairs = written(matrix.interaction_pairs(interactions, genes_, known) if interactions is not None else matrix.window_pairs(genes_, known, half), "pairs")
    scaled = written(matrix.interaction_scaler(pairs, sig, interactions) if interactions is not None else matrix.window_scaler(pairs, sig, decay), "scaled-pairs")
    return matrix.gene_tf(scaled, affinity, matrices), matrix.peak_features(scaled), matrix.discarded_genes(genes_, pairs)


def run_promoter_windows(spark: SparkSession, annotation: str, window: int = 5000, gene_list: str | None = None) -> DataFrame:
    """Distinct windows of a full width around the genes' 5' starts."""
    one_tss = genes.five_prime_tss(readers.read_gtf(spark, annotation, "gene"))
    return genes.promoter_windows(genes.filter_genes(one_tss, readers.read_gene_list(spark, gene_list)) if gene_list else one_tss, window // 2)


def run_metadata(spark: SparkSession, config: RunConfig, result: RunResult | None = None, columns: dict[str, str] | None = None) -> dict[str, dict]:
    """Sections of a run's metadata: inputs, references, parameters, and counts of regions (lines of the file), motifs and results.

    A run's own counts were taken as its tables were written; only the lines of the region file are counted here.
    """
    part = lambda *names: {n: getattr(config, n) for n in names if getattr(config, n) not in (None, "", {})}
    lines = lambda path, pattern: spark.read.text(path).where(F.col("value").rlike(pattern)).count()
    counts = {"provided regions": lines(config.bed, ".")} if config.bed else {}
    if result is not None:
        counts |= result.counts
    else:
        counts["considered motifs"] = lines(config.energies, "^>") if config.energies else lines(config.counts, r"^\s*//")
    return {
        "Inputs": part("bed", "columns", "exclude", "gene_list", "interactions") | ({"suffixes": ",".join(columns.values())} if columns else {}), "References": part("genome", "annotation", "energies", "counts", "gc"),
        "Parameters": part("window", "cutoff", "contacts", "fractal", "bin_size", "all_tss", "decay", "adapted", "pseudocount", "enhancer_window", "ordered_max", "unit_far_pseudocount"), "Metrics": counts,
    }


def score_metadata(config: RunConfig) -> dict[str, dict]:
    """What a run of scores alone was given, windows as full widths."""
    return {"Scores": {f.name: getattr(config, f.name) for f in fields(config) if f.name in ("bed", "columns", "annotation", "gene_list", "window", "contacts", "bin_size", "cutoff", "exclude", "pseudocount", "all_tss", "adapted", "enhancer_window")}}
