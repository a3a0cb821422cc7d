"""One query for each operator over views of the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.stages import numbered, shared_folder, written
from ..operators import abc, contacts, genes, intervals, matrix, motifs, sequence, signals, sweep, tiles
from ..sinks import store, writers
from ..sources import indexed, readers
from . import pipeline
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HALF = 2500
#: Scores are often exact fractions that end in 5 (3/128): a little is added, so that the last bit of a sum does not decide how they round.
_OFF_TIES = 1e-10
#: Small slots, so that these tables already take many.
SLOT_ROWS = 500
SETTINGS = abc.AbcSettings(gene_window=HALF, enhancer_window=HALF, bin_size=V.BIN, cutoff=0.02, join_width=5000)


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# -- genes and columns ------------------------------------------------------------------------


@query(_with(V.GENES_CTE) + "SELECT gene_id, chr, tss FROM genes")
def strand_tss(spark, d):
    return V.genes(spark, d).select("gene_id", "chr", "tss")


_MERGED = """rows2 AS (SELECT ord, gene_name AS gid, chr, strand, tss FROM genes),
first AS (SELECT gid, arg_min(chr, ord) AS chr FROM rows2 GROUP BY gid),
five AS (SELECT f.gid AS gene_id, f.chr, CASE WHEN arg_max(strand, ord) = '+' THEN min(tss) ELSE max(tss) END AS tss FROM first f JOIN rows2 r ON f.gid = r.gid AND f.chr = r.chr GROUP BY f.gid, f.chr)"""


@query(_with(V.GENES_CTE, _MERGED) + "SELECT gene_id, chr, tss FROM five")
def tss_five_prime(spark, d):
    merged = V.genes(spark, d).withColumn("gene_id", F.col("gene_name"))
    return genes.five_prime_tss(merged).select("gene_id", "chr", "tss")


@query(_with(V.TRANSCRIPTS_CTE) + "SELECT gene_id, chr, count(*) AS n_tss, min(tss) AS low, max(tss) AS high, string_agg(CAST(tss AS VARCHAR), ',' ORDER BY ord) AS tss FROM transcripts GROUP BY gene_id, chr")
def tss_all(spark, d):
    t = genes.all_tss(V.transcripts(spark, d))
    return t.select("gene_id", "chr", F.size("tss").cast("long").alias("n_tss"), F.array_min("tss").alias("low"), F.array_max("tss").alias("high"), F.array_join(F.transform("tss", lambda x: x.cast("string")), ",").alias("tss"))


@query(_with(V.GENES_CTE) + "SELECT gene_id, gene_name FROM genes WHERE gene_name = 'BUILDING' OR ord IN (SELECT doc_id FROM labels)")
def gene_filter(spark, d):
    ids = V.read(spark, d, "labels").select(F.concat(F.lit("Customer#"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("key"))
    return genes.filter_genes(V.genes(spark, d), ids.union(spark.createDataFrame([("BUILDING",)], "key string"))).select("gene_id", "gene_name")


@query(_with(V.GENES_CTE) + "SELECT DISTINCT chr, greatest(0, tss - 2501) AS wstart, tss + 2500 AS wend FROM genes")
def promoter_windows(spark, d):
    return genes.promoter_windows(V.genes(spark, d), HALF).select("chr", F.col("start").alias("wstart"), F.col("end").alias("wend"))


@query(_with(V.TRANSCRIPTS_CTE) + "SELECT gene_id, greatest(0, min(tss) - 2501) AS wstart, max(tss) + 2500 AS wend FROM transcripts GROUP BY gene_id")
def gene_hull_windows(spark, d):
    return genes.gene_windows(genes.all_tss(V.transcripts(spark, d)), HALF).select("gene_id", F.col("start").alias("wstart"), F.col("end").alias("wend"))


@query(_with(V.PEAKS_CTE) + "SELECT peak_id, chr, s AS pstart, e AS pend FROM peaks")
def peak_id_roundtrip(spark, d):
    p = V.peaks(spark, d).select("peak_id")
    return p.select("peak_id", *X.parse_peak_id("peak_id")).select("peak_id", "chr", F.col("start").alias("pstart"), F.col("end").alias("pend"))


@query("SELECT p_partkey AS k, CAST(p_partkey % 5 AS VARCHAR) AS chr FROM part")
def chr_normalise(spark, d):
    named = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("chr"), (F.col("p_partkey") % 5).cast("string"))).otherwise((F.col("p_partkey") % 5).cast("string"))
    return V.read(spark, d, "part").select(F.col("p_partkey").alias("k"), X.strip_chr(named).alias("chr"))


@query("SELECT c_name AS gene_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS gene_name FROM customer")
def attr_extract(spark, d):
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(' gene_name "'), F.col("c_mktsegment"), F.lit('";')))
    attrs = V.read(spark, d, "customer").select(F.concat(F.lit('gene_id "'), F.col("c_name"), F.lit('";'), name).alias("a"))
    gid = X.gtf_attribute("a", "gene_id")
    return attrs.select(gid.alias("gene_id"), X.gene_symbol(X.gtf_attribute("a", "gene_name"), gid).alias("gene_name"))


@query(_with(V.PEAKS_CTE) + "SELECT peak_id, 'sig1' AS col, sig1 AS signal FROM peaks UNION ALL SELECT peak_id, 'sig2', sig2 FROM peaks")
def signal_unpivot(spark, d):
    return signals.unpivot_signals(V.peaks(spark, d), ["sig1", "sig2"]).select("peak_id", F.col("column").alias("col"), "signal")


@query(_with(V.PEAKS_CTE) + "SELECT chr, count(*) AS n, count(DISTINCT peak_id) AS n_distinct FROM (SELECT * FROM peaks UNION ALL SELECT * FROM peaks) GROUP BY chr")
def region_distinct(spark, d):
    p = V.peaks(spark, d)
    twice = p.union(p)
    n = twice.groupBy("chr").count().select(F.col("chr").alias("c"), F.col("count").alias("n"))
    return twice.dropDuplicates().groupBy("chr").agg(F.count("*").alias("n_distinct")).join(n, F.col("chr") == F.col("c")).select("chr", "n", "n_distinct")


# -- interval joins ---------------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT g.gene_id, g.tss, p.* FROM genes g JOIN peaks p ON g.chr = p.chr AND greatest(0, g.tss - 2501) < p.e AND p.s < g.tss + 2500)"
_DISTANCE = "CASE WHEN s < tss AND tss < e THEN 0 ELSE least(abs(tss - 1 - s), abs(tss - e)) END"


def _windows(spark, d):
    return genes.gene_windows(V.genes(spark, d).select("gene_id", "chr", "tss"), HALF)


@query(_with(V.PEAKS_CTE, V.GENES_CTE, _PAIRS) + "SELECT gene_id, peak_id FROM pairs")
def overlap_inner(spark, d):
    return intervals.overlap_join(_windows(spark, d), V.peaks(spark, d), "inner", None).select("gene_id", F.col("r_peak_id").alias("peak_id"))


@query(SQL["overlap_inner"])
def overlap_binned(spark, d):
    return intervals.overlap_join(_windows(spark, d), V.peaks(spark, d), "inner", 5000).select("gene_id", F.col("r_peak_id").alias("peak_id"))


@query(_with(V.PEAKS_CTE, V.EXCLUDED_CTE) + "SELECT peak_id FROM peaks p WHERE EXISTS (SELECT 1 FROM excluded x WHERE x.chr = p.chr AND x.s < p.e AND p.s < x.e)")
def overlap_semi(spark, d):
    return intervals.overlap_join(V.peaks(spark, d), V.excluded(spark, d), "left_semi").select("peak_id")


@query(_with(V.PEAKS_CTE, V.EXCLUDED_CTE) + "SELECT peak_id FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.chr = p.chr AND x.s < p.e AND p.s < x.e)")
def overlap_anti(spark, d):
    return intervals.exclude_regions(V.peaks(spark, d), V.excluded(spark, d)).select("peak_id")


@query(SQL["overlap_inner"])
def overlap_sweep(spark, d):
    return sweep.sweep_join(_windows(spark, d), V.peaks(spark, d), slot_rows=SLOT_ROWS).select("gene_id", F.col("r_peak_id").alias("peak_id"))


@query(SQL["overlap_semi"])
def overlap_sweep_semi(spark, d):
    return sweep.sweep_join(V.peaks(spark, d), V.excluded(spark, d), "left_semi", slot_rows=SLOT_ROWS).select("peak_id")


@query(SQL["overlap_anti"])
def overlap_sweep_anti(spark, d):
    return sweep.sweep_join(V.peaks(spark, d), V.excluded(spark, d), "left_anti", slot_rows=SLOT_ROWS).select("peak_id")


#: Windows from 200 bases to 20,000, by the gene's number.
_UNEVEN = "greatest(0, g.tss - 100 * (1 + g.ord % 100)) < p.e AND p.s < g.tss + 100 * (1 + g.ord % 100)"


@query(_with(V.PEAKS_CTE, V.GENES_CTE) + f"SELECT g.gene_id, p.peak_id FROM genes g JOIN peaks p ON g.chr = p.chr AND {_UNEVEN}")
def overlap_uneven(spark, d):
    """Windows of very different widths, by sweep."""
    half = (F.col("ord") % 100 + 1) * 100
    g = V.genes(spark, d).select("gene_id", "chr", F.greatest(F.lit(0), F.col("tss") - half).alias("start"), (F.col("tss") + half).alias("end"))
    return sweep.sweep_join(g, V.peaks(spark, d), slot_rows=SLOT_ROWS).select("gene_id", F.col("r_peak_id").alias("peak_id"))


@query(_with(V.GENES_CTE) + "SELECT g.gene_id, greatest(0, g.tss - 2501) AS wstart, h.gene_id AS other FROM genes g JOIN genes h ON g.chr = h.chr AND greatest(0, g.tss - 2501) = greatest(0, h.tss - 2501) AND g.tss = h.tss")
def overlap_reciprocal(spark, d):
    w = _windows(spark, d)
    return intervals.equal_join(w, w).select("gene_id", F.col("start").alias("wstart"), F.col("r_gene_id").alias("other"))


@query(_with(V.PEAKS_CTE, V.GENES_CTE, _PAIRS) + f"SELECT gene_id, peak_id, {_DISTANCE} AS distance FROM pairs")
def tss_distance(spark, d):
    return matrix.window_pairs(V.genes(spark, d), V.peaks(spark, d), HALF).select("gene_id", "peak_id", "distance")


@query(_with(V.PEAKS_CTE, V.GENES_CTE, _PAIRS) + f"SELECT gene_id, peak_id, round(exp(-({_DISTANCE}) / 5000.0), 6) AS weight FROM pairs")
def distance_decay(spark, d):
    return matrix.window_pairs(V.genes(spark, d), V.peaks(spark, d), HALF).select("gene_id", "peak_id", r(X.distance_decay("distance")).alias("weight"))


@query(_with(V.PEAKS_CTE, V.GENES_CTE, "pairs AS (SELECT g.gene_id, g.tss, p.* FROM genes g JOIN peaks p ON g.chr = p.chr AND greatest(0, g.tss - 10001) < p.e AND p.s < g.tss + 10000)") + f"SELECT gene_id, peak_id, round(1.0 / greatest({_DISTANCE}, 5000), 9) AS contact FROM pairs")
def fractal_contact(spark, d):
    return matrix.window_pairs(V.genes(spark, d), V.peaks(spark, d), 10_000).select("gene_id", "peak_id", r(X.fractal_contact("distance"), 9).alias("contact"))


@query(_with(V.PEAKS_CTE, V.GENES_CTE, _PAIRS) + f"SELECT gene_id, count(*) AS n, round(sum(sig1 * exp(-({_DISTANCE}) / 5000.0)), 4) AS activity FROM pairs GROUP BY gene_id")
def gene_activity(spark, d):
    from ..streaming.regions import gene_activity as run

    regions = V.peaks(spark, d).select("chr", "start", "end", F.col("sig1").alias("signal"))
    return run(regions, V.genes(spark, d), HALF).select("gene_id", F.col("n_regions").alias("n"), r("activity", 4).alias("activity"))


# -- sequences and motifs ---------------------------------------------------------------------


@query("SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', 'N', 'g') AS seq FROM documents")
def seq_clean(spark, d):
    return sequence.clean(V.read(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("seq")))


@query(_with(V.CONTIGS_CTE) + "SELECT CAST(max(length(seq)) AS BIGINT) AS max_len, round(sum(length(regexp_replace(seq, '[^CG]', '', 'g'))) / sum(length(regexp_replace(seq, '[^ACGT]', '', 'g'))), 6) AS gc FROM contigs")
def gc_content(spark, d):
    return sequence.statistics(V.contigs(spark, d)).select("max_len", r("gc").alias("gc"))


@query(_with(V.CONTIGS_CTE) + "SELECT chr, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM contigs")
def revcomp(spark, d):
    return V.contigs(spark, d).select("chr", X.reverse_complement("seq").alias("seq"))


@query(_with(V.CONTIGS_CTE, "cut AS (SELECT chr, seq, unnest([(CAST(chr AS BIGINT) * 7) % 90, CAST(length(seq) // 2 AS BIGINT), CAST(length(seq) AS BIGINT) - 100]) AS s FROM contigs)") + "SELECT DISTINCT chr, s, seq[s + 1:s + 100] AS part FROM cut WHERE s >= 0 AND s + 100 <= length(seq)")
def sequence_extract(spark, d):
    genome = V.contigs(spark, d)
    n = F.length("seq").cast("long")
    starts = F.array((F.col("chr").cast("long") * 7) % 90, F.floor(n / 2), n - 100)
    regions = genome.select("chr", F.explode(starts).alias("start")).where("start >= 0").distinct()
    regions = regions.select(X.peak_id("chr", "start", F.col("start") + 100).alias("peak_id"), "chr", "start", (F.col("start") + 100).alias("end"))
    return sequence.extract(regions, sequence.chunk_genome(genome, 64), 64).select("chr", F.col("start").alias("s"), F.col("seq").alias("part"))


@query(_with(V.CONTIGS_CTE) + "SELECT chr, CAST(k AS BIGINT) AS chunk, CAST(length(seq) AS BIGINT) AS length, seq[k * 1000 + 1:k * 1000 + 1000] AS part FROM (SELECT chr, seq, unnest(range(0, (length(seq) + 999) // 1000)) AS k FROM contigs WHERE length(seq) > 0)")
def genome_chunks(spark, d):
    return readers.read_genome(spark, V.genome_file(spark, d), 1000)


@query(_with(V.SEQUENCES_CTE) + "SELECT peak_id, seq FROM seqs WHERE length(seq) > 1")
def fasta_records(spark, d):
    lines = V.sequences(spark, d).select(F.concat(F.lit(">"), F.col("peak_id"), F.lit("\n"), F.col("seq")).alias("value"))
    return readers.read_fasta(spark, V.text_folder(lines, "records")).select(F.col("chr").alias("peak_id"), "seq")


@query(SQL["sequence_extract"])
def sequence_by_index(spark, d):
    """Regions read by their bytes, from the files' indexes."""
    path = V.genome_file(spark, d)
    genome = V.contigs(spark, d)
    n = F.length("seq").cast("long")
    regions = genome.select("chr", F.explode(F.array((F.col("chr").cast("long") * 7) % 90, F.floor(n / 2), n - 100)).alias("start")).where("start >= 0").distinct()
    regions = regions.select(X.peak_id("chr", "start", F.col("start") + 100).alias("peak_id"), "chr", "start", (F.col("start") + 100).alias("end"))
    files = [f"{path}/{name}" for name in store.names(path) if name.startswith("part-")]
    return indexed.extract_indexed(regions, written(indexed.index_genome(spark, files), "genome-index")).select("chr", F.col("start").alias("s"), F.col("seq").alias("part"))


_ENERGY = """counts AS (SELECT motif_ord, pos, a + 1 AS a, c + 1 AS c, g + 1 AS g, t + 1 AS t FROM crows),
tops AS (SELECT *, greatest(a, t) AS m_at, greatest(c, g) AS m_cg FROM counts)"""


def _energy_sql(own: str, other: str, x: str, bg: str) -> str:
    return f"round((ln(greatest(m_at, m_cg) / {x}) + CASE WHEN {own} < {other} THEN {bg} ELSE 0 END) / 0.7, 6)"


_AT, _CG = "ln(((1 - 0.41) / 2) / (0.41 / 2))", "ln((0.41 / 2) / ((1 - 0.41) / 2))"


@query(_with(V.COUNTS_CTE, _ENERGY) + f"SELECT motif_ord, CAST(pos AS INTEGER) AS pos, {_energy_sql('m_at', 'm_cg', 'a', _AT)} AS a, {_energy_sql('m_cg', 'm_at', 'c', _CG)} AS c, {_energy_sql('m_cg', 'm_at', 'g', _CG)} AS g, {_energy_sql('m_at', 'm_cg', 't', _AT)} AS t, round(16 * 0.584 - 5.66, 6) AS lnr0 FROM tops")
def pscm_to_psem(spark, d):
    e = motifs.energies(V.count_rows(spark, d))
    return e.select("motif_ord", "pos", *[r(b).alias(b) for b in "acgt"], r(motifs.ln_r0(F.lit(16.0))).alias("lnr0"))


def _matrices(spark, d):
    return motifs.to_matrices(V.motif_rows(spark, d))


_AFFINITY = """sites AS (SELECT peak_id, i, seq[i:i + 15] AS site FROM (SELECT peak_id, seq, unnest(range(1, length(seq) - 14)) AS i FROM seqs WHERE length(seq) >= 16) WHERE NOT regexp_matches(seq[i:i + 15], '[^ACGT]')),
bases AS (SELECT peak_id, i, p, site[p + 1] AS b FROM sites, range(16) x(p)),
sums AS (SELECT peak_id, i, m.motif_ord, sum(CASE b WHEN 'A' THEN m.a WHEN 'C' THEN m.c WHEN 'G' THEN m.g ELSE m.t END) AS f, sum(CASE b WHEN 'A' THEN w.t WHEN 'C' THEN w.g WHEN 'G' THEN w.c ELSE w.a END) AS rv
  FROM bases JOIN mrows m ON m.pos = p JOIN mrows w ON w.motif_ord = m.motif_ord AND w.pos = 15 - p GROUP BY peak_id, i, m.motif_ord),
occ AS (SELECT peak_id, motif_ord, 1 / (1 + exp(f - (16 * 0.584 - 5.66))) AS pf, 1 / (1 + exp(rv - (16 * 0.584 - 5.66))) AS pr FROM sums),
aff AS (SELECT s.peak_id, t.motif_ord, coalesce(sum(pf + (1 - pf) * pr), 0) AS x FROM seqs s CROSS JOIN (SELECT DISTINCT motif_ord FROM mrows) t LEFT JOIN occ o ON o.peak_id = s.peak_id AND o.motif_ord = t.motif_ord GROUP BY s.peak_id, t.motif_ord)"""


@query(_with(V.SEQUENCES_CTE, V.MOTIFS_CTE, _AFFINITY) + "SELECT peak_id, 'TF' || motif_ord AS tf, round(x, 6) AS affinity FROM aff")
def motif_affinity(spark, d):
    m = _matrices(spark, d)
    return motifs.affinity_long(motifs.affinities(V.sequences(spark, d), m), m).select("peak_id", "tf", r("affinity").alias("affinity"))


@query(_with(V.SEQUENCES_CTE, V.MOTIFS_CTE, _AFFINITY) + "SELECT peak_id, 'TF' || motif_ord AS tf, round(x, 6) AS affinity FROM aff")
def motif_affinity_reverse(spark, d):
    m = motifs.reverse_complement(_matrices(spark, d))
    return motifs.affinity_long(motifs.affinities(V.sequences(spark, d), m), m).select("peak_id", "tf", r("affinity").alias("affinity"))


@query(_with(V.MASKED_CTE, V.MOTIFS_CTE, _AFFINITY) + "SELECT peak_id, 'TF' || motif_ord AS tf, round(x, 6) AS affinity FROM aff")
def motif_affinity_masked(spark, d):
    """Sequences with unknown bases: sites that hold one do not count."""
    m = _matrices(spark, d)
    return motifs.affinity_long(motifs.affinities(V.masked_sequences(spark, d), m), m).select("peak_id", "tf", r("affinity").alias("affinity"))


@query(_with(V.MASKED_CTE) + "SELECT CAST(max(length(seq)) AS BIGINT) AS max_len, round(sum(length(regexp_replace(seq, '[^CG]', '', 'g'))) / sum(length(regexp_replace(seq, '[^ACGT]', '', 'g'))), 6) AS gc FROM seqs")
def gc_content_masked(spark, d):
    """Unknown bases count in lengths, not in the share of C and G."""
    return sequence.statistics(V.masked_sequences(spark, d)).select("max_len", r("gc").alias("gc"))


# -- contacts ---------------------------------------------------------------------------------


def _cells(spark, d):
    return contacts.canonical(V.raw_contacts(spark, d), V.BIN)


_SPAN = "span AS (SELECT chr, min(bin1) AS lo, max(bin2) AS hi FROM cells GROUP BY chr)"
_PROFILE = "prof AS (SELECT c.chr, bin2 - bin1 AS d, sum(contact) AS total, any_value(hi - lo) - (bin2 - bin1) AS possible FROM cells c JOIN span USING (chr) WHERE bin2 - bin1 >= 1 AND (bin2 - bin1) * 1000 < 1000000 GROUP BY c.chr, bin2 - bin1)"
_FIT = "fit AS (SELECT chr, CASE WHEN min(possible) > 0 AND count(*) > 1 THEN regr_slope(ln(total / possible), ln(d * 1000)) END AS slope, CASE WHEN min(possible) > 0 AND count(*) > 1 THEN regr_intercept(ln(total / possible), ln(d * 1000)) END AS intercept FROM prof WHERE total > 0 GROUP BY chr)"
_FINAL = """offd AS (SELECT * FROM cells WHERE bin1 <> bin2),
diag AS (SELECT chr, b AS bin1, b AS bin2, max(contact) AS contact FROM (SELECT chr, bin1 AS b, contact FROM offd WHERE bin2 = bin1 + 1 UNION ALL SELECT chr, bin2, contact FROM offd WHERE bin2 = bin1 + 1) GROUP BY chr, b),
mat AS (SELECT * FROM offd UNION ALL SELECT * FROM diag)"""


@query(_with(V.CELLS_CTE) + "SELECT chr, bin1, bin2, contact FROM cells")
def contact_canonical(spark, d):
    return _cells(spark, d)


@query(_with(V.CELLS_CTE, _SPAN, _PROFILE) + "SELECT chr, d, total, round(CASE WHEN possible > 0 THEN total / possible END, 6) AS mean FROM prof")
def contact_profile(spark, d):
    return contacts.distance_profile(_cells(spark, d), V.BIN).select("chr", "d", "total", r("mean").alias("mean"))


@query(_with(V.CELLS_CTE, _SPAN, _PROFILE, _FIT) + "SELECT chr, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit")
def contact_fit(spark, d):
    return contacts.power_law(_cells(spark, d), V.BIN).select("chr", r("slope").alias("slope"), r("intercept").alias("intercept"))


@query(_with(V.CELLS_CTE, _FINAL) + "SELECT chr, bin1, bin2, contact FROM mat")
def contact_diagonal(spark, d):
    return contacts.with_diagonal(_cells(spark, d))


@query(_with(V.CELLS_CTE, V.PEAKS_CTE, _FINAL, "q AS (SELECT peak_id, chr, CAST(floor(s / 1000) AS BIGINT) AS b1, CAST(floor((s + 9000) / 1000) AS BIGINT) AS b2 FROM peaks)") + "SELECT peak_id, coalesce(contact, 0) AS contact FROM q LEFT JOIN mat ON q.chr = mat.chr AND least(b1, b2) = bin1 AND greatest(b1, b2) = bin2")
def contact_lookup(spark, d):
    q = V.peaks(spark, d).select("peak_id", "chr", X.bin_of("start", V.BIN).alias("b1"), X.bin_of(F.col("start") + 9000, V.BIN).alias("b2"))
    return contacts.lookup(q, contacts.with_diagonal(_cells(spark, d)), "b2", "b1").select("peak_id", "contact")


def _tiles(spark, d):
    """Small tiles and stripes, so that these tables already take many."""
    return tiles.write_tiles(_cells(spark, d), V.BIN, side=8, stripe=2)


@query(SQL["contact_diagonal"])
def contact_tiles(spark, d):
    return _tiles(spark, d).cells()


@query(SQL["contact_lookup"])
def contact_tiles_lookup(spark, d):
    q = V.peaks(spark, d).select("peak_id", "chr", X.bin_of("start", V.BIN).alias("b1"), X.bin_of(F.col("start") + 9000, V.BIN).alias("b2"))
    return tiles.lookup_tiles(q, _tiles(spark, d), "b2", "b1").select("peak_id", "contact")


@query(SQL["contact_fit"])
def contact_tiles_fit(spark, d):
    return _tiles(spark, d).fit().select("chr", r("slope").alias("slope"), r("intercept").alias("intercept"))


@query(_with(V.CELLS_CTE) + "SELECT chr, bin1, bin2, contact FROM cells WHERE chr IN ('1', '3')")
def contact_files_pruned(spark, d):
    """Only the files of two chromosomes are opened."""
    return contacts.last_cells(contacts.canonical(readers.read_contacts(spark, V.contact_folder(spark, d), ["1", "3"]), V.BIN))


# -- activity by contact ----------------------------------------------------------------------

_TSS_ALL = "tssall AS (SELECT gene_id, any_value(gene_name) AS gene_name, chr, list(tss ORDER BY ord) AS tl, min(tss) AS lo, max(tss) AS hi, count(*) AS n FROM transcripts GROUP BY gene_id, chr)"
_TSS_ONE = "tssall AS (SELECT gene_id, gene_name, chr, [tss] AS tl, tss AS lo, tss AS hi, 1 AS n FROM genes)"


def _dist(t: str) -> str:
    return f"CASE WHEN s < {t} AND {t} < e THEN 0 ELSE least(abs({t} - 1 - s), abs({t} - e)) END"


def _pairs_sql(measured: bool) -> str:
    hull = f"hull AS (SELECT g.gene_id, g.chr, g.tl, g.n, p.peak_id, p.s, p.e, least({_dist('lo')}, {_dist('hi')}) <= 2500 AS near FROM tssall g JOIN peaks p ON g.chr = p.chr AND greatest(0, lo - 2501) < p.e AND p.s < hi + 2500)"
    rows = f"rows1 AS (SELECT *, tl[k] AS t FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM hull) WHERE near OR k = 1), rows2 AS (SELECT *, {_dist('t')} AS dist, CAST(floor(t / 1000) AS BIGINT) AS gb, CAST(floor(floor((s + e) / 2) / 1000) AS BIGINT) AS pb FROM rows1)"
    if not measured:
        return f"{hull}, {rows}, con AS (SELECT *, 1.0 / greatest(dist, 5000) AS c FROM rows2)"
    last = "lastb AS (SELECT chr, CAST(floor((max(hi) + 2500) / 1000) AS BIGINT) AS lb FROM tssall GROUP BY chr)"
    pseudo = "coalesce(CASE WHEN abs(gb - pb) * 1000 > 1000000 THEN exp(slope * ln(abs(gb - pb) * 1000) + intercept) ELSE exp(slope * ln(1000000) + intercept) END, 0)"
    return f"{hull}, {rows}, {last}, con AS (SELECT r.*, {pseudo} + CASE WHEN pb <= lb THEN coalesce(m.contact, 0) ELSE 0 END AS c FROM rows2 r JOIN lastb USING (chr) LEFT JOIN fit ON fit.chr = r.chr LEFT JOIN mat m ON m.chr = r.chr AND m.bin1 = least(gb, pb) AND m.bin2 = greatest(gb, pb))"


def _score_sql(adapted: bool) -> str:
    act = "sig * CASE WHEN csum = 0 THEN NULL ELSE c / csum END" if adapted else "sig"
    inter = "act / n" if adapted else "(c / n) / chr_max * sig"
    activity = "act / n" if adapted else "sig * 100 / s_max"
    return f"""summed AS (SELECT *, sum(c) OVER (PARTITION BY chr, peak_id) AS csum FROM con),
nearp AS (SELECT * FROM summed WHERE near), chrmax AS (SELECT chr, max(c) AS chr_max FROM nearp GROUP BY chr),
sigs AS (SELECT peak_id, 'sig1' AS col, CAST(CAST(sig1 AS FLOAT) AS DOUBLE) AS sig FROM peaks UNION ALL SELECT peak_id, 'sig2', CAST(CAST(sig2 AS FLOAT) AS DOUBLE) FROM peaks),
act AS (SELECT *, {act} AS a FROM nearp JOIN sigs USING (peak_id)),
bp AS (SELECT col, chr, gene_id, peak_id, s, e, n, sig, sum(c) AS c, sum(a) AS act, sum(a * c) AS ac, sum(dist) AS dist, bool_or(a IS NULL) AS undef FROM act GROUP BY ALL),
tot AS (SELECT *, sum(ac) OVER w AS total, max(c / n) OVER w AS c_max, max(sig) OVER w AS s_max, bool_or(undef) OVER w AS gu FROM bp WINDOW w AS (PARTITION BY col, gene_id)),
hits AS (SELECT col, tot.chr, gene_id, peak_id, sig, c / n AS contact, {activity} AS activity, CASE WHEN c_max = 0 THEN 0 ELSE c / n * 100.0 / c_max END AS scaled_contact, {inter} AS intergenic, dist / n AS tss_dist, ac / total AS score
  FROM tot JOIN chrmax ON chrmax.chr = tot.chr WHERE NOT gu AND act / n > 0 AND total <> 0 AND ac / total >= CAST(CAST(0.02 AS FLOAT) AS DOUBLE))"""


def _abc_sql(adapted: bool, all_tss: bool, measured: bool) -> str:
    base = [V.PEAKS_CTE, V.TRANSCRIPTS_CTE if all_tss else V.GENES_CTE, _TSS_ALL if all_tss else _TSS_ONE]
    if measured:
        base += [V.CELLS_CTE, _SPAN, _PROFILE, _FIT, _FINAL]
    return _with(*base, _pairs_sql(measured), _score_sql(adapted))


_ABC_OUT = "SELECT col, gene_id, peak_id, round(contact, 6) AS contact, round(activity, 6) AS activity, round(scaled_contact, 6) AS scaled_contact, round(intergenic, 6) AS intergenic, round(tss_dist, 4) AS tss_dist, round(score, 6) AS score FROM hits"


def _abc(spark, d, adapted: bool, all_tss: bool, measured: bool) -> DataFrame:
    g = genes.all_tss(V.transcripts(spark, d)) if all_tss else V.genes(spark, d).withColumn("tss", F.array("tss"))
    settings = abc.AbcSettings(**(SETTINGS.__dict__ | {"adapted": adapted}))
    p = V.peaks(spark, d)
    return abc.score(g, p, signals.unpivot_signals(p, ["sig1", "sig2"]), settings, _cells(spark, d) if measured else None)


def _abc_out(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("column").alias("col"), "gene_id", "peak_id", r("contact").alias("contact"), r("activity").alias("activity"), r("scaled_contact").alias("scaled_contact"), r("intergenic_score").alias("intergenic"), r("tss_distance", 4).alias("tss_dist"), r("abc_score").alias("score"))


@query(_abc_sql(True, False, True) + _ABC_OUT)
def abc_adapted(spark, d):
    return _abc_out(_abc(spark, d, True, False, True))


@query(_abc_sql(False, False, True) + _ABC_OUT)
def abc_original(spark, d):
    return _abc_out(_abc(spark, d, False, False, True))


@query(_abc_sql(True, True, True) + _ABC_OUT)
def abc_all_tss(spark, d):
    return _abc_out(_abc(spark, d, True, True, True))


@query(_abc_sql(True, True, False) + _ABC_OUT)
def abc_fractal(spark, d):
    return _abc_out(_abc(spark, d, True, True, False))


@query(_abc_sql(True, False, True) + "SELECT col, count(*) AS n, count(DISTINCT gene_id) AS n_genes FROM hits GROUP BY col")
def abc_cutoff(spark, d):
    return _abc(spark, d, True, False, True).groupBy(F.col("column").alias("col")).agg(F.count("*").alias("n"), F.countDistinct("gene_id").alias("n_genes"))


@query(_abc_sql(True, True, True) + "SELECT chr, peak_id, round(sum(c), 4) AS contact_sum FROM con GROUP BY chr, peak_id")
def peak_contact_sum(spark, d):
    g = genes.all_tss(V.transcripts(spark, d))
    return abc.peak_contact_sums(abc.pair_contacts(g, V.peaks(spark, d), SETTINGS, _cells(spark, d))).select("chr", "peak_id", r("contact_sum", 4).alias("contact_sum"))


@query(_abc_sql(True, False, True) + _ABC_OUT)
def abc_sweep(spark, d):
    """Windows met by sweep instead of bins."""
    p, settings = V.peaks(spark, d), abc.AbcSettings(**(SETTINGS.__dict__ | {"sweep": True}))
    return _abc_out(abc.score(V.genes(spark, d).withColumn("tss", F.array("tss")), p, signals.unpivot_signals(p, ["sig1", "sig2"]), settings, _cells(spark, d)))


@query(_abc_sql(True, True, True) + _ABC_OUT)
def abc_tiled(spark, d):
    """Contacts looked up in tiles, windows met by sweep."""
    p, settings = V.peaks(spark, d), abc.AbcSettings(**(SETTINGS.__dict__ | {"sweep": True}))
    return _abc_out(abc.score(genes.all_tss(V.transcripts(spark, d)), p, signals.unpivot_signals(p, ["sig1", "sig2"]), settings, _tiles(spark, d)))


#: Fifty activities of a region, from its two.
_MANY = 50
_MANY_SIGS = f"sigs AS (SELECT peak_id, 'a' || k AS col, CAST(CAST((sig1 * k) % 53 + sig2 / k AS FLOAT) AS DOUBLE) AS sig FROM peaks, range(1, {_MANY + 1}) x(k))"


def _many_sql(adapted: bool) -> str:
    sql = _abc_sql(adapted, False, True)
    i = sql.index("sigs AS (")
    return sql[:i] + _MANY_SIGS + sql[sql.index(",\nact AS", i) :] + f"SELECT col, gene_id, peak_id, round(contact + {_OFF_TIES}, 6) AS contact, round(activity + {_OFF_TIES}, 6) AS activity, round(scaled_contact + {_OFF_TIES}, 6) AS scaled_contact, round(intergenic + {_OFF_TIES}, 6) AS intergenic, round(score + {_OFF_TIES}, 6) AS score FROM hits"


def _many(spark, d, adapted: bool) -> DataFrame:
    """Activity columns as one array a region."""
    names = [f"a{k}" for k in range(1, _MANY + 1)]
    p = V.peaks(spark, d).select("*", *[((F.col("sig1") * k) % 53 + F.col("sig2") / k).alias(f"a{k}") for k in range(1, _MANY + 1)])
    settings = abc.AbcSettings(**(SETTINGS.__dict__ | {"adapted": adapted}))
    hits = abc.score_columns(V.genes(spark, d).withColumn("tss", F.array("tss")), p, names, settings, _cells(spark, d))
    off = lambda c: F.rint((F.col(c) + _OFF_TIES) * 1e6) / 1e6  # noqa: E731 - off ties as F.round, without a decimal number for each of them
    return hits.select(F.col("column").alias("col"), "gene_id", "peak_id", off("contact").alias("contact"), off("activity").alias("activity"), off("scaled_contact").alias("scaled_contact"), off("intergenic_score").alias("intergenic"), off("abc_score").alias("score"))


@query(_many_sql(True))
def abc_many_columns(spark, d):
    return _many(spark, d, True)


@query(_many_sql(False))
def abc_many_columns_original(spark, d):
    return _many(spark, d, False)


_INFO = """, stats AS (SELECT col, gene_id, count(*) AS n, avg(activity) AS a, avg(contact) AS c, avg(tss_dist) AS dist FROM hits GROUP BY col, gene_id),
cand AS (SELECT DISTINCT gene_id FROM hull),
info AS (SELECT k.col, g.gene_id, g.chr, coalesce(s.n, 0) AS n_enhancer, round(coalesce(a, 0), 6) AS avg_activity, round(coalesce(c, 0), 6) AS avg_contact, round(coalesce(dist, 0), 4) AS avg_distance,
  CASE WHEN s.n IS NOT NULL THEN '-' WHEN g.chr NOT IN (SELECT chr FROM cells) THEN 'Missing normalized contact file' WHEN g.gene_id NOT IN (SELECT gene_id FROM cand) THEN 'No candidate regions in gene window' ELSE 'Score of candidate regions too low' END AS failure
  FROM tssall g CROSS JOIN (SELECT unnest(['sig1', 'sig2']) AS col) k LEFT JOIN stats s ON s.col = k.col AND s.gene_id = g.gene_id)
"""


def _info(spark, d):
    g = V.genes(spark, d).withColumn("tss", F.array("tss"))
    cand = intervals.overlap_join(genes.gene_windows(g, HALF), V.peaks(spark, d), "inner")
    return abc.gene_info(_abc(spark, d, True, False, True), g, ["sig1", "sig2"], cand, _cells(spark, d).select("chr"))


@query(_abc_sql(True, False, True) + _INFO + "SELECT col, gene_id, chr, n_enhancer, avg_activity, avg_contact, avg_distance FROM info")
def gene_info(spark, d):
    return _info(spark, d).select(F.col("column").alias("col"), "gene_id", "chr", "n_enhancer", r("avg_activity").alias("avg_activity"), r("avg_contact").alias("avg_contact"), r("avg_distance", 4).alias("avg_distance"))


@query(_abc_sql(True, False, True) + _INFO + "SELECT col, failure, count(*) AS n FROM info GROUP BY col, failure")
def failure_reason(spark, d):
    return _info(spark, d).groupBy(F.col("column").alias("col"), "failure").agg(F.count("*").alias("n"))


#: Sparse regions, a third of them without activity, and a chromosome without contacts: all reasons of failure occur.
_FEW_PEAKS = "peaks AS (SELECT *, chr || ':' || s || '-' || e AS peak_id FROM (SELECT s_suppkey AS ord, CAST(s_suppkey % 5 AS VARCHAR) AS chr, s_suppkey * 701 AS s, s_suppkey * 701 + 60 AS e, CAST(s_suppkey % 3 AS DOUBLE) AS sig1, CAST(s_nationkey AS DOUBLE) AS sig2 FROM supplier))"
_FEW_CELLS = V.CELLS_CTE.replace("cells AS (", "allcells AS (", 1) + ", cells AS (SELECT * FROM allcells WHERE chr <> '0')"


@query((_abc_sql(True, False, True) + _INFO).replace(V.PEAKS_CTE, _FEW_PEAKS).replace(V.CELLS_CTE, _FEW_CELLS) + "SELECT gene_id, col, failure FROM info")
def failure_reasons(spark, d):
    """Every reason why a gene has no interactions."""
    s = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_nationkey").cast("double").alias("sig2"))
    p = V.excluded(spark, d).withColumn("ord", F.col("start") / 701).join(s, "ord").withColumn("sig1", (F.col("ord") % 3).cast("double")).withColumn("peak_id", X.peak_id("chr", "start", "end"))
    g, cells = V.genes(spark, d).withColumn("tss", F.array("tss")), _cells(spark, d).where("chr <> '0'")
    hits = abc.score(g, p, signals.unpivot_signals(p, ["sig1", "sig2"]), SETTINGS, cells)
    cand = intervals.overlap_join(genes.gene_windows(g, HALF), p, "inner")
    return abc.gene_info(hits, g, ["sig1", "sig2"], cand, cells.select("chr")).select("gene_id", F.col("column").alias("col"), "failure")


# -- gene by factor ---------------------------------------------------------------------------


@query(_with(V.EXCLUDED_CTE, V.GENES_CTE) + "SELECT gene_id, 'No open region in gene window' AS reason FROM genes g WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.chr = g.chr AND greatest(0, g.tss - 1001) < x.e AND x.s < g.tss + 1000)")
def discarded_genes(spark, d):
    g = V.genes(spark, d)
    regions = V.excluded(spark, d).withColumn("peak_id", X.peak_id("chr", "start", "end"))
    return matrix.discarded_genes(g, matrix.window_pairs(g, regions, 1000))


def _signals(spark, d):
    return signals.unpivot_signals(V.peaks(spark, d), ["sig1", "sig2"])


_SCALED = f", scaled AS (SELECT gene_id, peak_id, s, e, k AS col, {_DISTANCE} AS dist, CASE k WHEN 'sig1' THEN sig1 ELSE sig2 END * exp(-({_DISTANCE}) / 5000.0) AS scaler FROM pairs CROSS JOIN (SELECT unnest(['sig1', 'sig2']) AS k))\n"


@query(_with(V.PEAKS_CTE, V.GENES_CTE, _PAIRS) + _SCALED + "SELECT gene_id, peak_id, col, round(scaler, 4) AS scaler FROM scaled")
def region_scaler_window(spark, d):
    scaled = matrix.window_scaler(matrix.window_pairs(V.genes(spark, d), V.peaks(spark, d), HALF), _signals(spark, d))
    return scaled.select("gene_id", "peak_id", F.col("column").alias("col"), r("scaler", 4).alias("scaler"))


_ABC_SCALED = f""", ap AS (SELECT h.gene_id, p.peak_id, g.tss, p.s, p.e, p.sig1, p.sig2 FROM (SELECT DISTINCT gene_id, peak_id FROM hits) h JOIN genes g USING (gene_id) JOIN peaks p USING (peak_id)
  UNION SELECT g.gene_id, p.peak_id, g.tss, p.s, p.e, p.sig1, p.sig2 FROM genes g JOIN peaks p ON g.chr = p.chr AND greatest(0, g.tss - 2501) < p.e AND p.s < g.tss + 2500),
scaled AS (SELECT ap.gene_id, ap.peak_id, k AS col, CASE WHEN {_DISTANCE} <= 2500 THEN (CASE k WHEN 'sig1' THEN sig1 ELSE sig2 END) * exp(-({_DISTANCE}) / 5000.0) ELSE coalesce(intergenic, 0) END AS scaler
  FROM ap CROSS JOIN (SELECT unnest(['sig1', 'sig2']) AS k) LEFT JOIN hits h ON h.gene_id = ap.gene_id AND h.peak_id = ap.peak_id AND h.col = k)
"""


@query(_abc_sql(True, True, False).replace(V.TRANSCRIPTS_CTE, V.TRANSCRIPTS_CTE + ",\n" + V.GENES_CTE) + _ABC_SCALED + "SELECT gene_id, peak_id, col, round(scaler, 4) AS scaler FROM scaled")
def region_scaler_abc(spark, d):
    g, p = V.genes(spark, d), V.peaks(spark, d)
    hits = written(_abc(spark, d, True, True, False).select("gene_id", "peak_id", "column", "intergenic_score"), "interactions")  # read for the pairs and for their scores
    scaled = matrix.interaction_scaler(matrix.interaction_pairs(hits, g, p), _signals(spark, d), hits)
    return scaled.select("gene_id", "peak_id", F.col("column").alias("col"), r("scaler", 4).alias("scaler"))


@query(_with(V.PEAKS_CTE, V.GENES_CTE, _PAIRS) + _SCALED + "SELECT col, gene_id, count(*) FILTER (WHERE scaler > 0) AS num_peaks, round(coalesce(avg(dist) FILTER (WHERE scaler > 0), 0), 4) AS avg_peak_distance, round(coalesce(avg(e - s) FILTER (WHERE scaler > 0), 0), 4) AS avg_peak_size FROM scaled GROUP BY col, gene_id")
def peak_features(spark, d):
    scaled = matrix.window_scaler(matrix.window_pairs(V.genes(spark, d), V.peaks(spark, d), HALF), _signals(spark, d))
    return matrix.peak_features(scaled).select(F.col("column").alias("col"), "gene_id", "num_peaks", r("avg_peak_distance", 4).alias("avg_peak_distance"), r("avg_peak_size", 4).alias("avg_peak_size"))


_GENE_TF = _with(V.SEQUENCES_CTE, V.MOTIFS_CTE, _AFFINITY, V.PEAKS_CTE, V.GENES_CTE, _PAIRS) + _SCALED + ", gt AS (SELECT col, gene_id, 'TF' || motif_ord AS tf, sum(x * scaler) / 16 AS v FROM scaled JOIN (SELECT peak_id AS pid, ord FROM peaks) ON pid = scaled.peak_id JOIN aff ON CAST(aff.peak_id AS BIGINT) = ord GROUP BY ALL)\n"


def _gene_tf(spark, d):
    m, p = _matrices(spark, d), V.peaks(spark, d)
    docs = motifs.affinities(V.sequences(spark, d), m).select(F.col("peak_id").cast("long").alias("__o"), "affinity")
    affinity = p.join(docs, F.col("ord") == F.col("__o")).select("peak_id", "affinity")
    scaled = matrix.window_scaler(matrix.window_pairs(V.genes(spark, d), p, HALF), _signals(spark, d))
    return matrix.gene_tf(scaled, affinity, m), scaled


@query(_GENE_TF + "SELECT col, gene_id, tf, round(v, 4) AS value FROM gt")
def gene_tf_long(spark, d):
    return _gene_tf(spark, d)[0].select(F.col("column").alias("col"), "gene_id", "tf", r("value", 4).alias("value"))


@query(_GENE_TF + "SELECT col, gene_id, " + ", ".join(f"round(coalesce(max(v) FILTER (WHERE tf = 'TF{i}'), 0), 4) AS TF{i}" for i in range(5)) + " FROM gt GROUP BY col, gene_id")
def gene_tf_matrix(spark, d):
    factors = [r["name"] for r in _matrices(spark, d).select("name").orderBy("name").collect()]  # one row a motif
    wide = matrix.wide(_gene_tf(spark, d)[0], factors)
    return wide.select(F.col("column").alias("col"), "gene_id", *[r(f, 4).alias(f) for f in factors])


def _gene_tf_arrays(spark, d):
    m, p = _matrices(spark, d), V.peaks(spark, d)
    docs = motifs.affinities(V.sequences(spark, d), m).select(F.col("peak_id").cast("long").alias("o_"), "affinity")
    affinity = p.join(docs, F.col("ord") == F.col("o_")).select("peak_id", "affinity")
    scaled = matrix.window_scaler(matrix.window_pairs(V.genes(spark, d), p, HALF), _signals(spark, d))
    names, lengths = matrix.motif_facts(m)
    return matrix.gene_tf_vectors(scaled, affinity, lengths), names, scaled


@query(SQL["gene_tf_matrix"])
def gene_tf_vectors(spark, d):
    """The wide matrix from one array a gene."""
    vectors, names, _ = _gene_tf_arrays(spark, d)
    wide = matrix.wide_vectors(vectors, names)
    return wide.select(F.col("column").alias("col"), "gene_id", *[r(f, 4).alias(f) for f in names])


def motif_affinity_all(spark, d):
    """Whole documents against a motif of every embedding; too much for SQL, the tests hold it against a plain version."""
    return motifs.affinities(V.contigs(spark, d).select(F.col("chr").alias("peak_id"), "seq"), motifs.to_matrices(motifs.energies(V.count_rows(spark, d))))


QUERIES["motif_affinity_all"] = motif_affinity_all


# -- sources ----------------------------------------------------------------------------------


def _values(names: str, rows: list[tuple]) -> str:
    """SQL of a few given rows."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, x)) + ")" for x in rows) + f") v({names})"


@query(_with(V.GENES_CTE) + "SELECT gene_id, gene_name, chr, strand, s AS gstart, e AS gend, tss FROM genes")
def gtf_genes(spark, d):
    return readers.read_gtf(spark, V.gtf_file(spark, d), "gene").select("gene_id", "gene_name", "chr", "strand", F.col("start").alias("gstart"), F.col("end").alias("gend"), "tss")


@query(_with(V.TRANSCRIPTS_CTE) + "SELECT gene_id, gene_name, chr, tss FROM transcripts")
def gtf_transcripts(spark, d):
    return readers.read_gtf(spark, V.gtf_file(spark, d), "transcript").select("gene_id", "gene_name", "chr", "tss")


@query(_with(V.PEAKS_CTE) + "SELECT peak_id, chr, s AS pstart, e AS pend, sig1, sig2, '_sig_one,_price' AS suffixes FROM peaks")
def bed_signals(spark, d):
    regions, names = readers.read_bed(spark, V.bed_file(spark, d), "4+")
    return regions.select("peak_id", "chr", F.col("start").alias("pstart"), F.col("end").alias("pend"), F.col("c4").alias("sig1"), F.col("c5").alias("sig2"), F.lit(",".join(names.values())).alias("suffixes"))


@query(_with(V.COUNTS_CTE) + "SELECT name, CAST(pos AS INTEGER) AS pos, a, c, g, t FROM crows")
def transfac_matrices(spark, d):
    return readers.read_transfac(spark, V.transfac_file(spark, d)).select("name", "pos", *"acgt")


@query(_with(V.MOTIFS_CTE) + "SELECT name, CAST(pos AS INTEGER) AS pos, 16 AS length, round(16 * 0.584 - 5.66, 4) AS lnr0, round(a, 4) AS a, round(c, 4) AS c, round(g, 4) AS g, round(t, 4) AS t FROM mrows")
def energy_matrices(spark, d):
    path = shared_folder(spark, "energy-matrices")
    writers.write_energy_matrices(_matrices(spark, d), path, motifs.DEFAULT_GC)
    back = readers.read_energy_matrices(spark, path).select("name", "length", r("lnr0", 4).alias("lnr0"), F.posexplode("energy").alias("pos", "e"))
    return back.select("name", "pos", "length", "lnr0", *[r(F.get("e", F.lit(i)), 4).alias(b) for i, b in enumerate("acgt")])


@query(_with(V.MOTIFS_CTE) + "SELECT name, 15 - CAST(pos AS INTEGER) AS pos, round(t, 4) AS a, round(g, 4) AS c, round(c, 4) AS g, round(a, 4) AS t FROM mrows")
def motif_reverse_energies(spark, d):
    back = motifs.reverse_complement(_matrices(spark, d)).select("name", F.posexplode("energy").alias("pos", "e"))
    return back.select("name", "pos", *[r(F.get("e", F.lit(i)), 4).alias(b) for i, b in enumerate("acgt")])


@query(_with(V.CELLS_CTE) + "SELECT chr, bin1, bin2, contact FROM cells")
def contact_files(spark, d):
    """Files by name, repeated cells: the last line of a cell counts."""
    return contacts.last_cells(contacts.canonical(readers.read_contacts(spark, V.contact_folder(spark, d)), V.BIN))


@query(_with(V.CELLS_CTE) + "SELECT chr, bin2 - bin1 AS d, sum(contact * 2 + 5) AS total FROM cells WHERE bin2 > bin1 GROUP BY chr, bin2 - bin1")
def contact_files_profile(spark, d):
    """Repeated cells all count in the sums by distance."""
    cells = contacts.canonical(readers.read_contacts(spark, V.contact_folder(spark, d)), V.BIN)
    return contacts.distance_profile(cells, V.BIN).select("chr", "d", "total")


@query("SELECT c_name AS key FROM labels JOIN customer ON c_custkey = doc_id")
def gene_list(spark, d):
    c = V.read(spark, d, "customer")
    keys = V.read(spark, d, "labels").join(c, F.col("doc_id") == F.col("c_custkey")).select(F.concat(F.lit(" "), F.col("c_name")).alias("value"))
    return readers.read_gene_list(spark, V.text_folder(keys.union(spark.createDataFrame([("",)], "value string")), "gene-list"))


@query(_with(V.SEQUENCES_CTE, V.MOTIFS_CTE, _AFFINITY) + "SELECT peak_id, count(*) AS n, round(sum(x), 5) AS total FROM aff GROUP BY peak_id")
def affinity_table(spark, d):
    a = motifs.affinities(V.sequences(spark, d), _matrices(spark, d))
    return a.select("peak_id", F.size("affinity").cast("long").alias("n"), r(F.aggregate("affinity", F.lit(0.0), lambda x, y: x + y), 5).alias("total"))


@query(_values("k, told", [(0, "refused"), (1, "accepted")]))
def repeated_regions(spark, d):
    """A region with two different lines is refused, whole lines that repeat are not."""
    p = V.peaks(spark, d).select(F.concat_ws("\t", F.col("chr"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("sig1").cast("string")).alias("value"))
    out = []
    for k, more in enumerate((p.select(F.concat("value", F.lit("9")).alias("value")), p)):
        try:
            readers.read_bed(spark, V.text_folder(p.union(more), "regions"), "4")
            out.append((k, "accepted"))
        except ValueError:
            out.append((k, "refused"))
    return spark.createDataFrame(out, "k int, told string")


# -- further modes and sinks ------------------------------------------------------------------


@query(_with(V.CELLS_CTE, _SPAN, _PROFILE, _FIT) + "SELECT o_orderkey, round(CASE WHEN o_orderkey * 1000 > 1000000 THEN exp(slope * ln(o_orderkey * 1000) + intercept) ELSE exp(slope * ln(1000000) + intercept) END, 4) AS expected FROM orders JOIN fit ON chr = CAST(o_custkey % 5 AS VARCHAR)")
def pseudocount_by_distance(spark, d):
    fit = contacts.power_law(_cells(spark, d), V.BIN)
    o = V.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("string").alias("c"))
    return o.join(fit, F.col("c") == F.col("chr")).select("o_orderkey", r(contacts.pseudocount(F.col("o_orderkey"), V.BIN, F.col("slope"), F.col("intercept")), 4).alias("expected"))


@query("SELECT o_orderkey, CAST(printf('%.5e', o_totalprice / 6.9999) AS DOUBLE) AS six, CAST(printf('%.7e', o_totalprice / 70000000) AS DOUBLE) AS eight FROM orders")
def significant_digits(spark, d):
    text = lambda x, n: X.significant_text(x, n).cast("double")
    return V.read(spark, d, "orders").select("o_orderkey", text(F.col("o_totalprice") / 6.9999, 6).alias("six"), text(F.col("o_totalprice") / 70000000, 8).alias("eight"))


_FOLD = "list_reduce(list_prepend({'t': CAST(0 AS DOUBLE), 'v': CAST(0 AS DOUBLE)}, list({'t': n * sig, 'v': sig} ORDER BY s, e, peak_id) OVER w), lambda held, x: CASE WHEN x.t > held.v THEN x ELSE held END).v AS s_max"
_ORDERED = _abc_sql(False, True, False).replace("max(sig) OVER w AS s_max", _FOLD)


@query(_ORDERED + f"SELECT col, gene_id, peak_id, round(activity + {_OFF_TIES}, 6) AS activity, round(score + {_OFF_TIES}, 6) AS score FROM hits")
def abc_ordered_max(spark, d):
    settings = abc.AbcSettings(**(SETTINGS.__dict__ | {"adapted": False, "ordered_max": True}))
    p = V.peaks(spark, d)
    hits = abc.score(genes.all_tss(V.transcripts(spark, d)), p, signals.unpivot_signals(p, ["sig1", "sig2"]), settings)
    return hits.select(F.col("column").alias("col"), "gene_id", "peak_id", r(F.col("activity") + _OFF_TIES).alias("activity"), r(F.col("abc_score") + _OFF_TIES).alias("score"))


@query(_with(V.GENES_CTE, "w AS (SELECT DISTINCT chr, greatest(0, tss - 2501) AS s, tss + 2500 AS e FROM genes)") + "SELECT g.gene_id, w.s AS wstart, w.e AS wend, 0 AS distance, CAST(1 AS DOUBLE) AS scaler FROM genes g JOIN w ON g.chr = w.chr AND greatest(0, g.tss - 2501) = w.s AND g.tss + 2500 = w.e")
def promoter_scaler(spark, d):
    g = V.genes(spark, d)
    windows = genes.promoter_windows(g, HALF).withColumn("peak_id", X.peak_id("chr", "start", "end"))
    scaled = matrix.window_scaler(matrix.promoter_pairs(g, windows, HALF), None, False)
    return scaled.select("gene_id", F.col("start").alias("wstart"), F.col("end").alias("wend"), "distance", "scaler")


def _hits(spark, d):
    return _abc(spark, d, True, True, False)


@query(_abc_sql(True, True, False) + "SELECT col, gene_id, peak_id, CAST(printf('%.7e', intergenic * (1 + 1e-13)) AS DOUBLE) AS score FROM hits")
def interaction_tables(spark, d):
    """Interactions written with eight significant digits, one folder a column, and read as given ones."""
    path = shared_folder(spark, "interactions")
    writers.write_interactions(_hits(spark, d), path)
    back = readers.read_interactions(spark, {c: f"{path}/column={c}" for c in ("sig1", "sig2")})
    return back.select(F.col("column").alias("col"), "gene_id", "peak_id", F.col("intergenic_score").alias("score"))


@query(_abc_sql(True, False, True) + _INFO.replace("round(coalesce(a, 0), 6)", "coalesce(a, 0)") + "SELECT col, gene_id, n_enhancer, CAST(printf('%.5e', avg_activity * (1 + 1e-13)) AS DOUBLE) AS avg_activity, failure FROM info")
def gene_info_tables(spark, d):
    """Summaries of genes written with six significant digits and read back."""
    path = shared_folder(spark, "gene-info")
    writers.write_gene_info(_info(spark, d), path)
    back = spark.read.option("sep", "\t").option("header", True).csv(path)
    return back.select(F.col("column").alias("col"), F.col("Ensembl ID").alias("gene_id"), F.col("`#Enhancer`").cast("long").alias("n_enhancer"), F.col("Avg_EnhancerActivity").cast("double").alias("avg_activity"), F.col("Failure").alias("failure"))


def _wide(spark, d):
    vectors, names, scaled = _gene_tf_arrays(spark, d)
    fields = [*sorted(names), "NumPeaks", "AvgPeakDistance", "AvgPeakSize"]
    return matrix.wide_vectors(vectors, names, matrix.peak_features(scaled)).select("column", "gene_id", *fields), fields


_WIDE = ", wf AS (SELECT col, gene_id, " + ", ".join(f"coalesce(max(v) FILTER (WHERE tf = 'TF{i}'), 0) AS TF{i}" for i in range(5)) + """ FROM gt GROUP BY col, gene_id),
pf AS (SELECT col, gene_id, count(*) FILTER (WHERE scaler > 0) AS NumPeaks, coalesce(avg(dist) FILTER (WHERE scaler > 0), 0) AS AvgPeakDistance, coalesce(avg(e - s) FILTER (WHERE scaler > 0), 0) AS AvgPeakSize FROM scaled GROUP BY col, gene_id)
"""


@query(_GENE_TF + _WIDE + "SELECT col, gene_id, " + ", ".join(f"round(TF{i}, 4) AS TF{i}" for i in range(5)) + ", NumPeaks, round(AvgPeakDistance, 3) AS AvgPeakDistance, round(AvgPeakSize, 3) AS AvgPeakSize FROM wf JOIN pf USING (col, gene_id)")
def gene_tf_tables(spark, d):
    """The matrix as text, ten decimals, one folder a column."""
    path = shared_folder(spark, "gene-tf")
    wide, fields = _wide(spark, d)
    writers.write_gene_tf(wide, path)
    back = spark.read.option("sep", "\t").option("header", True).csv(path)
    digits = lambda f: F.col(f).cast("long") if f == "NumPeaks" else r(F.col(f).cast("double"), 3 if f.startswith("Avg") else 4)
    return back.select(F.col("column").alias("col"), F.col("geneID").alias("gene_id"), *[digits(f).alias(f) for f in fields])


@query(_GENE_TF + _WIDE + ", o AS (SELECT c_name, c_custkey AS gi FROM customer) SELECT gi, col, field, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 1) AS value FROM (SELECT gi, col, unnest(['TF0', 'TF1', 'TF2', 'TF3', 'TF4', 'NumPeaks', 'AvgPeakDistance', 'AvgPeakSize']) AS field, unnest([TF0, TF1, TF2, TF3, TF4, NumPeaks, AvgPeakDistance, AvgPeakSize]) AS value FROM wf JOIN pf USING (col, gene_id) JOIN o ON c_name = gene_id)")
def gene_tf_binary(spark, d):
    """The matrix as 32-bit floats, read back by place; genes are in the order of their keys."""
    path = shared_folder(spark, "binary")
    wide, fields = _wide(spark, d)
    wide = written(wide, "gene-tf")
    named = V.read(spark, d, "customer").select(F.col("c_name").alias("gene_id"), F.col("c_custkey").alias("k"))
    there = named.join(wide.select("gene_id").distinct(), "gene_id", "left_semi")
    ords = written(numbered(there.select("gene_id", "k"), "k", "ord", "genes"), "gene-order")
    writers.write_binary(wide, ords, ["sig1", "sig2"], fields, path)
    back = writers.read_binary(spark, path).join(ords, F.col("gene_ord") == F.col("ord"))
    return back.select(F.col("k").alias("gi"), F.col("column").alias("col"), "field", F.round(F.col("value").cast("double"), 1).alias("value"))


@query(SQL["gene_tf_binary"].replace("FROM customer)", "FROM customer WHERE c_custkey % 7 = 3)"))
def gene_tf_binary_part(spark, d):
    """Some genes of the binary matrix: only the members that hold them are read."""
    path = shared_folder(spark, "binary")
    wide, fields = _wide(spark, d)
    named = V.read(spark, d, "customer").select(F.col("c_name").alias("gene_id"), F.col("c_custkey").alias("k"))
    ords = named.select("gene_id", "k", F.col("k").alias("ord"))
    writers.write_binary(wide, ords, ["sig1", "sig2"], fields, path, member_genes=5)
    return writers.read_binary(spark, path, named.where("k % 7 = 3").select("k")).select(F.col("gene_ord").alias("gi"), F.col("column").alias("col"), "field", F.round(F.col("value").cast("double"), 1).alias("value"))


@query(SQL["discarded_genes"])
def discarded_table(spark, d):
    path = shared_folder(spark, "discarded")
    writers.write_discarded(discarded_genes(spark, d), path)
    return spark.read.option("sep", "\t").schema("gene_id string, reason string").csv(path)


@query(SQL["promoter_windows"])
def promoter_bed(spark, d):
    path = shared_folder(spark, "promoter-windows")
    writers.write_bed(genes.promoter_windows(V.genes(spark, d), HALF), path)
    return readers.read_bed(spark, path)[0].select("chr", F.col("start").alias("wstart"), F.col("end").alias("wend"))


@query("SELECT 'considered motifs' AS k, count(*) AS v FROM embeddings UNION ALL SELECT 'provided regions', count(*) + 1 FROM part")
def metadata_counts(spark, d):
    """Counts of a run's metadata, written and read back; the header of the regions counts."""
    config = pipeline.RunConfig(annotation="a", genome="g", bed=V.bed_file(spark, d), counts=V.transfac_file(spark, d))
    path = shared_folder(spark, "metadata")
    system, place = store.located(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    writers.write_metadata(path, pipeline.run_metadata(spark, config))
    return spark.createDataFrame([(k, int(v)) for k, v in writers.read_metadata(path)["Metrics"].items()], "k string, v long")


@query("SELECT 'refused' AS again, count(*) AS rows FROM part")
def existing_output(spark, d):
    """Gzipped tables, and a second write to the same place."""
    path = shared_folder(spark, "table")
    p = V.peaks(spark, d)
    writers.write_tsv(p, path)
    try:
        writers.write_tsv(p, path)
        again = "accepted"
    except Exception as refused:  # Spark names it differently by version
        again = "refused" if "exist" in str(refused).lower() else str(refused)
    gz = spark.read.option("sep", "\t").option("header", True).option("pathGlobFilter", "*.gz").csv(path)
    return gz.groupBy(F.lit(again).alias("again")).agg(F.count("*").alias("rows"))
