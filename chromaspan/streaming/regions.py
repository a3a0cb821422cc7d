"""A stream of regions against static gene windows: activity per gene, updated as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance_decay, tss_distance
from ..operators.genes import gene_windows
from ..operators.intervals import overlap_join


def gene_activity(regions: DataFrame, genes: DataFrame, half: int, width: int = 5000) -> DataFrame:
    """(gene_id, n_regions, activity) from regions (chr, start, end, signal), batch or streaming, and static genes with one ``tss`` each."""
    pairs = overlap_join(regions, gene_windows(genes.select("gene_id", "chr", "tss"), half), "inner", width)
    weight = F.col("signal") * distance_decay(tss_distance("start", "end", "r_tss"))
    return pairs.groupBy(F.col("r_gene_id").alias("gene_id")).agg(F.count("*").alias("n_regions"), F.sum(weight).alias("activity"))
