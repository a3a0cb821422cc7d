"""Scores of many columns by place: regions' arrays and gene names are not broadcast by the size of files, and go to each range once."""

import random

import pytest

from chromaspan.functions import stages
from chromaspan.operators import abc


def tables(spark, folder, n):
    rng = random.Random(n)
    names = [f"c{k}" for k in range(n)]
    g = [(f"g{i}", f"n{i}", str(i % 2), [rng.randrange(1, 60_000) for _ in range(1 + i % 3)]) for i in range(40)]
    g.append(("g3", "again", "1", g[3][3]))  # a gene with two names
    p = [(f"p{i}", str(i % 2), s := rng.randrange(60_000), s + 400, *[float(rng.randrange(30)) for _ in names]) for i in range(90)]
    spark.createDataFrame(g, "gene_id string, gene_name string, chr string, tss array<long>").write.parquet(f"{folder}/genes")
    spark.createDataFrame(p, "peak_id string, chr string, start long, end long, " + ", ".join(f"{c} double" for c in names)).write.parquet(f"{folder}/peaks")
    long = spark.createDataFrame([(r[0], c, v) for r in p for c, v in zip(names, r[4:], strict=True)], "peak_id string, column string, signal double")
    return spark.read.parquet(f"{folder}/genes"), spark.read.parquet(f"{folder}/peaks"), long, names


@pytest.mark.parametrize("adapted", [True, False])
def test_no_region_or_name_is_broadcast(spark, tmp_path, adapted):
    """Files of a few bytes tell nothing of the arrays made from them."""
    g, p, _, names = tables(spark, str(tmp_path), 30)
    hits = abc.score_columns(g, p, names, abc.AbcSettings(20_000, 20_000, 1000, 0.01, adapted, join_width=5000))
    plan = hits._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == (0 if adapted else 1)  # the chromosomes' maxima


@pytest.mark.parametrize(("adapted", "batch", "most"), [(True, 7, 20_000), (False, 1, 20_000), (False, 10_000, 128 << 20)])
def test_genes_across_batches_and_ranges(spark, tmp_path, monkeypatch, adapted, batch, most):
    """The same hits as in the long form, whatever the batches and ranges cut; a gene with two names has its hits under both."""
    g, p, long, names = tables(spark, str(tmp_path), 4)
    settings = abc.AbcSettings(20_000, 20_000, 1000, 0.01, adapted, join_width=5000)
    key = lambda df: {(r["column"], r["gene_id"], r["gene_name"], r["peak_id"], f): r[f] for r in df.collect() for f in ("contact", "activity", "scaled_contact", "intergenic_score", "tss_distance", "abc_score")}
    want = key(abc.score(g, p, long, settings))
    monkeypatch.setattr(stages, "TASK_BYTES", most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = key(abc.score_columns(g, p, names, settings))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(want, rel=1e-9) and len(want) > 500
    assert {k[2] for k in got if k[1] == "g3"} == {"n3", "again"}
