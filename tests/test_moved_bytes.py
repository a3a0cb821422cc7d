"""What pairs carry while they are moved, and what is computed once."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chromaspan.functions import stages
from chromaspan.operators import abc
from chromaspan.plans import queries as Q


@pytest.mark.parametrize("adapted", [True, False])
def test_pairs_move_sums_of_starts(spark, adapted):
    """With measured contacts no array of starts and no fact of the chromosome goes on with a pair; the sums are those of single starts."""
    rng = random.Random(6)
    g = spark.createDataFrame([(f"g{i}", f"n{i}", "1", [rng.randrange(1, 9000) for _ in range(6)]) for i in range(9)], "gene_id string, gene_name string, chr string, tss array<long>")
    p = spark.createDataFrame([(f"p{i}", "1", s := rng.randrange(9000), s + 300) for i in range(20)], "peak_id string, chr string, start long, end long")
    cells = spark.createDataFrame([("1", a, b, float(rng.randrange(1, 90))) for a in range(12) for b in range(a, 12)], "chr string, bin1 long, bin2 long, contact double")
    settings = abc.AbcSettings(4000, 4000, 1000, 0.01, adapted, join_width=5000)
    near, _ = abc._near_pairs(g, p, settings, cells)
    assert {"starts", "dist"} <= set(near.columns) and not {"tss", "ords", "slope", "intercept", "last_bin"} & set(near.columns)
    got, want = {}, {}
    for r in near.collect():
        x = got.setdefault((r["gene_id"], r["peak_id"]), [0, 0, 0.0])
        x[0], x[1], x[2] = x[0] + r["starts"], x[1] + r["dist"], x[2] + r["contact"] * r["starts"]
    for r in abc.pair_contacts(g, p, settings, cells).where("near").collect():
        x = want.setdefault((r["gene_id"], r["peak_id"]), [0, 0, 0.0])
        x[0], x[1], x[2] = x[0] + 1, x[1] + r["distance"], x[2] + r["contact"]
    assert got.keys() == want.keys() and len(got) > 20 and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_interactions_are_scored_once(spark):
    """Pairs and scores read what was written: no window by gene is left in the plan."""
    plan = Q.region_scaler_abc(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_shuffle_files_go_when_a_table_is_written(spark):
    """They do not wait for the driver's garbage collection; the table and the caller's setting stay."""
    folder = Path(spark.conf.get("spark.local.dir"))
    files = lambda: {f.name for f in folder.rglob("shuffle_*.data")}
    before = files()
    table = stages.written(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in ("false", None)
