"""Contact tiles against cells."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from chromaspan.operators import contacts, tiles
from chromaspan.sources import readers


def cells_of(seed, n=800, bins=90):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a = rng.randrange(bins)
        b = min(bins - 1, a + rng.choice((0, 1, 1, rng.randrange(bins))))
        out.append((rng.choice("12X"), a, b, float(rng.randrange(1, 99)), k))
    return out


@pytest.mark.parametrize(("side", "stripe"), [(1, 1), (7, 2), (16, 1), (256, 16)])
def test_tiles_equal_cells(spark, side, stripe):
    rows = cells_of(side)
    cells = spark.createDataFrame(rows, "chr string, bin1 long, bin2 long, contact double, ord long").repartition(5)
    want = contacts.with_diagonal(contacts.last_cells(cells))
    made = tiles.write_tiles(cells, 1000, side=side, stripe=stripe)
    key = lambda df: sorted((r["chr"], r["bin1"], r["bin2"], r["contact"]) for r in df.collect())
    assert key(made.cells()) == key(want)
    assert sorted(made.fit().collect(), key=str) == sorted(contacts.power_law(cells, 1000).collect(), key=str)
    rng = random.Random(9)
    asked = [(rng.choice(["1", "2", "X", "Y", None]), rng.choice([rng.randrange(90), None]), rng.randrange(200), i, 7) for i in range(500)]
    pairs = spark.createDataFrame(asked, "chr string, a long, b long, key int, `tile_row` int").repartition(3)
    got, plain = tiles.lookup_tiles(pairs, made, "a", "b"), contacts.lookup(pairs, want, "a", "b")
    assert got.columns == plain.columns
    known = "a IS NOT NULL AND chr IS NOT NULL"
    assert sorted(got.where(known).collect(), key=str) == sorted(plain.where(known).collect(), key=str)
    assert got.count() == len(asked) and got.where(f"NOT ({known}) AND contact <> 0").count() == 0


def test_lookup_reads_only_asked_stripes(spark):
    rows = [("1", b, b + 1, 1.0) for b in range(0, 4000, 3)] + [("2", b, b + 1, 1.0) for b in range(0, 4000, 3)]
    made = tiles.write_tiles(spark.createDataFrame(rows, "chr string, bin1 long, bin2 long, contact double"), 1000, side=16, stripe=4)
    pairs = spark.createDataFrame([("1", 64, 65), ("1", 66, 67), ("3", 5, 6)], "chr string, a long, b long")
    scan = tiles.needed_tiles(made, pairs.select("chr", F.least("a", "b").alias("low")))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*stripe", plan)
    read, all_ = len(scan.inputFiles()), len(made.tiles().inputFiles())
    assert scan.select(F.col("_metadata.file_path")).distinct().count() < all_ / 20 and read <= all_
    assert sorted(r["contact"] for r in tiles.lookup_tiles(pairs, made, "a", "b").collect()) == [0.0, 0.0, 1.0]


def test_lookup_joins_far_fewer_rows(spark):
    """As many packed rows as tiles, not as cells."""
    rows = [("1", a, b, 1.0) for a in range(120) for b in range(a, 120)]
    made = tiles.write_tiles(spark.createDataFrame(rows, "chr string, bin1 long, bin2 long, contact double"), 1000, side=40)
    assert made.tiles().count() == 6 and made.cells().count() == len(rows)


def test_tiles_empty(spark):
    none = spark.createDataFrame([], "chr string, bin1 long, bin2 long, contact double")
    made = tiles.write_tiles(none, 1000)
    pairs = spark.createDataFrame([("1", 1, 2)], "chr string, a long, b long")
    assert [r["contact"] for r in tiles.lookup_tiles(pairs, made, "a", "b").collect()] == [0.0]
    assert tiles.lookup_tiles(pairs.limit(0), made, "a", "b").count() == 0


def test_contact_files_of_other_chromosomes_are_not_opened(spark, tmp_path):
    for c in "12":
        with gzip.open(tmp_path / f"chr{c}_x.gz", "wt") as f:
            f.write(f"0\t1000\t{c}.5\n")
    (tmp_path / "chr3_x.gz").write_bytes(b"this is no gzip file")
    got = readers.read_contacts(spark, str(tmp_path), ["1", "2", "9"])
    assert sorted((r["chr"], r["pos2"], r["contact"]) for r in got.collect()) == [("1", 1000, 1.5), ("2", 1000, 2.5)]
    with pytest.raises(Exception, match="(?i)gzip"):
        readers.read_contacts(spark, str(tmp_path)).collect()
