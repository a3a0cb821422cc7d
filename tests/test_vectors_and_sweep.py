"""Vector sums and sweep joins against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaspan.operators import abc, intervals, sweep, vectors

# -- vector sums ------------------------------------------------------------------------------


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_vector_totals(spark, monkeypatch, held):
    monkeypatch.setattr(vectors, "HELD_BYTES", held)
    monkeypatch.setattr(vectors, "_ROWS", 7)
    rng = np.random.default_rng(2)
    rows = [(f"g{rng.integers(9)}" if k % 11 else None, k % 2, rng.normal(size=5).tolist(), rng.normal(size=2).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, t array<double>, h array<double>").repartition(6)
    got = {(r["g"], r["k"]): (r["t"], r["h"]) for r in vectors.vector_totals(df, ["g", "k"], "t", "h").collect()}
    for key in {(g, k) for g, k, _, _ in rows}:
        own = [(t, h) for g, k, t, h in rows if (g, k) == key]
        assert got[key][0] == pytest.approx(np.sum([t for t, _ in own], axis=0)) and got[key][1] == pytest.approx(np.max([h for _, h in own], axis=0))
    assert len(got) == len({(g, k) for g, k, _, _ in rows})


def test_vector_totals_nulls(spark):
    df = spark.createDataFrame([("a", [1.0, None]), ("a", [2.0, 3.0]), ("b", None), ("b", [1.0, 1.0]), ("c", None)], "g string, t array<double>")
    got = {r["g"]: r["t"] for r in vectors.vector_totals(df, ["g"], "t").collect()}
    assert got["a"][0] == 3.0 and np.isnan(got["a"][1]) and np.isnan(got["b"]).all()
    assert vectors.vector_totals(df.limit(0), ["g"], "t").count() == 0


# -- scores of many columns -------------------------------------------------------------------


@pytest.mark.parametrize(("n", "adapted"), [(2, True), (2, False), (50, True), (500, False)])
def test_score_columns_equals_long_form(spark, n, adapted):
    rng = random.Random(n)
    genes = spark.createDataFrame([(f"g{i}", f"n{i}", str(i % 2), sorted(rng.sample(range(1, 60_000), 1 + i % 3))) for i in range(12)], "gene_id string, gene_name string, chr string, tss array<long>")
    columns = [f"c {k}" for k in range(n)]
    rows = []
    for i in range(30):
        s = rng.randrange(60_000)
        rows.append((f"p{i}", str(i % 2), s, s + rng.randrange(1, 3000), *[None if rng.random() < 0.01 else float(rng.randrange(20)) for _ in columns]))
    peaks = spark.createDataFrame(rows, "peak_id string, chr string, start long, end long, " + ", ".join(f"`{c}` double" for c in columns))
    settings = abc.AbcSettings(20_000, 20_000, 1000, 0.05, adapted, join_width=5000)
    long = spark.createDataFrame([(r[0], c, v) for r in rows for c, v in zip(columns, r[4:], strict=True)], "peak_id string, column string, signal double")
    key = lambda df: {(r["column"], r["gene_id"], r["peak_id"]): r for r in df.collect()}
    got, want = key(abc.score_columns(genes, peaks, columns, settings)), key(abc.score(genes, peaks, long, settings))
    assert got.keys() == want.keys() and len(want) > 10
    for k, w in want.items():
        assert [got[k][f] for f in ("chr", "start", "end", "gene_name", "signal")] == [w[f] for f in ("chr", "start", "end", "gene_name", "signal")]
        for f in ("contact", "activity", "scaled_contact", "intergenic_score", "tss_distance", "abc_score"):
            assert got[k][f] == pytest.approx(w[f], rel=1e-9)


def test_score_columns_moves_as_many_rows_for_any_number_of_columns(spark):
    """No generate by column before the hits: the plan has the same exchanges for 2 and 50 columns."""
    genes = spark.createDataFrame([("g", "n", "1", [500])], "gene_id string, gene_name string, chr string, tss array<long>")
    settings = abc.AbcSettings(20_000, 20_000, 1000, 0.05)
    plans = []
    for n in (2, 50):
        peaks = spark.createDataFrame([("p", "1", 100, 200, *[1.0] * n)], "peak_id string, chr string, start long, end long, " + ", ".join(f"c{k} double" for k in range(n)))
        hits = abc.score_columns(genes, peaks, [f"c{k}" for k in range(n)], settings)
        assert hits.count() == n
        plans.append(hits._jdf.queryExecution().optimizedPlan().toString())
    assert plans[0].count("Join") == plans[1].count("Join") and plans[0].count("Generate") == plans[1].count("Generate") == 1


# -- sweep joins ------------------------------------------------------------------------------


def intervals_of(rng, n, chroms, length, widths):
    out = []
    for i in range(n):
        s = rng.choice((rng.randrange(length), length // 2))  # half of them in one place
        out.append((rng.choice(chroms), s, s + rng.choice(widths), i))
    return [*out, (None, 5, 9, -1), ("1", None, 9, -2), ("1", 5, None, -3)]


@pytest.mark.parametrize(("slot_rows", "widths"), [(10, (0, 1, 50, 4000)), (50, (3000, 50_000)), (100_000, (0, 5, 700))])
def test_sweep_join(spark, slot_rows, widths):
    rng = random.Random(slot_rows)
    schema = "chr string, start long, end long, key int, `first_` int, `b in` int"
    make = lambda n: [(*r, 7, r[3]) for r in intervals_of(rng, n, ["1", "2", "X", "Y"], 20_000, widths)]
    a, b = make(150), make(120)
    left, right = spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema).repartition(2)
    over = lambda x, y: None not in (*x[:3], *y[:3]) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    want = sorted((x[3], y[3]) for x in a for y in b if over(x, y))
    got = sweep.sweep_join(left, right, slot_rows=slot_rows)
    assert got.columns == [*left.columns, *["r_" + c for c in right.columns]]
    rows = got.collect()
    assert sorted((r["key"], r["r_key"]) for r in rows) == want and {r["first_"] for r in rows} == {7}
    binned = intervals.overlap_join(left, right, "inner", 900)
    assert sorted((r["key"], r["r_key"]) for r in binned.collect()) == want and {r["first_"] for r in binned.collect()} == {7}
    some = {i for i, _ in want}
    for how, keep in (("left_semi", True), ("left_anti", False)):
        assert sorted(r["key"] for r in sweep.sweep_join(left, right, how, slot_rows=slot_rows).collect()) == sorted(x[3] for x in a if (x[3] in some) == keep)


def test_sweep_rows_grow_with_pairs_not_with_width(spark):
    """Five-megabase windows: dealt rows stay near the number of intervals, where bins of 100 kb would make fifty of each."""
    rng = random.Random(3)
    wide = [("1", s := rng.randrange(200_000_000), s + 5_000_000) for _ in range(3000)]
    small = [("1", s := rng.randrange(200_000_000), s + 500) for _ in range(3000)]
    left, right = (spark.createDataFrame(x, "chr string, start long, end long") for x in (wide, small))
    slots = sweep.make_slots(left, right, slot_rows=500)
    assert len(slots.by_chr["1"][0]) >= 12
    assert sweep._dealt(left, slots, 0, "start", "end").count() < 2 * len(wide)
    assert sweep._dealt(right, slots, 1, "start", "end").count() < 1.01 * len(small)
    starts = np.sort([s for _, s, _ in small])
    ends = np.sort([e for _, _, e in small])
    want = sum(int(np.searchsorted(starts, e) - np.searchsorted(ends, s, "right")) for _, s, e in wide)
    assert sweep.sweep_join(left, right, slot_rows=500).count() == want


def test_sweep_empty(spark):
    df = spark.createDataFrame([("1", 1, 5)], "chr string, start long, end long")
    assert sweep.sweep_join(df, df.limit(0)).count() == 0 and sweep.sweep_join(df.limit(0), df).count() == 0
    assert sweep.sweep_join(df, df.limit(0), "left_anti").count() == 1 and sweep.sweep_join(df, df.limit(0), "left_semi").count() == 0
    assert sweep.sweep_join(df, df).select(F.col("r_start")).first()[0] == 1
