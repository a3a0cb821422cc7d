"""Decontamination, line dedup and quality rules."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from chromaspan.llm import common, decontamination, line_dedup, quality_rules

from . import cases


def duck(sql, docs, benchmark=None):
    con = duckdb.connect()
    con.register("d", docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").toPandas())
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM d")
    if benchmark is not None:
        con.register("b", benchmark.toPandas())
        con.execute("CREATE VIEW benchmark AS SELECT item_id::BIGINT AS item_id, text FROM b")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return {r["doc_id"]: r for r in (dict(zip(names, row, strict=True)) for row in cur.fetchall())}


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, cases.BASE), (2, "the and of to"), (3, None), (4, "!!"), (5, "WORD"), (6, "mail a b c d com or 1 555 123 4567")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_equals_sql(spark, benchmark):
    for docs, bench in ((cases.documents(spark), benchmark), (cases.sf_documents(spark), spark.read.parquet(f"{cases.SF}/benchmark.parquet"))):
        mine = cases.by_id(decontamination.op1_decontamination(docs, bench).where("doc_id IS NOT NULL"))
        theirs = duck(decontamination.OP1_SQL, docs, bench)
        assert {k: r.asDict() for k, r in mine.items()} == theirs
        assert any(r["contaminated"] for r in theirs.values())


def test_decontamination_removals(spark, benchmark):
    docs = cases.documents(spark)
    kept = decontamination.remove_documents(docs, benchmark)
    hit = {i for i, r in cases.by_id(decontamination.op1_decontamination(docs, benchmark)).items() if r["contaminated"]}
    assert kept.columns == docs.columns and not hit & set(cases.by_id(kept))
    spans = cases.by_id(decontamination.remove_spans(spark.createDataFrame([(1, "Say: the AND of, to! the end", 2)], "doc_id long, text string, x int"), benchmark))
    assert spans[1]["text"] == "Say:   , ! the end" and spans[1]["x"] == 2
    assert decontamination.op1_decontamination(cases.empty(spark), benchmark).count() == 0
    assert decontamination.remove_documents(docs, benchmark.limit(0)).count() == docs.count()
    repeated = decontamination.op1_decontamination(docs, benchmark)
    assert repeated.count() == docs.count()


def test_decontamination_by_shuffle(spark, benchmark, monkeypatch):
    """Without any broadcast the results are the same; columns may be named like those used inside."""
    docs = cases.documents(spark)
    want = sorted(decontamination.op1_decontamination(docs, benchmark).collect(), key=str)
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", -1)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(decontamination.op1_decontamination(docs, benchmark).collect(), key=str) == want
    clashing = docs.selectExpr("*", "1 AS id_", "2 AS hash_", "3 AS found", "4 AS row_hash", "5 AS w", "6 AS h")
    assert decontamination.remove_documents(clashing, benchmark).count() == sum(not r["contaminated"] for r in want)
    marked = decontamination.mark(clashing, benchmark)
    assert marked.columns == [*clashing.columns, "hit_spans", "n_hit", "hit_items"] and marked.where("n_hit > 0").count() == sum(r["contaminated"] for r in want)
    assert decontamination.remove_spans(clashing, benchmark).columns == clashing.columns


def test_line_dedup_equals_sql(spark):
    for docs in (cases.documents(spark, repeat=False), cases.sf_documents(spark)):
        mine = {k: r.asDict() for k, r in cases.by_id(line_dedup.op10_line_dedup(docs)).items()}
        assert mine == duck(line_dedup.OP10_SQL, docs)
    out = cases.by_id(line_dedup.dedup_lines(cases.documents(spark, repeat=False)))
    assert [out[i]["text"] for i in (11, 12, 13)] == ["first", "second\n", cases.LINE + "\nthird"]
    assert out[0]["text"] == "" and out[0]["n_lines"] == 1 and out[12]["n_dropped"] == 2


def test_line_dedup_edges(spark):
    docs = cases.documents(spark)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and out.count() == docs.count()
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0
    unnamed = spark.createDataFrame([(None, cases.LINE)] * 3, "doc_id long, text string")
    assert {r["text"] for r in line_dedup.dedup_lines(unnamed).collect()} == {cases.LINE}


def test_line_runs_compact(spark):
    docs = cases.sf_documents(spark)
    one, many = (line_dedup.build_runs(docs, batches=n) for n in (1, 5))
    assert many.written > 5 and len(many.runs()) < 5
    assert sorted(one.known().select("h1", "h2", "keeper").collect()) == sorted(many.known().select("h1", "h2", "keeper").collect())


def test_line_runs_count_like_a_dictionary(spark):
    """Few keys in many batches: sums, keepers and what is settled, against a plain count."""
    rnd = random.Random(4)
    lines = sorted(((rnd.randint(0, 300), 7, rnd.randint(0, 40), 1) for _ in range(900)), reverse=True)
    runs, plain = line_dedup.LineRuns(spark, 3), {}
    for at in range(0, 900, 60):
        part = sorted(set(lines[at : at + 60]))
        runs.add(spark.createDataFrame(part, "doc_id long, row_hash long, h1 long, h2 long"))
        for doc_id, _, h1, h2 in part:
            plain.setdefault((h1, h2), []).append(doc_id)
    got = {(r["h1"], r["h2"]): r["keeper"] for r in runs.known().collect()}
    assert got == {k: max(v) for k, v in plain.items() if len(v) >= 3} and len(runs.runs()) < 5
    # A repeated line is settled by the run that knows it; one of a larger doc_id is not.
    key = next(iter(got))
    batch = [(-1, 7, *key), (-1, 7, 99, 1)]
    assert [(r["h1"], r["h2"]) for r in runs.unsettled(spark.createDataFrame(batch, "doc_id long, row_hash long, h1 long, h2 long")).collect()] == [(99, 1)]
    names = list(runs.names)
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_line_runs_stay_sorted(spark):
    """A batch is shuffled once; runs are neither shuffled nor sorted, in anti-joins and in merges."""
    runs = line_dedup.build_runs(cases.sf_documents(spark), batches=3)
    assert len(runs.runs()) == 2
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with line_dedup.sorted_buckets(spark):
        anti = plan(runs.unsettled(line_dedup.line_hashes(cases.sf_documents(spark))))
        merged = plan(runs._merge(runs.runs()))
    assert anti.count("LeftAnti") == 2 and anti.count("Exchange hashpartitioning") == 1 and anti.count("Sort [") == 1
    assert "FullOuter" in merged and "Exchange" not in merged and "Sort [" not in merged
    runs.close()


def test_quality_counts(spark):
    for docs in (cases.documents(spark), cases.sf_documents(spark)):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        rows = quality_rules.op7_quality_rules(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = cases.quality(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.op7_quality_rules(cases.empty(spark)).count() == 0


def test_quality_equals_sql(spark):
    docs = cases.sf_documents(spark)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{cases.SF}/documents.parquet'")
    cur = con.execute(quality_rules.OP7_SQL)
    names = [c[0] for c in cur.description]
    theirs = {r["doc_id"]: r for r in (dict(zip(names, row, strict=True)) for row in cur.fetchall())}
    assert {k: r.asDict() for k, r in cases.by_id(quality_rules.op7_quality_rules(docs)).items()} == theirs


def test_quality_sketches_merge(spark):
    rows = quality_rules.measures(cases.sf_documents(spark))
    halves = [quality_rules.sketches(rows.where(F.pmod("doc_id", F.lit(2)) == i)) for i in (0, 1)]
    merged = halves[0].union(halves[1]).groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(merged.collect(), key=str) == sorted(quality_rules.sketches(rows).collect(), key=str)


def test_quality_verdict_against_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality_rules.op7_quality_rules(docs).join(labels, "doc_id")
    assert judged.where("quality = 0 AND kept").count() == 0
    good = judged.where("quality = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.98 * good.count()


def test_quality_fences_are_of_the_data(spark):
    """Whatever the scale of the junk, a source that is half junk rejects it, and nearly all fences come from quartiles that differ."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = quality_rules.group_fences(quality_rules.sketches(quality_rules.measures(docs)))
    assert found.where("NOT flat").count() >= 0.95 * found.count() > 0
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdeiorstn", k=rnd.randint(2, 8))) for _ in range(600)]
    clean = lambda k: "\n".join(" ".join(rnd.choices(words, k=12)) for _ in range(6 + k % 9))
    rows = [(k, clean(k), "en", "good") for k in range(400)] + [(1000 + k, clean(k) + " #$% ^& **" * 40 if k % 2 else clean(k), "en", "bad") for k in range(120)]
    got = cases.by_id(quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert sum(got[k]["kept"] for k in range(400)) >= 396 and all(got[1000 + k]["kept"] == (k % 2 == 0) for k in range(120))
