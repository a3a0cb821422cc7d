"""Near-dedup against brute force, and the pipeline against its stages in plain Python."""

import random

import corpus_pipeline
from chromaspan.llm import common, near_dups

from . import cases


def brute(texts):
    """(n_shingles, component) by id."""
    sets = {i: cases.shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_dups.op4_near_dups(docs).collect()
    want = brute(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    kept = {r["doc_id"] for r in near_dups.dedup(docs).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_near_dups_tables(spark):
    check(spark, dict(enumerate(cases.TEXTS)))
    check(spark, {r["doc_id"]: r["text"] for r in cases.sf_documents(spark).collect()})


def test_near_dups_large_buckets(spark):
    """Many variants of one text, from close to far, and many texts around one passage."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    base, passage, texts = [word() for _ in range(120)], [word() for _ in range(90)], {}
    for i in range(110):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 8])):
            w[rnd.randrange(len(w))] = word()
        texts[i] = " ".join(w)
    for i in range(110, 170):
        texts[i] = " ".join([*passage, *(word() for _ in range(rnd.choice([6, 14, 22, 28])))])
    check(spark, texts)


def test_near_dups_linked_by_the_base_only(spark):
    """Long texts: light edits of a base lead all buckets, and far copies link to the base but to none of these."""
    word = lambda k: f"new{k}"
    base = [f"w{k}" for k in range(104)]

    def edited(*places):
        w = list(base)
        for k in places:
            w[k] = word((places, k))
        return " ".join(w)

    near = [5 + 6 * k for k in range(8)]
    texts = {k: edited(place) for k, place in enumerate(near * 3)}
    texts = {k: t.replace("new", f"new{k}x") for k, t in texts.items()}
    texts[100] = " ".join(base)
    far = [(58, 70), (58, 82), (58, 94), (64, 76), (64, 88), (70, 82), (70, 94), (76, 88)]
    texts |= {200 + k: edited(*places) for k, places in enumerate(far)}
    sets = {i: cases.shingle_set(t) for i, t in texts.items()}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert all(link(100, i) and not any(link(k, i) for k in range(len(near) * 3)) for i in range(200, 200 + len(far)))
    ids = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    rows = [(0, len(sets[0]), i, len(s), sorted(ids[x] for x in s ^ sets[0]), link(0, i), 0 if link(0, i) else i) for i, s in sets.items() if i]
    held = spark.createDataFrame(rows, "lead long, lead_n long, rep long, n long, diff array<long>, ok boolean, component long")
    pairs = {(r["a"], r["b"]) for r in near_dups.pairs_by_differences(held).collect()}
    components = {r[2]: r[6] for r in rows}
    assert pairs >= {(a, b) for a in components for b in components if a < b and link(a, b) and components[a] != components[b]}
    check(spark, texts)


def test_near_dups_prefix_bounds(spark):
    """Members of all sizes and distances around a lead, each linked pair of different components is made."""
    rnd = random.Random(11)
    for size in (20, 60, 150):
        lead = frozenset(range(size))
        sets = {}
        for i in range(1, 120):
            core = sets[rnd.choice(list(sets))] if sets and rnd.random() < 0.6 else lead
            drop, add = (rnd.randrange(0, max(2, size // rnd.choice([4, 8, 16]))) for _ in range(2))
            s = set(core) - set(rnd.sample(sorted(core), min(drop, len(core) - 1))) | {rnd.randrange(size, 3 * size) for _ in range(add)}
            if s != lead:
                sets[i] = s
        link = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
        rows = [(0, size, i, len(s), sorted(s ^ lead), link(lead, s), 0 if link(lead, s) else i) for i, s in sets.items()]
        held = spark.createDataFrame(rows, "lead long, lead_n long, rep long, n long, diff array<long>, ok boolean, component long")
        pairs = {(r["a"], r["b"]) for r in near_dups.pairs_by_differences(held).collect()}
        component = {r[2]: r[6] for r in rows}
        want = {(a, b) for a in sets for b in sets if a < b and link(sets[a], sets[b]) and component[a] != component[b]}
        assert want and pairs >= want


def test_near_dups_edges(spark):
    docs = cases.documents(spark)
    out = near_dups.op4_near_dups(docs)
    assert out.count() == docs.count()
    last = len(cases.TEXTS) - 1
    assert {r["component_id"] for r in out.where("doc_id IS NULL").collect()} == {last}
    assert near_dups.op4_near_dups(cases.empty(spark)).count() == 0
    assert near_dups.dedup(docs).columns == docs.columns
    unnamed = spark.createDataFrame([(None, "a text without an id")] * 2, "doc_id long, text string")
    assert [(r["component_id"], r["kept"]) for r in near_dups.op4_near_dups(unnamed).collect()] == [(None, True)] * 2


def test_near_dups_by_shuffle(spark, monkeypatch):
    """Without any broadcast, and with a lead's pairs dealt out two at a time, the result is the same."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(near_dups, "LEAD_PAIRS", 2)
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = {i: " ".join([*base[: rnd.choice([40, 50, 60])], *(f"x{i}y{k}" for k in range(rnd.choice([0, 1, 4])))]) for i in range(30)}
    check(spark, texts)


def test_near_dups_template(spark):
    """Texts of one template, alike by 0.7 in each other and in nothing else: no pair of them is made from common differences."""
    rows = []
    for i in range(1, 400):
        s = set(range(160)) | {1000 * i + k for k in range(34)}
        rows.append((0, 194, i, len(s), sorted(s ^ (set(range(160)) | set(range(200, 234)))), False, i))
    held = spark.createDataFrame(rows, "lead long, lead_n long, rep long, n long, diff array<long>, ok boolean, component long")
    assert near_dups.pairs_by_differences(held).count() == 0


def test_sketch_keeps_similarity():
    import numpy as np

    rnd = np.random.default_rng(3)
    for size in (1, 3, 40, 800):
        common, own = (rnd.integers(0, 2**63, n, dtype=np.uint64) for n in (size, max(1, size // 3)))
        a, b = np.unique(common), np.unique(np.concatenate([common, own]))
        s = near_dups.sketch([a, b])
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert abs((s[0] == s[1]).mean() - len(a) / len(b)) < 0.2


def test_pipeline(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    before = docs
    benchmark = [r["text"] for r in spark.read.parquet(f"{cases.SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        held = {r["doc_id"]: r["text"] for r in before.collect()}
        after = stage(spark, before, cases.SF)
        rows = after.collect()
        ids = {r["doc_id"] for r in rows}
        assert len(rows) == len(ids) and ids <= set(held)
        if name != "sentencepiece":
            assert after.columns == docs.columns
        if name == "language_id":
            assert ids == set(held)
        if name == "line_dedup":
            assert ids == set(held) and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "near_dups":
            assert ids == {i for i, (_, c) in brute(held).items() if c == i} and len(ids) < len(held)
        if name == "decontamination":
            windows = set()
            for t in benchmark:
                w = cases.ALNUM.findall(t.translate(cases.AZ))
                windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
            dirty = lambda t: any(tuple(w[i : i + 10]) in windows for w in [cases.ALNUM.findall(t.translate(cases.AZ))] for i in range(len(w)))
            assert ids == {i for i, t in held.items() if not dirty(t)} and len(ids) < len(held)
        if name == "sentencepiece":
            assert ids == set(held) and all(r["round_trip"] for r in rows)
        else:
            before = spark.createDataFrame(rows, after.schema)
    final = {(r["doc_id"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, cases.SF).collect()}
    assert final == {(r["doc_id"], r["ids_crc32"]) for r in rows}


def test_pipeline_edges(spark):
    """Nulls, empty and long texts, repeated rows, rows without an id, empty tables, and columns named like those the stages use."""
    extra = ["id_", "hash_", "found", "new", "lost1_", "languages", "lang_pred", "n_lines", "n_dropped", "spans", "hit_spans", "row_hash"]
    clash = lambda df: df.selectExpr("*", *[f"'keep' AS {c}" for c in extra])
    docs, none = clash(cases.documents(spark)), clash(cases.empty(spark))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, cases.SF)
        assert stage(spark, none, cases.SF).count() == 0
        rows = out.collect()
        if name == "sentencepiece":
            assert len(rows) == docs.count()
            continue
        assert out.columns == docs.columns and all(r[c] == "keep" for r in rows for c in extra) and all(r["score"] == "x" and r["n_words"] == -1 for r in rows)
        ids = [r["doc_id"] for r in rows]
        last = len(cases.TEXTS) - 1
        if name == "language_id":
            assert 0 not in ids and 1 not in ids and ids.count(last) == 2 and ids.count(None) == 1
        if name == "line_dedup":
            assert len(ids) == docs.count() and {r["text"] for r in rows if r["doc_id"] == 0} == {""}
        if name == "near_dups":
            assert ids.count(last) == 2 and ids.count(None) == 1 and 9 not in ids and {0, 1, 2} <= set(ids)
        if name == "decontamination":
            assert {0, 1} <= set(ids) and ids.count(last) == 2
