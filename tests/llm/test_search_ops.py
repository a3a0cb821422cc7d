"""Neighbour graph, lexical search and centroid clustering against brute force."""

import hashlib
import math
import random
from heapq import nlargest

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chromaspan.llm import centroid_clustering, lexical_search, neighbour_graph

from .cases import ALNUM, AZ, SF, TEXTS, documents, empty

# -- lexical search ---------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_pack_round_trip(values):
    assert lexical_search.unpack(lexical_search.pack(values)[0]).tolist() == values


def terms(text):
    return ALNUM.findall((text or "").translate(AZ))


def ranked(docs, items, top=50):
    """docs: (doc_id, text) rows; items: item_id to text. Plain version of the contract."""
    bags = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    out = {}
    for item, text in items.items():
        asked = set(terms(text))
        df = {t: sum(t in b for _, b in bags) for t in asked}
        scores = []
        for i, b in bags:
            m = 50 + (50 * len(b) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b.count(t) // (1000 * b.count(t) + 20 * m)) for t in asked if t in b)
            if s > 0:
                scores.append((s, -math.inf if i is None else -i))
        for rank, (s, d) in enumerate(nlargest(top, scores), 1):
            out[item, rank] = (None if d == -math.inf else -d, s)
    return out


@pytest.mark.parametrize(("shard_bytes", "block_items", "top"), [(32 << 20, 2000, 50), (40, 2, 3)])
def test_lexical_search(spark, shard_bytes, block_items, top):
    docs = documents(spark)
    asked = {"a": "The and line is SHARED", "b": None, "c": "", "d": TEXTS[7], "e": "日本語 x", None: "word 1", "f": "nothing of this stands zzz", "g": TEXTS[6]}
    items = spark.createDataFrame([*asked.items(), ("a", "the and")], "item_id string, text string").withColumn("score", F.lit(1))
    got = lexical_search.search(lexical_search.build_index(docs, shard_bytes), items, top, block_items)
    assert got.dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got.collect()} == ranked(rows, asked, top)


def test_lexical_search_empty(spark):
    items = spark.createDataFrame([("a", "word")], "item_id string, text string")
    assert lexical_search.op12_lexical_search(empty(spark), items).count() == 0
    assert lexical_search.op12_lexical_search(documents(spark), items.limit(0)).count() == 0


def test_negative_and_large_ids(spark):
    ids = [-(2**63), -5, 0, 7, 2**63 - 1]
    docs = spark.createDataFrame([(i, "one word") for i in ids], "doc_id long, text string").coalesce(1)
    head = lexical_search.build_index(docs).where("term IS NULL").first()
    got, lengths = lexical_search.shard_documents(bytes(head["data"]))
    assert got[1:] == ids[1:] and lengths.tolist() == [2] * 5


def test_merge_skips_nothing():
    rng = random.Random(4)
    for _ in range(300):
        lists = []
        for _ in range(rng.randint(1, 6)):
            docs = sorted(rng.sample(range(60), rng.randint(1, 40)))
            scores = [rng.randint(0, 9) * rng.choice((1, 10)) for _ in docs]
            lists.append(lexical_search.Postings(docs, scores, max(scores)))
        ids = sorted(rng.sample(range(-50, 500), 60))
        heap = [(rng.randint(1, 30), -1000 - k) for k in range(rng.randint(0, 5))]
        heap.sort()
        total = {d: sum(dict(zip(x.docs, x.scores, strict=True)).get(d, 0) for x in lists) for d in range(60)}
        want = sorted(nlargest(5, heap + [(s, -ids[d]) for d, s in total.items() if s > 0]))
        lexical_search.merge_postings(lists, ids, heap, 5)
        assert sorted(heap) == want


# -- centroid clustering ----------------------------------------------------------------------


def lloyd(rows, clusters, rounds, dims, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", q) for i, q in kept)
    centroids = [q for *_, q in order[:clusters]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in kept]
        centroids = [[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := [q for (_, q), a in zip(kept, at, strict=True) if a == k]) else c for k, c in enumerate(centroids)]
    end = [(i, *near(q)) for i, q in kept]
    own = lambda k: sum(d for _, d, j in end if j == k)
    return sorted(((i, k, d, own(k), sum(x[1] for x in end), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in end), key=repr)


VECTORS = [(0, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [-3.25, 0.1]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (None, [9.0, -9.0]), (9, [0.0, 0.0]), (9, [0.0, 0.0]), (10, [1e-9, -1e-9]), (11, [100.0, 90.0]), (12, [100.0, 91.0]), (13, [1e5, 2e5])]


@pytest.mark.parametrize(("clusters", "broadcast"), [(2, True), (4, False), (30, True)])
def test_clustering(spark, monkeypatch, clusters, broadcast):
    if not broadcast:
        monkeypatch.setattr(centroid_clustering, "small", lambda *_: False)
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in VECTORS], "vec_id long, embedding array<double>, cluster int, q string")
    got = centroid_clustering.cluster_vectors(df, clusters, 5, dims=2)
    assert got.columns[:3] == ["vec_id", "embedding", "q"]
    new = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.select(new).collect()), key=repr) == lloyd(VECTORS, clusters, 5, 2)


def test_clustering_empty_and_sql(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert centroid_clustering.op13_centroid_clustering(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = centroid_clustering.op13_centroid_clustering(df).toPandas()
    want = con.execute(centroid_clustering.OP13_SQL).df()[list(got.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


# -- neighbour graph --------------------------------------------------------------------------


def nearest(rows, asks, top=20):
    """rows: id to vector; plain search over all of them."""
    out = {}
    for q in filter(asks, rows):
        scores = sorted((-math.fsum(a * b for a, b in zip(rows[q], v, strict=True)), i) for i, v in rows.items() if i != q)
        out[q] = [i for _, i in scores[:top]]
    return out


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_neighbours_edge_cases(spark):
    rng = np.random.default_rng(1)
    good = {i: (rng.normal(size=4) * 10.0 ** rng.integers(-3, 3)).tolist() for i in range(1, 60)}
    good |= dict.fromkeys(range(100, 160), [3.0, 4.0, 0.0, 0.0])  # more copies than results
    bad = [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf")] * 4), (206, [9.0] * 3), (None, [9.0] * 4)]
    rows = [*good.items(), *bad, (1, good[1])]
    df = spark.createDataFrame([(i, v, 1.5) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = neighbour_graph.nearest_neighbours(df, F.col("id") % 5 == 0, top=20)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert found(got) == nearest(good, lambda i: i % 5 == 0)
    for r in got.where("rank = 3").collect():
        assert r["score"] == pytest.approx(math.fsum(a * b for a, b in zip(good[r["query_id"]], good[r["vec_id"]], strict=True)), rel=1e-12)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert found(neighbour_graph.op11_neighbour_graph(df)) == {0: [20, 3], 20: [0, 3]}
    assert neighbour_graph.op11_neighbour_graph(df.limit(0)).count() == 0
    assert neighbour_graph.op11_neighbour_graph(df.where("vec_id = 0")).count() == 0
    assert neighbour_graph.op11_neighbour_graph(df.where("vec_id = 3")).count() == 0


def test_recall_of_descent_and_search(spark, monkeypatch):
    """Blocks, parts and beams so small that rounds of NN-descent and a walk are needed."""
    monkeypatch.setattr(neighbour_graph, "BLOCK_NODES", 64)
    monkeypatch.setattr(neighbour_graph, "PART_NODES", 200)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in df.collect()}
    asked = sorted(i for i in rows if i % 20 == 0)
    ids, matrix = np.array(list(rows)), np.array(list(rows.values()))
    got = found(neighbour_graph.nearest_neighbours(df, F.col("id") % 20 == 0, k=24, beam=64))
    hits = 0
    for q in asked:
        scores = matrix @ np.array(rows[q])
        scores[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-scores)[:20]].tolist()) & set(got[q]))
    assert sorted(got) == asked and all(len(x) == 20 for x in got.values())
    assert hits / (20 * len(asked)) >= 0.9
