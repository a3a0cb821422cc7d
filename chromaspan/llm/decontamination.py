"""Benchmark decontamination: windows of test items, looked up in every document.

The hashes of all distinct item windows are broadcast (8 bytes each, behind a check of their
number). Documents become arrays of words; each place's window is sliced, hashed and probed within
one generated stage, so nothing but candidates leaves it. Candidates are verified word by word
against the true windows, and what is verified yields hit words, items, spans or documents. Whole
texts count, however long: a place leaves its document as (doc_id, hash, place, window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEPARATORS, ascii_lower, bounded, fresh, let, materialise, small, words

WINDOW = 10
#: Up to so many distinct windows are broadcast (about 40 bytes each in the hash table); beyond, the places go to the windows by shuffle.
BROADCAST_WINDOWS = 2_000_000
#: Bytes of a document's hash, and of a span or item id, in a broadcast table.
KEY_BYTES, PART_BYTES = 60, 40
#: A word of the original text, before A-Z is lowered.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, len, h, gram): distinct windows of each item; a shorter item is one window, a null or empty one has none."""
    items = benchmark.select("item_id", words(ascii_lower(F.col("text")), ALNUM_SEPARATORS).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length)))
    return items.select("item_id", gram.alias("g")).select("item_id", F.size("g").alias("len"), F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("gram")).distinct()


def find_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, row_hash, at, len, h, gram): verified places of item windows, at counted in words from 0."""
    grams = windows.select("h", "gram", "len").distinct()
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # at most the window size
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), words(ascii_lower(F.col("text")), ALNUM_SEPARATORS).alias("w"))
    if len(lengths) == 1:
        rows = rows.withColumn("len", F.lit(lengths[0]))
    else:
        rows = rows.withColumn("len", F.explode(F.array(*map(F.lit, lengths)))) if lengths else rows.withColumn("len", F.lit(1)).where(F.lit(False))
    places = rows.where(F.size("w") >= F.col("len")).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))))
    window = F.slice("w", F.col("at") + 1, F.col("len"))
    found = places.withColumn("h", F.xxhash64(window))
    hashes = grams.select(F.col("h").alias("probe")).distinct()
    if hashes.count() <= BROADCAST_WINDOWS:
        found = found.join(F.broadcast(hashes), F.col("h") == F.col("probe"))
    found = found.select("doc_id", "row_hash", "at", "len", "h", F.array_join(window, " ").alias("gram"))
    true = grams.select(F.col("h").alias("h2"), F.col("gram").alias("gram2"))
    return found.join(true, (F.col("h") == F.col("h2")) & (F.col("gram") == F.col("gram2"))).drop("h2", "gram2")


def union_of(spans: Column) -> Column:
    """Disjoint (at, end) intervals, ascending, that cover the given (at, len) intervals."""
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))))

    def runs(p: Column) -> Column:
        starts = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1) != x - 1, F.lit(True)))
        ends = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b + 1).alias("end")))

    return let(places, runs)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, row_hash, spans, n_hit, items) for each row with a hit; row_hash is xxhash64(text).

    Repeated rows share a result; a null doc_id is a value like any other; null texts and texts
    without words have no hits; an empty benchmark or table gives an empty result.
    """
    windows = materialise(item_windows(benchmark, n), "item-windows")
    hits = materialise(find_hits(docs, windows), "window-hits")
    key = ["doc_id", "row_hash"]
    spans = hits.groupBy(*key).agg(F.collect_set(F.struct("at", "len")).alias("s")).select(*key, union_of(F.col("s")).alias("spans"))
    spans = spans.withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["at"]))
    w = windows.select(F.col("h").alias("h2"), F.col("gram").alias("gram2"), "item_id")
    items = hits.select(*key, "h", "gram").distinct().join(w, (F.col("h") == F.col("h2")) & (F.col("gram") == F.col("gram2")))
    items = items.groupBy(F.col("doc_id").alias("i_id"), F.col("row_hash").alias("i_hash")).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    same = F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("row_hash") == F.col("i_hash"))
    return spans.join(items, same).select(*key, "spans", "n_hit", F.array_sort("items").alias("items"))


def _join_hits(docs: DataFrame, row_hash: Column, found: DataFrame) -> DataFrame:
    """``docs`` with hit_spans, n_hit and hit_items from ``contamination``, which is broadcast if it is small by count."""
    i, h, n = fresh(docs, "id_", "hash_", "hits_")
    found = materialise(found.select(F.col("doc_id").alias(i), F.col("row_hash").alias(h), F.col("spans").alias("hit_spans"), F.col("n_hit").cast("long").alias(n), F.col("items").alias("hit_items")), "contaminated")
    size = found.agg(F.count("*"), F.sum(F.size("hit_spans") + F.size("hit_items"))).first()
    if small(size[0], KEY_BYTES) and small(size[1] or 0, PART_BYTES):
        found = F.broadcast(found)
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(i)) & (row_hash == F.col(h)), "left")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], "hit_spans", F.coalesce(n, F.lit(0)).alias("n_hit"), "hit_items")


def mark(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with ``hit_spans``, ``n_hit`` and ``hit_items`` (null, 0 and null without a hit).

    Columns named like the new ones are replaced; others may have any name. Nulls, repeated rows, very
    long texts (taken whole) and empty tables are as in ``contamination``.
    """
    docs = docs.drop("hit_spans", "n_hit", "hit_items")
    return _join_hits(docs, F.xxhash64("text"), contamination(docs, benchmark, n))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which an item window occurs.

    Rows with a null or empty text stay; repeated rows stay or go together; an empty benchmark
    removes nothing; very long texts are looked at whole; columns may have any name. The list of hit
    rows is broadcast if it is small.
    """
    i, h = fresh(docs, "id_", "hash_")
    found = materialise(contamination(docs, benchmark, n).select(F.col("doc_id").alias(i), F.col("row_hash").alias(h)), "contaminated")
    return docs.join(bounded(found, KEY_BYTES), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words taken out of their texts; all other characters stay, and so do null texts.

    Repeated rows are cut alike, very long texts whole; an empty table gives an empty result; columns may have any name.
    """
    (found,) = fresh(docs, "found")
    text = F.coalesce("text", F.lit(""))

    def cut(spans: Column, ws: Column) -> Column:
        after = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        parts = F.transform(spans, lambda x, i: F.concat(F.slice(ws, after(i) + 1, x["at"] - after(i)), F.array_repeat(F.lit(""), x["end"] - x["at"])))
        kept = F.concat(F.flatten(parts), F.slice(ws, after(F.size(spans)) + 1, F.size(ws)))
        return let(kept, lambda k: F.array_join(F.transform(F.split(text, _WORD, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(k, i), F.lit("")))), ""))

    hits = contamination(docs, benchmark, n)
    (i, h) = fresh(docs, "id_", "hash_")
    hits = materialise(hits.select(F.col("doc_id").alias(i), F.col("row_hash").alias(h), F.col("spans").alias(found)), "hit-spans")
    joined = docs.join(hits, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left")
    clean = F.when(F.col(found).isNotNull(), let(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda ws: cut(F.col(found), ws))).otherwise(F.col("text"))
    return joined.select(*[clean.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op1_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    # Only hashes of texts meet the hits, so no text is shuffled.
    n_words = F.size(words(ascii_lower(F.col("text")), ALNUM_SEPARATORS)).cast("long")
    counted = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), n_words.alias("n_words"))
    marked = _join_hits(counted, F.col("row_hash"), contamination(docs, benchmark))
    items = F.coalesce("hit_items", F.array().cast("array<string>"))
    return marked.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB SQL for op1: the same windows as lists of words, joined whole.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)
), h AS (SELECT doc_id, item_id, i, p.k AS k FROM p JOIN g ON p.gram = g.gram AND p.k = g.k
), n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id
), m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
