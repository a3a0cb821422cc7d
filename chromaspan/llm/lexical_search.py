"""Ranked lexical search: compressed postings by shard, merged document at a time.

The index is built where the texts are read: each task cuts its documents into shards of bounded
size, sorts a shard by doc_id and writes one row a term (gaps of places and term counts as
variable-length integers) and one row with the shard's doc_ids and lengths. No text is shuffled.
A search takes the rows of the asked terms, brings each shard's together and merges the postings of
each item with a heap, document at a time. The best documents stand in a bounded heap keyed by score,
then doc_id; lists whose largest scores together cannot reach its least entry are no longer merged,
but looked up for the documents that the others give. The shards' heaps are merged at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_SEPARATORS, ascii_lower, materialise, small, words

TOP, SHARD_BYTES = 50, 32 << 20
#: Items of one block of a search; a task holds the heaps of one block at a time.
BLOCK_ITEMS = 2000
#: Bytes of text that are cut into terms at once.
_PIECE = 1 << 20
#: The term rule on UTF-8: A-Z lowered, digits, letters and everything beyond ASCII kept, the rest a blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "shard long, term string, n long, total long, data binary"


def pack(values) -> tuple[bytes, object]:
    """Unsigned integers as bytes of seven bits, low ones first; also where each value ends."""
    import numpy as np

    values = np.asarray(values, dtype=np.uint64)
    sizes = np.ones(len(values), dtype=np.int64)
    rest = values >> np.uint64(7)
    while rest.any():
        sizes += rest > 0
        rest >>= np.uint64(7)
    ends = np.cumsum(sizes)
    out, starts = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8), ends - sizes
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        part = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[starts[own] + k] = part | np.where(sizes[own] > k + 1, np.uint64(128), np.uint64(0))
    return out.tobytes(), ends


def unpack(data: bytes):
    """The integers of ``pack``."""
    import numpy as np

    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    sizes, out = ends - starts + 1, np.zeros(len(ends), dtype=np.uint64)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        out[own] |= (raw[starts[own] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def term_counts(text: str | None) -> dict[bytes, int]:
    """How often each term stands in the whole text, cut piece by piece."""
    from collections import Counter

    raw, counts, at = (text or "").encode().translate(_TERMS), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split())
        at = end
    return counts


class _Shard:
    """Documents of one shard while it is gathered."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.terms: list[list[int]] = []
        self.counts: list[list[int]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        counts = term_counts(text)
        self.bytes += len(text or "")
        if counts:
            known = self.vocabulary
            self.ids.append(doc_id)
            self.terms.append([known.setdefault(t, len(known)) for t in counts])
            self.counts.append(list(counts.values()))

    def rows(self, shard: int) -> pa.RecordBatch:
        """The shard's document row (term null), then a row for each term in order."""
        import numpy as np

        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        ids = [self.ids[i] for i in order if self.ids[i] is not None]
        sizes = np.array([len(self.terms[i]) for i in order])
        lengths = [sum(self.counts[i]) for i in order]
        names = sorted(self.vocabulary)
        place = np.empty(len(names), dtype=np.int64)
        place[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        term = place[np.concatenate([self.terms[i] for i in order])]
        count, doc = np.concatenate([self.counts[i] for i in order]), np.repeat(np.arange(len(order)), sizes)
        by = np.argsort(term, kind="stable")  # documents stay in order
        term, count, doc = term[by], count[by], doc[by]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        gaps = np.diff(doc, prepend=0)
        gaps[first] = doc[first]
        data, ends = pack(np.stack([gaps, count], axis=1).ravel())
        n = np.diff(np.append(first, len(term)))
        cuts = np.concatenate(([0], ends[2 * (first + n) - 1])).astype(np.int64)
        postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data)])
        low = ids[0] if ids else 0
        steps = [b - a for a, b in zip(ids, ids[1:], strict=False)]
        head, _ = pack([len(ids), (low << 1) ^ (low >> 63), *steps, *lengths])  # the first id by zigzag, for it may be negative
        columns = [
            pa.array([shard] * (len(names) + 1), pa.int64()), pa.array([None, *(t.decode() for t in names)], pa.string()), pa.array([len(order), *n.tolist()], pa.int64()),
            pa.array([sum(lengths), *np.add.reduceat(count, first).tolist()], pa.int64()), pa.concat_arrays([pa.array([head], pa.large_binary()), postings]).cast(pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n", "total", "data"])


def shard_documents(data: bytes):
    """The doc_ids (None last) and lengths of a shard's document row."""
    import numpy as np

    values = unpack(data)
    k, low = int(values[0]), int(values[1]) & 0xFFFFFFFFFFFFFFFF
    low = (low >> 1) ^ -(low & 1)
    ids = [low, *(low + np.cumsum(values[2 : k + 1])).tolist()][:k]
    lengths = values[2 + max(0, k - 1) :]
    return [*ids, *[None] * (len(lengths) - k)], lengths


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, term, n, total, data), written: postings of all terms of all documents, and each shard's documents (term null).

    ``n`` counts documents, ``total`` terms with repeats. Documents without a term (null and empty
    texts among them) are not in the index. Repeated rows are documents of their own; rows without a
    doc_id come last in their shard. A very long text is cut into terms piece by piece, and its shard
    ends after it. An empty table gives an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.bytes >= shard_bytes and shard.ids:
                    yield shard.rows(made)
                    shard, made = _Shard(), made + 1
        if shard.ids:
            yield shard.rows(made)

    return materialise(docs.select("doc_id", "text").mapInArrow(run, INDEX), "lexical-index")


class Postings(NamedTuple):
    """One item's list: places of documents in a shard, their scores, and the largest of these."""

    docs: list[int]
    scores: list[int]
    most: int


def merge_postings(lists: list[Postings], ids: list[int | None], heap: list[tuple], top: int) -> None:
    """Puts the best documents of a shard into ``heap``, whose least entry is the lowest score, then the largest doc_id."""
    from bisect import bisect_left
    from heapq import heapify, heappop, heappush, heapreplace

    lists = sorted((x for x in lists if x.most > 0), key=lambda x: x.most)
    reach, total = [], 0  # what the lists up to each one can add at most
    for x in lists:
        total += x.most
        reach.append(total)
    merged = 0  # lists before this one are only looked up
    if len(heap) >= top:
        while merged < len(lists) and reach[merged] < heap[0][0]:
            merged += 1
    at = [0] * len(lists)
    heads = [(x.docs[0], j) for j, x in enumerate(lists) if j >= merged]
    heapify(heads)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            j = heads[0][1]
            docs, p = lists[j].docs, at[j]
            score += lists[j].scores[p]
            at[j] = p = p + 1
            if p < len(docs):
                heapreplace(heads, (docs[p], j))
            else:
                heappop(heads)
        full = len(heap) >= top
        for j in range(merged - 1, -1, -1):
            if full and score + reach[j] < heap[0][0]:
                break
            docs = lists[j].docs
            at[j] = p = bisect_left(docs, doc, at[j])
            if p < len(docs) and docs[p] == doc:
                score += lists[j].scores[p]
        else:
            own = ids[doc]
            entry = (score, -math.inf if own is None else -own)
            if score <= 0:
                continue
            if not full:
                heappush(heap, entry)
            elif entry > heap[0]:
                heapreplace(heap, entry)
            else:
                continue
            if len(heap) >= top:
                before = merged
                while merged < len(lists) and reach[merged] < heap[0][0]:
                    merged += 1
                if merged > before:
                    heads = [h for h in heads if h[1] >= merged]
                    heapify(heads)


def search(index: DataFrame, items: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, equal scores by ascending doc_id.

    Rows of one item_id are one item with the terms of all of them; a null item_id is an item too.
    Items without a term of the index (null and empty texts) have no rows. Equal texts score alike;
    repeated rows of documents have a rank each; those without a doc_id follow equal scores. An empty
    index or no items give an empty result. Other columns are not looked at.
    """
    whole = index.where(F.col("term").isNull()).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n_docs, n_terms = whole["n"] or 0, whole["total"] or 1
    terms = items.select("item_id", F.explode(F.array_distinct(words(ascii_lower(F.col("text")), ALNUM_SEPARATORS))).alias("t")).distinct()
    n_items = terms.select("item_id").distinct().count()
    blocks = max(1, math.ceil(n_items / block_items))
    # A term's items of one block are one row, so a row holds no more than a block.
    asked = materialise(terms.groupBy("t", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("item_id")).alias("items")), "asked-terms")
    asked_bytes = asked.count() * 100 + terms.count() * 60
    marked = F.broadcast(asked) if small(1, asked_bytes) else asked
    found = index.where(F.col("term").isNotNull()).join(marked, F.col("term") == F.col("t"))
    df = materialise(index.where(F.col("term").isNotNull()).join(marked, F.col("term") == F.col("t"), "left_semi").groupBy("term").agg(F.sum("n").alias("df")), "term-counts")
    weight = F.floor(F.log((F.lit(2) * n_docs + 2).cast("double") / (2 * F.col("df") + 1)) * 1000)
    weighed = df.select(F.col("term").alias("t2"), weight.alias("w"))
    weighed = F.broadcast(weighed) if small(df.count(), 60) else weighed
    lists = found.join(weighed, F.col("term") == F.col("t2")).select("block", "shard", "term", "w", "items", "data")
    heads = index.where(F.col("term").isNull()).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "term", F.lit(0).cast("long").alias("w"), F.lit(None).cast("array<struct<item_id:string>>").alias("items"), "data")
    kind = dict(terms.dtypes)["item_id"]
    heads = heads.withColumn("items", F.col("items").cast(f"array<struct<item_id:{kind}>>"))
    dealt = lists.unionByName(heads).repartition("block", "shard").sortWithinPartitions("block", "shard", F.col("term").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict = {}

        def result() -> pa.RecordBatch:
            rows = [(item, None if d == -math.inf else -d, score) for item, heap in heaps.items() for score, d in heap]
            item_ids, docs, scores = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(item_ids, own_type), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

        own_type, block, asked_here = pa.string(), None, {}
        shard, ids, factor = None, [], None
        for batch in batches:
            own_type = batch.schema.field("items").type.value_type.field("item_id").type
            for row_block, row_shard, term, w, members, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (row_block, row_shard) != (block, shard):
                    for item, lists in asked_here.items():
                        merge_postings(lists, ids, heaps.setdefault(item, []), top)
                    if row_block != block and heaps:
                        yield result()
                        heaps = {}
                    block, shard, asked_here = row_block, row_shard, {}
                if term is None:
                    ids, lengths = shard_documents(data)
                    factor = document_factor(lengths, n_docs, n_terms)
                else:
                    postings = term_postings(data, w, factor)
                    for member in members:
                        asked_here.setdefault(member["item_id"], []).append(postings)
        for item, lists in asked_here.items():
            merge_postings(lists, ids, heaps.setdefault(item, []), top)
        if heaps:
            yield result()

    best = dealt.mapInArrow(run, f"item_id {kind}, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def document_factor(lengths, n_docs: int, n_terms: int):
    """m of each document: 100 - 50 + (50 * n * N) div L."""
    import numpy as np

    wide = int(lengths.max(initial=0)) * 50 * n_docs >= 1 << 62
    return 50 + ((lengths.astype(object) if wide else lengths) * (50 * n_docs) // n_terms).astype(np.int64)


def term_postings(data: bytes, w: int, factor) -> Postings:
    """A term's documents in a shard and their scores w * ((10^9 * tf) div (1000 * tf + 20 * m))."""
    import numpy as np

    pairs = unpack(data).reshape(-1, 2)
    docs, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
    scores = w * (1_000_000_000 * tf // (1000 * tf + 20 * factor[docs]))
    return Postings(docs.tolist(), scores.tolist(), int(scores.max()))


def op12_lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build_index(docs), items)


#: DuckDB SQL for op12.
OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM documents
), counts AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lengths),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY t, nn),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score FROM asked JOIN weights USING (t) JOIN counts USING (t) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 50
"""
