"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, keeper), bucketed and sorted by line hash: how many documents held
the line, and the largest doc_id among them. Batches arrive in descending doc_id order. A new batch
is merge-anti-joined against each run in turn, which leaves out lines that a run knows to be frequent
and to have a keeper, and what remains becomes a run of level 0. When a level holds ``fanout`` runs,
these are merged into one run of the next level. All runs have the same buckets, one sorted file
each, so joins and merges read them in order: only a batch is shuffled, never a run. Dropping then
needs only the frequent keys.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, scratch, slices

MIN_CHARS, MIN_DOCS = 20, 3
#: Rows of a batch, and the least number of batches.
BATCH_ROWS, LEAST_BATCHES = 1 << 28, 3
#: What bytes.strip() takes off: the ASCII white space of the line rule.
_STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """A line's key: stripped, A-Z lowered; None if it has fewer than ``min_chars`` code points."""
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_hash, h1, h2) for each distinct long line of each row; the hash has 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            at, digests = [], []
            for a, b in slices(batch.column("text")):
                for i, text in enumerate(batch.column("text").slice(a, b - a).cast(pa.binary()).to_pylist(), a):
                    if text and len(text) >= min_chars:
                        found = {xxhash.xxh3_128_digest(k) for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}
                        at.extend([i] * len(found))
                        digests.extend(found)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            rows = batch.select(["doc_id", "row_hash"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "row_hash", "h1", "h2"])

    return docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text").mapInArrow(run, "doc_id long, row_hash long, h1 long, h2 long")


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Within it Spark takes the order of bucketed files as given, if a bucket is one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levelled runs in the shared folder; ``add`` takes batches in descending doc_id order.

    Runs have as many buckets as shuffles have partitions. Their names are in the session's catalog
    until ``close``.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = scratch(spark, "line-runs")
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's own limit
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    @property
    def written(self) -> int:
        return len(self.names)

    def _merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """Two runs merged in the order of their files. (A union would do, but of two columnar bucketed scans Spark 4.1 groups each alone.)"""
        a, b = one.alias("a"), other.alias("b").hint("merge")
        sums = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
        return a.join(b, ["h1", "h2"], "full").select("h1", "h2", sums.alias("n_docs"), F.greatest("a.keeper", "b.keeper").alias("keeper"))

    def _write(self, run: DataFrame) -> str:
        name = f"{self.name}_{self.written}"
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/run-{self.written}").saveAsTable(name, format="parquet")
        self.names.append(name)
        return name

    def _merge(self, names: list[str]) -> DataFrame:
        """All of these runs as one; each step but the last is written, for then it has buckets again."""
        last = names[-1]
        if len(names) == 1:
            return self.spark.table(last)
        rest = reduce(lambda x, y: self._write(self._merged(self.spark.table(x), self.spark.table(y))), names[:-1])
        return self._merged(self.spark.table(rest), self.spark.table(last))

    def runs(self) -> list[str]:
        """Names of the runs, small ones first."""
        return [name for level in self.levels for name in level]

    def known(self) -> DataFrame:
        """Lines that at least ``min_docs`` documents hold, with their keeper; a written table."""
        with sorted_buckets(self.spark):
            return materialise(self._merge(self.runs()).where(F.col("n_docs") >= self.min_docs), "frequent-lines")

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """A batch of ``line_hashes``, summed up by line, without lines that a run knows to be frequent and to have a keeper."""
        batch = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        for name in self.runs():
            k = self.spark.table(name).where(F.col("n_docs") >= self.min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("keeper").alias("k_keeper"))
            settled = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.coalesce("keeper", F.col("k_keeper")) <= F.col("k_keeper"))
            batch = batch.join(k.hint("merge"), settled, "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``line_hashes``; each of its rows counts as a document."""
        with sorted_buckets(self.spark):
            new, level = self._write(self.unsettled(lines)), 0
            while True:
                if len(self.levels) <= level:
                    self.levels.append([])
                self.levels[level].append(new)
                if len(self.levels[level]) < self.fanout:
                    break
                full, self.levels[level] = self.levels[level], []
                new, level = self._write(self._merge(full)), level + 1

    def close(self) -> None:
        """Takes the names of the runs out of the catalog; files stay until the shared folder is cleared."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def build_runs(docs: DataFrame, batches: int | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineRuns:
    """Runs over all of ``docs``, taken in ``batches`` slices of descending doc_id; by default one for each ``BATCH_ROWS`` rows, and three at least."""
    runs = LineRuns(docs.sparkSession, min_docs)
    batches = batches or max(LEAST_BATCHES, math.ceil(docs.count() / BATCH_ROWS))
    edges = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else None
    edges = sorted(set(edges or []))
    for low, high in zip([*reversed(edges), None], [None, *reversed(edges)], strict=True):
        part: Column = F.lit(True)
        if high is not None:
            part = part & (F.col("doc_id") < high) if low is not None else (F.col("doc_id") < high) | F.col("doc_id").isNull()
        if low is not None:
            part = part & (F.col("doc_id") >= low)
        runs.add(line_hashes(docs.where(part), min_chars))
    return runs


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) plus the other columns of ``docs``: lines whose key has at
    least ``min_chars`` code points and is in at least ``min_docs`` rows stay only in the row with
    the largest doc_id that holds them.

    A null or empty text is one empty line and comes back as an empty text. Repeated rows count as
    documents of their own and, sharing a doc_id, keep or lose a line together. A null doc_id is
    smaller than any other and never a keeper, unless no holder has a doc_id: then all keep the
    line. Very long texts are taken whole, one at a time. An empty table gives an empty result.
    Columns named like the new ones are replaced; others may have any name.
    """
    docs = docs.drop("n_lines", "n_dropped")
    (new,) = fresh(docs, "new")
    return docs_without_lines(docs, new, min_chars, min_docs, batches).select(*[F.col(f"{new}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], f"{new}.n_lines", f"{new}.n_dropped")


def docs_without_lines(docs: DataFrame, name: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus ``name``, a struct of text, n_lines and n_dropped as in ``dedup_lines``; only texts go through Python."""
    runs = build_runs(docs, batches, min_chars, min_docs)
    frequent = runs.known().where(F.col("keeper").isNotNull())
    runs.close()
    f = frequent.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "keeper")
    losing = line_hashes(docs, min_chars).join(f, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")) & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    i, h, h1, h2 = fresh(docs, "id_", "hash_", "lost1_", "lost2_")
    lost = losing.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("l"))
    lost = lost.select(F.col("doc_id").alias(i), F.col("row_hash").alias(h), F.transform("l", lambda x: x["h1"]).alias(h1), F.transform("l", lambda x: x["h2"]).alias(h2))
    marked = docs.join(lost, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left")

    def rewrite(texts: pa.Array, lost1: pa.Array, lost2: pa.Array) -> pa.Array:
        import struct

        import xxhash

        new, n_lines, n_dropped = [], [], []
        for a, b in slices(texts):
            rest, part = [], [c.slice(a, b - a) for c in (texts.cast(pa.binary()), lost1, lost2)]
            for text, one, two in zip(*[c.to_pylist() for c in part], strict=True):
                lines = kept = (text or b"").split(b"\n")
                if one:
                    gone = {struct.pack("<qq", x, y) for x, y in zip(one, two, strict=True)}
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                rest.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            new.append(pa.array(rest, pa.binary()).cast(pa.string()))
        text = pa.concat_arrays(new) if new else pa.array([], pa.string())
        return pa.StructArray.from_arrays([text, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    rewritten = F.arrow_udf(rewrite, "text string, n_lines long, n_dropped long").asNondeterministic()
    return marked.withColumn(name, rewritten("text", h1, h2)).drop(i, h, h1, h2)


def op10_line_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for op10: the same rule on whole line keys.
OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l AS line, trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS stripped
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""
