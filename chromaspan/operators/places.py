"""Scores of many activity columns where pairs of genes and regions lie: a task holds the arrays of a place's regions once.

A pair is a few numbers, while a region's activities are an array. Pairs are cut into ranges of
their genes' places, so a range's regions are few, and each region's array is sent to the ranges that
ask for it instead of being carried by each of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import unbroadcast, written
from .tiles import _slices
from .vectors import _rows

#: Pairs of one piece of arithmetic.
_PIECE = 2000
#: Fields of a pair that go into the result as they are.
_KEPT = ["chr", "start", "end", "gene_id", "peak_id"]


def place_hits(pairs: DataFrame, regions: DataFrame, names: DataFrame, n: int, cutoff: float, best: bool, parts: int) -> DataFrame:
    """(chr, start, end, gene_id, gene_name, peak_id, contact, scaled_contact, share, tss_distance, hit): pairs that reach the cutoff in any of ``n`` columns.

    ``pairs`` has a row for each gene and region, with the gene's ``place`` and sums over starts
    (n_tss, c, act, ac, dist, undefined); ``regions`` has peak_id and the array ``signals``; ``names``
    has gene_id and gene_name, and genes without a name there are left out. ``hit`` has an entry for
    each column reached: its place, the signal, the score and, if ``best``, the gene's largest signal.
    A task holds the arrays and names of a range, and the pairs of one gene.
    """
    ranged = pairs.repartitionByRange(parts, "place", "gene_id").withColumn("part", F.spark_partition_id())
    ranged = written(ranged.drop("place", "top"), "pairs-by-place")
    asked = lambda key, df: unbroadcast(ranged.select("part", F.col(key).alias("k_")).distinct()).join(unbroadcast(df), F.col("k_") == F.col(key)).drop("k_")
    both = asked("peak_id", regions).withColumn("kind", F.lit(0)).unionByName(asked("gene_id", names).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = both.unionByName(ranged.where("gene_id IS NOT NULL AND peak_id IS NOT NULL").withColumn("kind", F.lit(2)), allowMissingColumns=True)
    by_part = rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "gene_id", "peak_id")
    types = dict(rows.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in [*_KEPT, "gene_name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = part = None
        for batch in _slices(batches, ["part", "kind"]):
            if batch.column("part")[0].as_py() != part:
                if place:
                    yield from place.hits(whole=True)
                place, part = _Place(n, cutoff, best), batch.column("part")[0].as_py()
            kind = batch.column("kind")[0].as_py()
            place.tables[kind].append(batch)
            if kind == 2:
                yield from place.hits()
        if place:
            yield from place.hits(whole=True)

    return by_part.mapInArrow(run, f"{head}, contact double, scaled_contact double, share double, tss_distance double, hit array<struct<i:int,signal:double,score:double,best:double>>")


class _Place:
    """A range's regions and gene names, and the pairs of a gene while they come by."""

    def __init__(self, n: int, cutoff: float, best: bool) -> None:
        self.n, self.cutoff, self.best = n, cutoff, best
        self.tables: list[list[pa.RecordBatch]] = [[], [], []]
        self.regions = None

    def _settle(self) -> None:
        """Regions and names are there before the first pair; equal keys stand side by side."""
        import numpy as np

        def keyed(batches: list, key: str, value: str):
            ids = pa.chunked_array([b.column(key) for b in batches], pa.string()).combine_chunks() if batches else pa.array([], pa.string())
            return ids, [b.column(value) for b in batches]

        ids, signals = keyed(self.tables[0], "peak_id", "signals")
        matrix = np.concatenate([_rows(s, len(s)) for s in signals]) if signals else np.zeros((0, self.n))
        self.regions = (ids, _counts(ids), matrix)
        ids, names = keyed(self.tables[1], "gene_id", "gene_name")
        self.names = (ids, _counts(ids), pa.chunked_array(names, pa.string()).combine_chunks() if names else pa.array([], pa.string()))
        self.tables[:2] = [], []

    def hits(self, whole: bool = False) -> Iterator[pa.RecordBatch]:
        """Hits of the genes that are complete, or of all."""
        held = self.tables[2]
        if not held:
            return
        if self.regions is None:
            self._settle()
        rest: list[pa.RecordBatch] = []
        if not whole:
            import pyarrow.compute as pc

            newest = held[-1]
            open_ = newest.column("gene_id")[newest.num_rows - 1]
            same = pc.sum(pc.equal(newest.column("gene_id"), open_)).as_py()  # the gene's rows are the last ones
            if same == newest.num_rows and held[0].column("gene_id")[0] == open_:
                return
            if same < newest.num_rows:
                held, rest = [*held[:-1], newest.slice(0, newest.num_rows - same)], [newest.slice(newest.num_rows - same)]
            else:
                at = next(i for i, b in enumerate(held) if b.column("gene_id")[b.num_rows - 1] == open_)
                held, rest = held[:at], held[at:]
        self.tables[2] = rest
        if held:
            yield from self._scored(pa.Table.from_batches(held).combine_chunks())

    def _scored(self, pairs: pa.Table) -> Iterator[pa.RecordBatch]:
        import numpy as np

        named, _ = _matches(pairs.column("gene_id"), *self.names[:2], once=True)
        pairs = pairs.take(pa.array(named))
        row, region = _matches(pairs.column("peak_id"), *self.regions[:2])
        if not len(row):
            return
        pairs, matrix = pairs.take(pa.array(row)), self.regions[2]
        number = lambda c: pairs.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(float)
        c, act, ac, dist, n_tss = map(number, ("c", "act", "ac", "dist", "n_tss"))
        # An undefined region makes all sums of its gene undefined.
        weight = np.where(number("undefined") > 0, np.nan, ac)
        gene = pairs.column("gene_id").combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.diff(gene, prepend=-1))
        contact, share = c / n_tss, act / n_tss
        largest = np.maximum.reduceat(contact, first)[gene]
        with np.errstate(all="ignore"):
            scaled = np.where(largest == 0, 0.0, contact * 100.0 / largest)
            total, best = np.zeros((len(first), self.n)), np.full((len(first), self.n), -np.inf)
            pieces = [slice(at, min(at + _PIECE, len(gene))) for at in range(0, len(gene), _PIECE)]
            for piece in pieces:
                own = gene[piece]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                signals = matrix[region[piece]]
                total[own[starts]] += np.add.reduceat(signals * weight[piece, None], starts, axis=0)
                if self.best:
                    best[own[starts]] = np.maximum(best[own[starts]], np.maximum.reduceat(signals, starts, axis=0))
            total[total == 0] = np.nan
            for piece in pieces:
                signals = matrix[region[piece]]
                score = signals * ac[piece, None] / total[gene[piece]]
                hit = (score >= self.cutoff) & (signals * share[piece, None] > 0)
                some = np.flatnonzero(hit.any(axis=1))
                if not len(some):
                    continue
                hit, at = hit[some], some + piece.start
                again, name = _matches(pairs.column("gene_id").take(pa.array(at)), *self.names[:2])
                if len(again) != len(some):  # a gene with several names
                    hit = hit[again]
                some, at = some[again], at[again]
                i, j = np.nonzero(hit)
                fields = [pa.array(j, pa.int32()), pa.array(signals[some[i], j]), pa.array(score[some[i], j]), pa.array(best[gene[at][i], j]) if self.best else pa.nulls(len(j), pa.float64())]
                offsets = np.concatenate([[0], np.cumsum(hit.sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["i", "signal", "score", "best"]))
                kept = [pairs.column(f).take(pa.array(at)).combine_chunks() for f in _KEPT]
                numbers = [pa.array(x[at]) for x in (contact, scaled, share, dist / n_tss)]
                yield pa.RecordBatch.from_arrays([*kept, self.names[2].take(pa.array(name)), *numbers, lists], [*_KEPT, "gene_name", "contact", "scaled_contact", "share", "tss_distance", "hit"])


def _counts(ids: pa.Array):
    """How many equal keys begin at a place."""
    import numpy as np
    import pyarrow.compute as pc

    return np.bincount(pc.index_in(ids, value_set=ids).to_numpy(zero_copy_only=False), minlength=len(ids)) if len(ids) else np.zeros(0, dtype=np.int64)


def _matches(keys, ids: pa.Array, counts, once: bool = False):
    """Rows of ``keys`` and the places of their equals in ``ids``; rows with none are left out, and those with several stand several times, but for ``once``."""
    import numpy as np
    import pyarrow.compute as pc

    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    first = pc.fill_null(pc.index_in(keys, value_set=ids), -1).to_numpy(zero_copy_only=False)
    row = np.flatnonzero(first >= 0)
    first = first[row]
    if once or (counts[first] == 1).all():
        return row, first
    n = counts[first]
    return np.repeat(row, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
