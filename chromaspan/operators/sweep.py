"""Interval joins by sweeping over slots of equal numbers of rows.

Bins of a fixed width give a wide interval many rows and a dense region few keys. Here a histogram
of starts cuts each chromosome where a slot is full, so slots are narrow where rows are dense. An
interval goes to the slots it touches, so only those across a border stand more than once. Within a
slot both sides are sorted by start: partners of an interval are a range of the other side's starts,
so the work is that of sorting plus the pairs found, and no pair is tried in vain. A pair belongs to
the slot that holds the later of its two starts. A slot that one place overfills is dealt out by
row, in a grid of parts of both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.stages import dealt, fresh, written
from .intervals import keep_places

#: Rows of both sides in a slot, width of the histogram's cells, and slots at most (their table goes to the tasks, 32 bytes each).
SLOT_ROWS, CELL, MOST_SLOTS = 100_000, 1000, 400_000
#: Pairs of one batch of results.
_PAIRS = 1 << 16
_SHIFT = 40


class Slots:
    """Where the slots of the crowded chromosomes begin, in how many parts either side of each is dealt out, and their keys."""

    def __init__(self, rows: list[tuple], buckets: int) -> None:
        """rows: (chr, start, left parts, right parts), by chr and start."""
        self.buckets, self.by_chr, key = buckets, {}, 0
        for chrom, start, a, b in rows:
            starts, parts, keys = self.by_chr.setdefault(chrom, ([], [], []))
            starts.append(start)
            parts.append((a, b))
            keys.append(key)
            key += a * b

    def deal(self, chroms: list, start, end, side: int):
        """Row numbers, keys, and whether the row starts there, for rows of one side; a row of no crowded chromosome goes to a bucket of such."""
        import zlib

        import numpy as np

        out = []
        codes: dict = {}
        group = np.array([codes.setdefault(c, len(codes)) for c in chroms], dtype=np.int64)
        for chrom, code in codes.items():
            rows = np.flatnonzero(group == code)
            if chrom not in self.by_chr:
                out.append((rows, np.full(len(rows), -1 - zlib.crc32(str(chrom).encode()) % self.buckets), np.ones(len(rows), dtype=bool)))
                continue
            starts, parts, keys = (np.array(x) for x in self.by_chr[chrom])
            first = np.maximum(0, np.searchsorted(starts, start[rows], "right") - 1)
            last = np.maximum(first, np.searchsorted(starts, np.maximum(start[rows], end[rows] - 1), "right") - 1)
            n = last - first + 1
            row, slot = np.repeat(rows, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            own = slot == np.repeat(first, n)
            # Of a grid of parts, a left row is in one line, a right row in one column.
            mine, other = parts[slot, side], parts[slot, 1 - side]
            at = row % mine
            again = np.repeat(np.arange(len(row)), other)
            step = np.arange(len(again)) - np.repeat(np.cumsum(other) - other, other)
            key = keys[slot][again] + (at[again] * parts[slot, 1][again] + step if side == 0 else step * parts[slot, 1][again] + at[again])
            out.append((row[again], key, own[again]))
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def make_slots(left: DataFrame, right: DataFrame, start: str = "start", slot_rows: int = SLOT_ROWS) -> Slots:
    """Slots from a histogram of the starts of both sides; a slot has about ``slot_rows`` rows, more where there would be over MOST_SLOTS."""
    side = lambda df, k: df.select("chr", F.floor(F.col(start) / CELL).alias("cell"), F.lit(1 - k).alias("l"), F.lit(k).alias("r"))
    cells = side(left, 0).union(side(right, 1)).where("chr IS NOT NULL AND cell IS NOT NULL").groupBy("chr", "cell").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    cells = written(cells.withColumn("n", F.col("l") + F.col("r")), "start-histogram")
    total = cells.agg(F.sum("n")).first()[0] or 0
    size = max(slot_rows, math.ceil(total / (MOST_SLOTS // 2)))
    whole = Window.partitionBy("chr")  # one row a cell: as long as the chromosome, whatever the number of intervals
    before = F.sum("n").over(whole.orderBy("cell")) - F.col("n")
    cut = cells.withColumn("all", F.sum("n").over(whole)).withColumn("slot", F.floor(before / size)).where(F.col("all") > size)
    slots = cut.groupBy("chr", "slot").agg((F.min("cell") * CELL).alias("start"), F.sum("l").alias("l"), F.sum("r").alias("r")).orderBy("chr", "start")
    parts = lambda n: max(1, math.ceil(n / (2 * size)))
    return Slots([(r["chr"], r["start"], parts(r["l"]), parts(r["r"])) for r in slots.collect()], max(1, math.ceil(total / size)))


def sweep_join(left: DataFrame, right: DataFrame, how: str = "inner", start: str = "start", end: str = "end", prefix: str = "r_", slot_rows: int = SLOT_ROWS, parts: int | None = None) -> DataFrame:
    """As ``overlap_join``: rows of ``left`` with overlapping rows of ``right`` on the same ``chr``.

    ``inner`` gives all pairs, ``left_semi`` and ``left_anti`` rows of ``left`` with and without a
    partner, each row once. Intervals of any width and places of any density; an empty interval
    overlaps what it lies strictly within; null chromosomes or bounds overlap nothing. All pairs are
    made in ``parts`` partitions, if given.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unknown join {how}")
    slots = make_slots(left, right, start, slot_rows)
    if how == "inner":
        return _swept(left, right, slots, start, end, prefix, False, parts)
    places = left.select("chr", start, end).distinct()
    return keep_places(left, _swept(places, right.select("chr", start, end), slots, start, end, prefix, True), how, start, end)


def _dealt(df: DataFrame, slots: Slots, side: int, start: str, end: str) -> DataFrame:
    """(key, side, own, row): a row for each part of a slot that an interval goes to."""
    columns = df.columns
    (row,) = fresh(df, "row_")
    packed = df.where(F.col("chr").isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            at, key, own = slots.deal(rows.field("chr").to_pylist(), rows.field(start).to_numpy(zero_copy_only=False), rows.field(end).to_numpy(zero_copy_only=False), side)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(own, pa.bool_()), rows.take(pa.array(at))], ["key", "own", "row"])

    schema = StructType([StructField("key", LongType()), StructField("own", BooleanType()), StructField("row", packed.schema[0].dataType)])
    return packed.mapInArrow(run, schema).select("key", F.lit(side).alias("side"), "own", F.col("row").alias(f"row{side}"))


def _swept(left: DataFrame, right: DataFrame, slots: Slots, start: str, end: str, prefix: str, exists: bool, parts: int | None = None) -> DataFrame:
    both = _dealt(left, slots, 0, start, end).unionByName(_dealt(right, slots, 1, start, end), allowMissingColumns=True)
    by_slot = dealt(both, parts, "key").sortWithinPartitions("key", "side")
    fields = [*left.schema.fields, *([] if exists else right.schema.fields)]
    names = [*left.columns, *([] if exists else [prefix + c for c in right.columns])]
    schema = StructType([StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            yield from _sweep(rows, start, end, exists)

    swept = by_slot.select("key", "side", "own", "row0", "row1").mapInArrow(run, schema)
    return swept.toDF(*names)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches in the order of keys."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column("key")[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _sweep(table: pa.Table, start: str, end: str, exists: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of one part of a slot, or the left rows that have any."""
    import numpy as np

    side, own = table.column("side").to_numpy(), table.column("own").to_numpy()
    n = int((side == 0).sum())  # left rows come first
    if n in (0, len(side)):
        return
    one, two = table.column("row0").combine_chunks().slice(0, n), table.column("row1").combine_chunks().slice(n)
    codes: dict = {}
    place = lambda rows: np.array([codes.setdefault(c, len(codes)) for c in rows.field("chr").to_pylist()], dtype=np.int64) << _SHIFT
    bounds = lambda rows, base: (rows.field(start).to_numpy(zero_copy_only=False) + base, rows.field(end).to_numpy(zero_copy_only=False) + base)
    (s1, e1), (s2, e2) = bounds(one, place(one)), bounds(two, place(two))
    own1, own2 = own[:n], own[n:]
    # Partners that start no earlier than a left row, then left rows that start later than a right row.
    turns = [(s1, e1, s2, own2, "left", False), (s2, e2, s1, own1, "right", True)]
    hit = np.zeros(n, dtype=bool)
    for s, e, other, owned, low_side, swapped in turns:
        order = np.flatnonzero(owned)
        order = order[np.argsort(other[order], kind="stable")]
        low = np.searchsorted(other[order], s, low_side)
        count = np.maximum(0, np.searchsorted(other[order], e, "left") - low)
        ends = np.cumsum(count)
        at = 0
        while at < len(s):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
            c = count[at:to]
            if c.any():
                first = np.repeat(np.arange(at, to), c)
                second = order[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:to], c)]
                i, j = (second, first) if swapped else (first, second)
                both = (s1[i] < e2[j]) & (s2[j] < e1[i])
                i, j = i[both], j[both]
                if exists:
                    hit[i] = True
                elif len(i):
                    columns = [*one.take(pa.array(i)).flatten(), *two.take(pa.array(j)).flatten()]
                    yield pa.RecordBatch.from_arrays(columns, [f"f{k}" for k in range(len(columns))])
            at = to
    if exists and hit.any():
        columns = one.take(pa.array(np.flatnonzero(hit))).flatten()
        yield pa.RecordBatch.from_arrays(columns, [f"f{k}" for k in range(len(columns))])
