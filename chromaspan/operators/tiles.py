"""Contacts as square tiles: packed cells by chromosome, tile row and tile column.

A contact matrix is looked up by pairs that lie close together, so its cells are kept close together
too: a tile is one row with the sorted keys of its cells and their values. Pairs are dealt to tiles
and stream past theirs, one binary search each, instead of meeting cells in a join of as many rows
as there are cells. The tiles lie in a folder for each chromosome and stripe of rows, so what no
pair can ask for is not read. The table is built once and serves any number of runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.stages import dealt, fresh, parts_for, shared_folder, written_and_counted
from . import contacts as C

#: Bins of a tile's side, and tile rows of a stripe.
SIDE, STRIPE = 256, 16
#: Folders of stripes; where there would be more, stripes are so many times as wide.
MOST_STRIPES = 1024
_TILES = "chr string, tile_row long, tile_col long, keys array<int>, contacts array<double>, stripe long"
#: Bytes of a cell on its way to its tile.
_CELL_BYTES = 100
_FIT = "chr string, slope double, intercept double"


@dataclass(frozen=True)
class ContactTiles:
    """A folder of tiles and its measures; ``fit`` is each chromosome's power law, null where there is none."""

    spark: SparkSession
    path: str
    bin_size: int
    side: int
    stripe: int

    def tiles(self) -> DataFrame:
        """(chr, tile_row, tile_col, keys, contacts, stripe): keys are row * side + column within the tile, ascending."""
        return self.spark.read.schema(_TILES).parquet(f"{self.path}/tiles")

    def fit(self) -> DataFrame:
        return self.spark.read.schema(_FIT).parquet(f"{self.path}/fit")

    def cells(self) -> DataFrame:
        """(chr, bin1, bin2, contact) of all tiles."""
        one = F.arrays_zip("keys", "contacts")
        rows = self.tiles().select("chr", "tile_row", "tile_col", F.explode(one).alias("x"))
        row, col = F.floor(F.col("x.keys") / self.side), F.col("x.keys") % self.side
        return rows.select("chr", (F.col("tile_row") * self.side + row).alias("bin1"), (F.col("tile_col") * self.side + col).alias("bin2"), F.col("x.contacts").alias("contact"))


def write_tiles(cells: DataFrame, bin_size: int, path: str | None = None, side: int = SIDE, stripe: int = STRIPE) -> ContactTiles:
    """Tiles of canonical cells (chr, bin1, bin2, contact[, ord]), with the diagonal of ``contacts.with_diagonal``.

    Of repeated cells the last by ``ord`` is taken, while all of them count in the fit. A border
    cell next to the diagonal belongs to a tile of its own but also sets the diagonal of the tiles on
    both sides, so it is sent there as well. Cells arrive in order and are packed as they stream by.
    A stripe is dealt by squares of as many tile columns as it has rows, so a folder gets few files
    and a full matrix many tasks; ``stripe`` grows where there would be more than MOST_STRIPES folders.
    """
    spark = cells.sparkSession
    path = path or shared_folder(spark, "contact-tiles")
    if "ord" not in cells.columns:
        cells = cells.withColumn("ord", F.lit(0).cast("long"))
    cells, n_cells = written_and_counted(cells, "cells")  # read by the fit, the spans and the tiles
    C.power_law(cells, bin_size).write.parquet(f"{path}/fit")
    rows_of = F.floor(F.col("max_bin") / (side * stripe)) - F.floor(F.col("min_bin") / (side * stripe)) + 1
    stripe *= -(-(C.span(cells).agg(F.sum(rows_of)).first()[0] or 1) // MOST_STRIPES)
    tile = lambda b: F.floor(F.col(b) / side).cast("long")
    own = F.struct(tile("bin1").alias("tile_row"), tile("bin2").alias("tile_col"))
    border = [F.struct(tile(b).alias("tile_row"), tile(b).alias("tile_col")) for b in ("bin1", "bin2")]
    to = F.when((F.col("bin2") == F.col("bin1") + 1) & (F.col("bin2") % side == 0), F.array(own, *border)).otherwise(F.array(own))
    rows = cells.select("chr", F.explode(to).alias("t"), "bin1", "bin2", F.col("ord").cast("long").alias("ord"), "contact")
    rows = rows.select("chr", "t.tile_row", "t.tile_col", "bin1", "bin2", "ord", "contact")
    square = [F.floor(F.col(c) / stripe) for c in ("tile_row", "tile_col")]
    by_tile = dealt(rows, parts_for(spark, n_cells * _CELL_BYTES), "chr", *square).sortWithinPartitions("chr", "tile_row", "tile_col", "bin1", "bin2", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chrom, row, col), table in _runs(batches, ["chr", "tile_row", "tile_col"]):
            keys, values = pack_tile(*[table.column(c).to_numpy() for c in ("bin1", "bin2", "contact")], row, col, side)
            if len(keys):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(x, t)) for x, t in ((keys, pa.int32()), (values, pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array([chrom], pa.string()), *[pa.array([x], pa.int64()) for x in (row, col)], *lists, pa.array([row // stripe], pa.int64())], ["chr", "tile_row", "tile_col", "keys", "contacts", "stripe"])

    by_tile.mapInArrow(run, _TILES).write.partitionBy("chr", "stripe").parquet(f"{path}/tiles")
    return ContactTiles(spark, path, bin_size, side, stripe)


def pack_tile(bin1, bin2, contact, row: int, col: int, side: int):
    """Keys and values of one tile from its cells in order of (bin1, bin2, ord), border cells among them: the last of each cell, and the diagonal from its neighbours."""
    import numpy as np

    last = np.ones(len(bin1), dtype=bool)
    last[:-1] = (bin1[1:] != bin1[:-1]) | (bin2[1:] != bin2[:-1])
    bin1, bin2, contact = bin1[last], bin2[last], contact[last]
    here = (bin1 // side == row) & (bin2 // side == col) & (bin1 != bin2)
    keys, values = (bin1[here] - row * side) * side + bin2[here] - col * side, contact[here]
    if row == col:
        near = bin2 == bin1 + 1
        bins, beside = np.concatenate([bin1[near], bin2[near]]) - row * side, np.concatenate([contact[near]] * 2)
        inside = (bins >= 0) & (bins < side)
        diagonal = np.full(side, -np.inf)
        np.maximum.at(diagonal, bins[inside], beside[inside])
        found = np.flatnonzero(diagonal > -np.inf)
        keys, values = np.concatenate([keys, found * side + found]), np.concatenate([values, diagonal[found]])
        by = np.argsort(keys, kind="stable")
        keys, values = keys[by], values[by]
    return keys, values


def lookup_tiles(pairs: DataFrame, tiles: ContactTiles, bin_a: str, bin_b: str, parts: int | None = None) -> DataFrame:
    """``pairs`` (chr and two bins) with ``contact``, 0 where there is no cell; as ``contacts.lookup``.

    Only stripes that a pair can fall into are read. Tiles and pairs are dealt by tile; within a
    task a tile comes first and its pairs stream past it, however many they are. Pairs without a
    chromosome or bin have 0. The pairs go to ``parts`` partitions, if given.
    """
    keep = pairs.columns
    (row,) = fresh(pairs, "row_")
    low, high = F.least(bin_a, bin_b), F.greatest(bin_a, bin_b)
    known = F.col("chr").isNotNull() & F.col(bin_a).isNotNull() & F.col(bin_b).isNotNull()
    at = lambda b: F.floor(b / tiles.side).cast("long")
    key = (low - at(low) * tiles.side) * tiles.side + high - at(high) * tiles.side
    asked = pairs.select(F.col("chr").alias("c"), F.when(known, at(low)).alias("tr"), F.when(known, at(high)).alias("tc"), F.lit(1).alias("kind"), F.when(known, key).otherwise(F.lit(-1)).cast("int").alias("key"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias(row))
    packed = needed_tiles(tiles, pairs.where(known).select("chr", low.alias("low"))).select(F.col("chr").alias("c"), F.col("tile_row").alias("tr"), F.col("tile_col").alias("tc"), F.lit(0).alias("kind"), "keys", "contacts")
    both = packed.unionByName(asked, allowMissingColumns=True)
    by_tile = dealt(both, parts, "c", "tr", "tc").sortWithinPartitions("c", "tr", "tc", "kind").select("c", "tr", "tc", "kind", "key", "keys", "contacts", row)
    kind = asked.schema[row].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tile, keys, values = None, np.zeros(0, dtype=np.int32), np.zeros(0)
        for batch in _slices(batches, ["c", "tr", "tc", "kind"]):
            name = tuple(batch.column(i)[0].as_py() for i in range(3))
            if name != tile:
                tile, keys, values = name, np.zeros(0, dtype=np.int32), np.zeros(0)
            if batch.column("kind")[0].as_py() == 0:
                keys, values = (batch.column(c).flatten().to_numpy() for c in ("keys", "contacts"))
                continue
            asked_ = batch.column("key").to_numpy()
            place = np.minimum(np.searchsorted(keys, asked_), max(0, len(keys) - 1))
            found = keys[place] == asked_ if len(keys) else np.zeros(len(asked_), dtype=bool)
            contact = np.where(found, values[place], 0.0) if len(keys) else np.zeros(len(asked_))
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.array(contact)], ["row", "contact"])

    looked = by_tile.mapInArrow(run, StructType([StructField("row", kind), StructField("contact", DoubleType())]))
    return looked.select(*[F.col("row").getField(c).alias(c) for c in keep], "contact")


def needed_tiles(tiles: ContactTiles, rows: DataFrame) -> DataFrame:
    """The tiles of the stripes that ``rows`` (chr, low: the smaller bin) fall into.

    There are as many stripes as the chromosomes are long, however many the rows; their names come to
    the driver, so that the scan lists and reads only those folders.
    """
    stripe = F.floor(F.col("low") / (tiles.side * tiles.stripe)).cast("long")
    asked = rows.select("chr", stripe.alias("s")).distinct().groupBy("chr").agg(F.sort_array(F.collect_set("s")).alias("s")).collect()
    wanted = F.lit(False)
    for r in asked:
        wanted = wanted | ((F.col("chr") == r["chr"]) & F.col("stripe").isin(r["s"]))
    return tiles.tiles().where(wanted)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Tables of the rows of equal names, from batches in their order."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in _slices(batches, names):
        own = tuple(batch.column(n)[0].as_py() for n in names)
        if held and own != key:
            yield key, pa.Table.from_batches(held)
            held = []
        key = own
        held.append(batch)
    if held:
        yield key, pa.Table.from_batches(held)


def _slices(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches cut where one of the names changes."""
    import numpy as np

    for batch in batches:
        if batch.num_rows:
            new = np.zeros(batch.num_rows, dtype=bool)
            for n in names:
                codes = batch.column(n).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.slice(a, b - a)
