"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node. Each node starts with the best of a few random blocks of nodes. A round
of NN-descent joins neighbours of neighbours: every node gathers some of its neighbours, forward and
reverse, and all pairs of these with a new one among them are compared; what is better than the
worst neighbour so far stays. A search walks the graph from each query, expanding the best nodes of
its beam until none is left unexpanded. In both, Spark's joins bring vectors to nodes in parts of
bounded size, and each part is one piece of matrix arithmetic. The best of the beam are scored
again on the original vectors in double precision.

Inner products are made comparable by one more component, sqrt(M^2 - |x|^2), so that all nodes have
the norm M of the longest; queries have none. Vectors travel as half-precision directions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch

#: Results a query; neighbours a node; sampled neighbours of each kind (new and old, forward and reverse) in a round.
TOP, NEIGHBOURS, SAMPLED = 20, 48, 14
#: Rounds at most; they end earlier when fewer than this share of all neighbours is new.
ROUNDS, ENOUGH = 8, 0.02
#: Nodes of a random block, and such blocks for each node, at the start.
BLOCK_NODES, BLOCKINGS = 512, 4
#: Nodes or queries whose rows meet in one piece of arithmetic; parts at least, so that small tables are dealt out like large ones.
PART_NODES, LEAST_PARTS = 3072, 12
#: Requests of a search whose node blocks are decoded at once.
_PIECE = 256
#: Beam of a search, nodes expanded a round, and entry points besides a query's own node.
BEAM, EXPANDED, ENTRIES = 160, 32, 64
GRAPH = "node long, code binary, nbr array<long>, sim array<float>, new array<boolean>"
_BEAM = "q long, code binary, nbr array<long>, sim array<float>, done array<boolean>"


# -- vectors ----------------------------------------------------------------------------------


def takes_part(vector: Column, dims: int) -> Column:
    """Whether a vector has the length ``dims``, only finite components, and not only zeros."""
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return (F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, top: int = TOP, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Two written tables: rows (id, vec) that take part, and nodes (node, vec, ids, n), one for each distinct vector.

    A node is named by its smallest id and keeps its ``top + 1`` smallest ids; no result needs more
    of them. Of rows that share an id, that with the least vector counts. The length that most rows
    have (ties: the longer) is that of all; other vectors take no part, nor do rows without an id.
    """
    named = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vec")).where("id IS NOT NULL")
    lengths = named.where(F.size("vec") > 0).groupBy(F.size("vec").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    rows = named.where(takes_part(F.col("vec"), lengths["d"] if lengths else 0)).groupBy("id").agg(F.min("vec").alias("vec"))
    rows = materialise(rows, "vectors")
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= top + 1)
    nodes = first.groupBy("vec").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids"))
    return rows, materialise(nodes.select("node", "vec", "ids"), "nodes")


def encode_vectors(vectors, longest: float) -> list[bytes]:
    """Codes of nodes: direction in half precision, length over ``longest``, and the added component."""
    import numpy as np

    v = vectors.astype(np.float64)
    size = np.abs(v).max(axis=1, keepdims=True)
    direction = v / size
    unit = np.sqrt((direction**2).sum(axis=1, keepdims=True))
    length = np.clip(unit * (size / longest), 0, 1)
    tail = np.concatenate([length, np.sqrt(1 - length**2)], axis=1).astype(np.float32)
    return [a.tobytes() + b.tobytes() for a, b in zip((direction / unit).astype(np.float16), tail, strict=True)]


def decode_vectors(codes: pa.Array):
    """Codes as a float matrix: the vectors over the longest length, then the added component."""
    import numpy as np

    if not len(codes):
        return np.zeros((0, 1), dtype=np.float32)
    return _decoded(b"".join(codes.to_pylist()), len(codes))


def _decoded(codes: bytes, n: int):
    import numpy as np

    raw = np.frombuffer(codes, dtype=np.uint8).reshape(n, -1)
    direction, tail = np.ascontiguousarray(raw[:, :-8]).view(np.float16).astype(np.float32), np.ascontiguousarray(raw[:, -8:]).view(np.float32)
    return np.concatenate([direction * tail[:, :1], tail[:, 1:]], axis=1)


def coded(nodes: DataFrame, longest: float, name: str = "node") -> DataFrame:
    """(name, code) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(encode_vectors(vectors, longest), pa.binary())], [name, "code"])

    return nodes.select(name, "vec").mapInArrow(run, f"{name} long, code binary")


# -- arithmetic within a part -----------------------------------------------------------------


def _mix(a, b, seed: int):
    """Random-looking numbers that depend on the two ids and the seed only."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _places(owner):
    """The place of each entry within its run of equal owners; ``owner`` is sorted."""
    import numpy as np

    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, dtype=np.int64)
    return np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))


def _best(owner, other, sim, flag, k: int):
    """Per owner the ``k`` largest similarities over distinct others (ties: smaller id); of double entries that with the smaller flag stays."""
    import numpy as np

    by = np.lexsort((flag, other, owner))
    owner, other, sim, flag = owner[by], other[by], sim[by], flag[by]
    once = np.ones(len(owner), dtype=bool)
    once[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, sim, flag = owner[once], other[once], sim[once], flag[once]
    by = np.lexsort((other, -sim, owner))
    by = by[_places(owner[by]) < k]
    return owner[by], other[by], sim[by], flag[by]


def _sampled(owner, other, candidates, k: int, seed: int):
    """Which of the candidate entries are among the ``k`` of their owner with the smallest mixed ids."""
    import numpy as np

    at = np.flatnonzero(candidates)
    by = at[np.lexsort((_mix(owner[at], other[at], seed), owner[at]))]
    out = np.zeros(len(owner), dtype=bool)
    out[by[_places(owner[by]) < k]] = True
    return out


def _lists(owner, *values: tuple) -> tuple[object, list[pa.Array]]:
    """Distinct owners of sorted entries, and their values as list columns."""
    import numpy as np

    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.append(first, len(owner)).astype(np.int32))
    return owner[first], [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in values]


def _flat(table, owner: str, *columns: str):
    """A list column's entries with the owner of each, and further list columns alongside."""
    import numpy as np
    import pyarrow.compute as pc

    column = lambda name: table.column(name).combine_chunks() if isinstance(table, pa.Table) else table.column(name)
    lists = column(columns[0])
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    own = column(owner).to_numpy(zero_copy_only=False)
    return np.repeat(own, counts), *[column(c).flatten().to_numpy(zero_copy_only=False) for c in columns]


def compare_block(table: pa.Table, k: int) -> pa.Table:
    """All pairs within one random block; the best ``k`` of each node."""
    import numpy as np

    ids, v = table.column("node").to_numpy(), decode_vectors(table.column("code").combine_chunks())
    sims = v @ v.T
    np.fill_diagonal(sims, -np.inf)
    k = min(k, len(ids) - 1)
    other = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), dtype=np.int64)
    rows = np.repeat(np.arange(len(ids)), k)
    by = np.lexsort((ids[other.ravel()], ids[rows]))
    owner, (nbr, sim) = _lists(ids[rows][by], (ids[other.ravel()][by], pa.int64()), (sims[rows, other.ravel()][by], pa.float32()))
    return pa.table({"node": pa.array(owner, pa.int64()), "nbr": nbr, "sim": sim})


def join_members(table: pa.Table, k: int, batch: int = 64) -> pa.Table:
    """The local joins of one part's centres: rows (member, code, least, centres) to candidates (node, nbr, sim).

    Each pair of members of a centre is compared if one is new; a candidate must beat its node's worst neighbour.
    """
    import numpy as np

    ids, v = table.column("member").to_numpy(), decode_vectors(table.column("code").combine_chunks())
    least = table.column("least").to_numpy().astype(np.float32)
    entries = table.column("centres").combine_chunks()
    member = np.repeat(np.arange(len(ids)), np.diff(entries.offsets.to_numpy()))
    inner = entries.flatten()
    centre, new = inner.field("centre").to_numpy(), inner.field("new").to_numpy(zero_copy_only=False)
    by = np.lexsort((~new, centre))
    centre, new, member = centre[by], new[by], member[by]
    first = np.flatnonzero(np.concatenate(([True], centre[1:] != centre[:-1]))) if len(centre) else np.zeros(0, dtype=np.int64)
    number, place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(centre)))), _places(centre)
    members = np.full((len(first), int(place.max(initial=-1)) + 1), -1)
    members[number, place] = member
    n_new = np.bincount(number[new], minlength=len(first))
    found: list[tuple] = []
    for a in range(0, len(first), batch):
        all_, fresh_ = members[a : a + batch], int(n_new[a : a + batch].max(initial=0))
        if not fresh_:
            continue
        new_, is_new = all_[:, :fresh_], np.arange(all_.shape[1])[None, :] < n_new[a : a + batch, None]
        sims = np.matmul(v[new_], v[all_].transpose(0, 2, 1))
        i, j = np.broadcast_to(new_[:, :, None], sims.shape), np.broadcast_to(all_[:, None, :], sims.shape)
        right = is_new[:, :fresh_, None] & (j >= 0) & (i != j)
        one = right & (sims > least[i])
        two = right & ~is_new[:, None, :] & (sims > least[j])
        found += [(i[one], j[one], sims[one]), (j[two], i[two], sims[two])]
    owner, other, sim = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))
    owner, other, sim, _ = _best(owner, other, sim, np.zeros(len(owner), dtype=bool), k)
    node, (nbr, sims_) = _lists(owner, (ids[other], pa.int64()), (sim, pa.float32()))
    return pa.table({"node": pa.array(ids[node] if len(node) else [], pa.int64()), "nbr": nbr, "sim": sims_})


def merge_lists(table: pa.Table, owner: str, flag: str, k: int, sampled: int | None = None, seed: int = 0) -> pa.Table:
    """Rows with a code (kept lists) and without (candidates) to one row an owner with its best ``k``.

    ``flag`` is kept for what was there already. With ``sampled``, it says "new": entries that the
    round has sampled are so no longer, and candidates are.
    """
    import numpy as np

    kept = table.filter(pa.compute.is_valid(table.column("code")))
    added = table.filter(pa.compute.is_null(table.column("code")))
    o1, w1, s1, f1 = _flat(kept, owner, "nbr", "sim", flag)
    o2, w2, s2 = _flat(added, owner, "nbr", "sim")
    f1 = f1.astype(bool)
    if sampled is not None:
        f1 = f1 & ~_sampled(o1, w1, f1, sampled, seed)
    # Entries that were there come first among doubles: rank 0, candidates rank 1.
    o, w, s = np.concatenate([o1, o2]), np.concatenate([w1, w2]), np.concatenate([s1, s2])
    mark = np.concatenate([f1.astype(np.int8), np.full(len(o2), 2, dtype=np.int8)])
    o, w, s, mark = _best(o, w, s, mark, k)
    flags = mark > 0 if sampled is not None else mark == 1
    owners, (nbr, sim, new) = _lists(o, (w, pa.int64()), (s, pa.float32()), (flags, pa.bool_()))
    ids, codes = kept.column(owner).to_numpy(), kept.column("code").combine_chunks()
    by = np.argsort(ids, kind="stable")
    at = np.searchsorted(owners, ids[by]) if len(owners) else np.zeros(len(ids), dtype=np.int64)
    has = (at < len(owners)) & (owners[np.minimum(at, max(0, len(owners) - 1))] == ids[by]) if len(owners) else np.zeros(len(ids), dtype=bool)
    take = pa.array(at, mask=~has)
    columns = [pa.array(ids[by], pa.int64()), codes.take(pa.array(by)), *[_or_empty(x.take(take)) for x in (nbr, sim, new)]]
    return pa.Table.from_arrays(columns, names=[owner, "code", "nbr", "sim", flag])


def _or_empty(lists: pa.Array) -> pa.Array:
    """Null lists as empty ones."""
    import numpy as np
    import pyarrow.compute as pc

    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), lists.flatten())


# -- NN-descent -------------------------------------------------------------------------------


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _merged(kept: DataFrame, added: DataFrame, owner: str, flag: str, k: int, parts: int, schema: str, sampled: int | None = None, seed: int = 0) -> DataFrame:
    both = kept.unionByName(added, allowMissingColumns=True).withColumn("part", _part(owner, parts))
    return both.groupBy("part").applyInArrow(lambda table: merge_lists(table, owner, flag, k, sampled, seed), schema)


def _edges(graph: DataFrame, sampled: int, seed: int) -> DataFrame:
    """(centre, member, new) of the round: sampled neighbours of each node, and as many reverse ones of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            node, nbr, new = _flat(batch, "node", "nbr", "new")
            new = new.astype(bool)
            for kind in (new, ~new):
                own = _sampled(node, nbr, kind, sampled, seed)
                n, flags = int(own.sum()), kind[own] & new[own]
                for centre, member, back in ((node[own], nbr[own], False), (nbr[own], node[own], True)):
                    order = (_mix(centre, member, seed) >> np.uint64(1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(centre, pa.int64()), pa.array(member, pa.int64()), pa.array(flags, pa.bool_()), pa.array(np.full(n, back), pa.bool_()), pa.array(order, pa.int64())], ["centre", "member", "new", "back", "o"])

    edges = graph.select("node", "nbr", "new").mapInArrow(run, "centre long, member long, new boolean, back boolean, o long")
    place = F.row_number().over(Window.partitionBy("centre", "new").orderBy("o", "member"))
    back = edges.where("back").withColumn("place", place).where(F.col("place") <= sampled)  # hubs keep as many reverse neighbours as others
    return edges.where("NOT back").select("centre", "member", "new").unionByName(back.select("centre", "member", "new"))


def build_graph(codes: DataFrame, k: int = NEIGHBOURS, sampled: int = SAMPLED, rounds: int = ROUNDS, enough: float = ENOUGH, seed: int = 5) -> DataFrame:
    """(node, code, nbr, sim, new) of each row (node, code), written after each round: its best neighbours found, nearest first.

    A node alone has no neighbours; an empty table gives an empty graph.
    """
    n = codes.count()
    parts, blocks = max(LEAST_PARTS, math.ceil(n / PART_NODES)), max(1, math.ceil(n / BLOCK_NODES))
    dealt = codes.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKINGS - 1 if blocks > 1 else 0))).alias("t"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "t", "node"), F.lit(blocks)))
    per_block = math.ceil(k / BLOCKINGS) if blocks > 1 else k
    start = dealt.groupBy("t", "block").applyInArrow(lambda table: compare_block(table, per_block), "node long, nbr array<long>, sim array<float>")
    none = codes.select("node", "code", F.array().cast("array<long>").alias("nbr"), F.array().cast("array<float>").alias("sim"), F.array().cast("array<boolean>").alias("new"))
    graph = materialise(_merged(none, start, "node", "new", k, parts, GRAPH, 0), "graph-0")
    for i in range(rounds if blocks > 1 else 0):
        edges = _edges(graph, sampled, seed + i).withColumn("part", _part("centre", parts))
        asked = edges.repartition("member").groupBy("member", "part").agg(F.collect_list(F.struct("centre", "new")).alias("centres"))
        least = F.when(F.size("sim") >= k, F.element_at("sim", k)).otherwise(F.lit(float("-inf")).cast("float"))
        members = asked.join(graph.select(F.col("node").alias("member"), "code", least.alias("least")), "member")
        found = members.groupBy("part").applyInArrow(lambda table: join_members(table, k), "node long, nbr array<long>, sim array<float>")
        graph = materialise(_merged(graph, found, "node", "new", k, parts, GRAPH, sampled, seed + i), f"graph-{i + 1}")
        if graph.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] <= enough * k * n:
            break
    return graph


# -- search -----------------------------------------------------------------------------------


def _blocks(graph: DataFrame, buckets: int, parts: int) -> str:
    """A table (node, nbr, codes) with the codes of each node's neighbours in its row, bucketed by node so that a search's joins read it in place; gives its name."""

    def gather(table: pa.Table) -> pa.Table:
        import numpy as np

        codes = table.column("code").to_pylist()
        entries = table.column("centres").combine_chunks()
        member = np.repeat(np.arange(len(codes)), pa.compute.list_value_length(entries).to_numpy())
        inner = entries.flatten()
        centre, place = inner.field("centre").to_numpy(), inner.field("place").to_numpy()
        by = np.lexsort((place, centre))
        ids = table.column("member").to_numpy()[member[by]]
        nodes, (nbr,) = _lists(centre[by], (ids, pa.int64()))
        cuts = nbr.offsets.to_numpy()
        joined = [b"".join([codes[m] for m in member[by[a:b]]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"node": pa.array(nodes, pa.int64()), "nbr": nbr, "codes": pa.array(joined, pa.binary())})

    pairs = graph.select(F.col("node").alias("centre"), F.posexplode("nbr").alias("place", "member")).withColumn("part", _part("centre", parts))
    asked = pairs.repartition("member").groupBy("member", "part").agg(F.collect_list(F.struct("centre", "place")).alias("centres"))
    rows = asked.join(graph.select(F.col("node").alias("member"), "code"), "member").groupBy("part").applyInArrow(gather, "node long, nbr array<long>, codes binary")
    path = scratch(graph.sparkSession, "graph-blocks")
    name = "graph_blocks_" + path.rpartition("-")[2]
    rows.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node").option("path", path).saveAsTable(name)
    return name


def search_graph(graph: DataFrame, queries: DataFrame, beam: int = BEAM, expanded: int = EXPANDED, entries: int = ENTRIES) -> DataFrame:
    """(q, code, nbr, sim, done), written: the ``beam`` best nodes found for each row of ``queries`` (q, code, start), nearest first.

    ``start`` is a node to begin at, or null; ``entries`` nodes of the graph are looked at besides.
    No queries or an empty graph give no nodes.
    """
    spark = graph.sparkSession
    nodes, n = graph.count(), queries.count()
    parts, buckets = max(LEAST_PARTS, math.ceil(n / PART_NODES)), max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nodes / PART_NODES))
    picked = graph.select("node", "code").orderBy(F.xxhash64("node")).limit(entries).collect()
    entry_ids, entry_codes = [r["node"] for r in picked], [bytes(r["code"]) for r in picked]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        entry = decode_vectors(pa.array(entry_codes, pa.binary()))
        for batch in batches:
            if batch.num_rows and len(entry):
                q = batch.column("q").to_numpy()
                sims = decode_vectors(batch.column("code"))[:, :-1] @ entry[:, :-1].T
                o, w, s = np.repeat(q, len(entry)), np.tile(np.array(entry_ids), len(q)), sims.ravel()
                has = np.array([x is not None for x in batch.column("start").to_pylist()])
                own = batch.column("start").fill_null(0).to_numpy()[has]
                o, w, s = np.concatenate([o, q[has]]), np.concatenate([w, own]), np.concatenate([s, np.full(len(own), 2, dtype=np.float32)])
                o, w, s, _ = _best(o, w, s, s < 2, beam)
                owners, (nbr, sim, done) = _lists(o, (w, pa.int64()), (s, pa.float32()), (np.zeros(len(o), dtype=bool), pa.bool_()))
                by = np.argsort(q, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), batch.column("code").take(pa.array(by)), nbr, sim, done], ["q", "code", "nbr", "sim", "done"])

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                number = pa.array(np.arange(batch.num_rows))
                o, w, s, d = _flat(batch.append_column("i", number), "i", "nbr", "sim", "done")
                open_ = np.flatnonzero(~d.astype(bool))
                ask = open_[_places(o[open_]) < expanded]
                sizes = np.bincount(o, minlength=batch.num_rows)
                least = np.full(batch.num_rows, -np.inf, dtype=np.float32)
                full = sizes >= beam
                least[full] = s[np.cumsum(sizes)[full] - 1]
                rows = pa.array(o[ask])
                yield pa.RecordBatch.from_arrays([batch.column("q").take(rows), batch.column("code").take(rows), pa.array(least[o[ask]], pa.float32()), pa.array(w[ask], pa.int64())], ["q", "code", "least", "node"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for whole in batches:
            for batch in (whole.slice(at, _PIECE) for at in range(0, whole.num_rows, _PIECE)):
                i, w = _flat(batch.append_column("i", pa.array(np.arange(batch.num_rows))), "i", "nbr")
                sims = np.einsum("ij,ij->i", _decoded(b"".join(batch.column("codes").to_pylist()), len(i))[:, :-1], decode_vectors(batch.column("code"))[i, :-1])
                good = sims > batch.column("least").to_numpy()[i]
                i, w, sims = i[good], w[good], sims[good]
                rows, (nbr, sim) = _lists(i, (w, pa.int64()), (sims, pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(rows)), nbr, sim], ["q", "nbr", "sim"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Beams with what ``requests`` takes from them marked as expanded."""
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                o, d = _flat(batch.append_column("i", pa.array(np.arange(batch.num_rows))), "i", "done")
                d = d.astype(bool).copy()
                open_ = np.flatnonzero(~d)
                d[open_[_places(o[open_]) < expanded]] = True
                ends = np.cumsum(np.bincount(o, minlength=batch.num_rows))
                yield batch.set_column(4, "done", pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(d)))

    beams = materialise(queries.select("q", "code", "start").mapInArrow(begin, _BEAM), "beams")
    if not nodes or not n:
        return beams
    table = _blocks(graph, buckets, max(LEAST_PARTS, math.ceil(nodes / PART_NODES)))
    while beams.where(F.exists("done", lambda x: ~x)).limit(1).count():
        asked = beams.mapInArrow(requests, "q long, code binary, least float, node long")
        found = asked.join(spark.table(table).hint("merge"), "node").select("q", "code", "least", "nbr", "codes").mapInArrow(expand, "q long, nbr array<long>, sim array<float>")
        beams = materialise(_merged(beams.mapInArrow(mark, _BEAM), found, "q", "done", beam, parts, _BEAM), "beams")
    spark.sql(f"DROP TABLE {table}")
    return beams


def nearest_neighbours(vectors: DataFrame, asks: Column, top: int = TOP, id_column: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows whose id (``id``) fulfils ``asks``, the ``top`` rows found with the largest inner product.

    Nearest first, ties to the smaller id, a row is no neighbour of its own; score is the inner
    product of the original vectors in double precision. Vectors null, zero, with null or non-finite
    components, or of another length than most take no part, nor do rows without an id. Rows that
    share an id count once, with the least vector. Equal vectors are one node, so groups of copies of
    any size cost nothing, and all their ids rank by the tie rule. With fewer candidates than ``top``
    all that the graph reaches are returned; up to ``BLOCK_NODES`` distinct vectors the graph starts
    from all pairs. An empty table gives an empty result. Other columns are not looked at.
    """
    rows, nodes = distinct_vectors(vectors, top, id_column, vector)
    size = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    length = size * F.sqrt(F.aggregate(F.transform("vec", lambda x: F.pow(x.cast("double") / size, 2)), F.lit(0.0), lambda a, x: a + x))
    n_rows, longest = rows.count(), nodes.agg(F.max(length)).first()[0] or 1.0
    codes = materialise(coded(nodes, longest), "codes")
    graph = build_graph(codes, k)
    # A vector that more than a thousandth of all rows hold is one of a thousand at most; these few are broadcast, so no key of the shuffle is hot.
    known = nodes.select("vec", "node")
    hot = materialise(rows.groupBy("vec").agg(F.count("*").alias("n")).where(F.col("n") * 1000 > n_rows).select("vec").join(known, "vec"), "hot-vectors")
    asked = rows.where(asks).withColumnRenamed("id", "query_id")
    mapped = materialise(_joined(asked, known, hot, "vec").select("query_id", "node"), "query-nodes")
    queries = mapped.select("node").distinct().join(codes, "node").select(F.col("node").alias("q"), "code", F.col("node").alias("start"))
    beams = search_graph(graph, materialise(queries, "queries"), beam)

    pairs = beams.select("q", F.explode(F.slice("nbr", 1, 2 * top + 1)).alias("node"))
    scored = pairs.join(nodes, "node").join(nodes.select(F.col("node").alias("q"), F.col("vec").alias("own")), "q")
    product = F.aggregate(F.zip_with("own", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    each = scored.select("q", product.alias("score"), "ids").select("q", "score", F.explode("ids").alias("vec_id"))
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    best = each.withColumn("r", order).where(F.col("r") <= top + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    best = materialise(best.withColumnRenamed("q", "node"), "best")
    answered = _joined(mapped, best, materialise(hot.select("node").join(best, "node"), "hot-best"), "node")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    return answered.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")


def _joined(rows: DataFrame, facts: DataFrame, hot: DataFrame, on: str) -> DataFrame:
    """``rows`` with the one row of ``facts`` that has their key; ``hot`` holds those of frequent keys, a thousand at most."""
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(facts, on))


def op11_neighbour_graph(vectors: DataFrame) -> DataFrame:
    return nearest_neighbours(vectors, F.col("id") % 20 == 0)
