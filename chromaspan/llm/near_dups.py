"""MinHash near-dedup: fast similarity sketching, banding and exact verification.

1. One pass over the texts gives each document's set of 5-word shingles (64-bit hashes) as a sketch
   of 128 coordinates. In round i every shingle is hashed into a bin with a value in [i, i + 1), and
   a bin keeps its least value; rounds go on until all bins are full, and from round 128 on a round
   fills one bin for certain. Documents with equal sets form a class, which goes on as one node.
2. 32 bands of 4 coordinates are the buckets. A pair at the threshold misses all of them with
   a probability under 1e-5, at a Jaccard similarity of 0.85 with one under 1e-10.
3. Small buckets give all their pairs, at most 7 a member. In a larger one all members are held
   against its least member, the lead, on full sets. Members linked to it need no pair among
   themselves. Any other two that link differ in at most (|x| + |y|) / 7 shingles, so they must
   share a certain number of their differences from the lead. Their pairs come from a prefix
   join on these differences, additions first: members that were changed independently, or that
   have no more than a passage in common, share few and are never paired. All pairs are confirmed
   on full sets.
4. Components of the confirmed links come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, fresh, materialise, slices, small

SHINGLE, BINS, ROWS = 5, 128, 4
#: Links: 100 * intersection >= LINK * union.
LINK = 75
#: Bytes of a row of one or two ids, and of one of a few, in a broadcast table.
ID_BYTES, ROW_BYTES = 40, 80
#: Pairs of one lead that meet in a task at most.
LEAD_PAIRS = 2000
#: Buckets of up to so many members give all their pairs.
SMALL = 8
_SLICE = 2 << 20


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def _mix(h):
    """A finalizer of 64-bit integers."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None):
    """Sorted distinct shingle hashes of a text; of fewer than five words, the hash of them all; without words, none."""
    import numpy as np

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > 150_000:
        _words.clear()
    w = np.array(list(map(_words.__getitem__, words)), np.uint64)
    size = min(SHINGLE, len(w))
    count = len(w) - size + 1
    h = np.full(count, size, np.uint64)
    for i in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + count])
    return np.unique(h)


def sketch(sets: list):
    """Sketch (len(sets) x BINS) of non-empty sets by fast similarity sketching."""
    import numpy as np

    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), BINS), empty, np.uint64)
    flat = out.reshape(-1)
    item = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    low = np.uint64((1 << 56) - 1)
    for i in range(2 * BINS):
        h = _mix(item + np.uint64((i + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        value = (h & low) | (np.uint64(i) << np.uint64(56))
        place = owner * BINS + ((h >> np.uint64(57)).astype(np.int64) if i < BINS else i - BINS)
        np.minimum.at(flat, place, value)
        open_ = (out == empty).any(axis=1)
        if not open_.any():
            break
        more = open_[owner]
        item, owner = item[more], owner[more]
    return out


def bands(signature):
    """One 64-bit bucket key for each band, from its coordinates and its number."""
    import numpy as np

    parts = signature.reshape(len(signature), BINS // ROWS, ROWS)
    h = np.broadcast_to(np.arange(1, BINS // ROWS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return h


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands) by row; k1 and k2 identify the whole set, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        def out(doc_ids: list, sets: list) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = bands(sketch([sets[i] for i in full])) if full else np.zeros((0, BINS // ROWS), np.uint64)
            k1, k2, lists = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for row, i in enumerate(full):
                k1[i], k2[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), "<i8").tolist()
                lists[i] = keys[row].view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

        for batch in batches:
            for first, last in slices(batch.column("text"), size=_SLICE):
                part = batch.slice(first, last - first)
                yield out(part.column("doc_id").to_pylist(), list(map(shingles, part.column("text").cast(pa.binary()).to_pylist())))
        _words.clear()  # the worker process goes on to other stages

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def keep_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with a written table of ids (one column), which is broadcast if it is small."""
    (i,) = fresh(docs, "id_")
    return docs.join(bounded(ids.toDF(i), ID_BYTES), F.col("doc_id") == F.col(i), how)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set): the shingle sets of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for first, last in slices(batch.column("text"), size=_SLICE):
                part = batch.slice(first, last - first)
                sets = [shingles(t).view(np.int64) for t in part.column("text").cast(pa.binary()).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["id", "set"])
        _words.clear()

    return keep_ids(docs.select("doc_id", "text"), ids, "left_semi").mapInArrow(run, "id long, set array<long>")


def verify(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """(a, b, inter, total): intersection and union sizes of pairs (a written table) on full sets; without ``differences`` only of those that can link by size.

    ``differences`` adds ``nb`` (size of b's set) and ``diff``: b's shingles that a lacks, then a's that b lacks, each sorted.
    A set goes to each pair it is the ``b`` of; those of one ``a`` are dealt out over copies of its set, one for LEAD_PAIRS of them.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEAD_PAIRS).cast("int").alias("salts"))
    salts = materialise(salts, "salts")
    left = sets.join(bounded(salts, ROW_BYTES), F.col("id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(1), "salts")).alias("salt"), F.col("set").alias("sa"))
    dealt = pairs.join(bounded(salts, ROW_BYTES).withColumnRenamed("a", "c"), F.col("a") == F.col("c")).select(F.col("a").alias("pa"), "b", (F.pmod(F.xxhash64("b"), "salts") + 1).cast("int").alias("ps"))
    right = sets.join(F.broadcast(dealt) if small(pairs.count(), ROW_BYTES) else dealt, F.col("id") == F.col("b")).select("pa", "ps", "b", F.col("set").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    both = left.join(right, (F.col("a") == F.col("pa")) & (F.col("salt") == F.col("ps")))
    inter = F.size(F.array_intersect("sa", "sb"))
    if not differences:
        return both.where(100 * F.least(na, nb) >= LINK * F.greatest(na, nb)).select("a", "b", inter.alias("inter"), (na + nb - inter).alias("total"))
    diff = F.concat(F.array_sort(F.array_except("sb", "sa")), F.array_sort(F.array_except("sa", "sb")))
    return both.select("a", "b", inter.alias("inter"), (na + nb - inter).alias("total"), nb.alias("nb"), diff.alias("diff"))


def linked() -> Column:
    return 100 * F.col("inter") >= LINK * F.col("total")


def of_several_components(held: DataFrame) -> DataFrame:
    """Rows of ``held`` whose lead's members are in different components: only these may have links yet to be found."""
    mixed = held.groupBy("lead").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(F.col("lead").alias("l"))
    return held.join(bounded(materialise(mixed, "leads-of-several"), ID_BYTES), F.col("lead") == F.col("l"), "left_semi")


def medoid_pairs(held: DataFrame) -> DataFrame:
    """(a, b): each group of a lead and its members, with the group's most central one as ``a``.

    The sum of a member's differences from all others is a constant of the group plus the sum, over
    its differences from the lead, of M - 2 * (members with that difference), so one count by
    difference and a sum by member give it. The lead itself has no differences and the sum 0.
    """
    each = held.select("lead", "rep", F.explode("diff").alias("token"))
    many = held.groupBy("lead").agg(F.count("*").alias("many")).withColumnRenamed("lead", "m")
    uses = each.groupBy("lead", "token").agg(F.count("*").alias("uses")).join(many, F.col("lead") == F.col("m")).select(F.col("lead").alias("l"), F.col("token").alias("t"), (F.col("many") - 2 * F.col("uses")).alias("cost"))
    cost = each.join(uses, (F.col("lead") == F.col("l")) & (F.col("token") == F.col("t"))).groupBy("lead", "rep").agg(F.sum("cost").alias("cost"))
    best = cost.groupBy("lead").agg(F.min(F.struct("cost", "rep")).alias("x"))
    best = materialise(best.select(F.col("lead").alias("l"), F.when(F.col("x.cost") < 0, F.col("x.rep")).otherwise(F.col("lead")).alias("a")), "medoids")
    members = held.select("lead", F.col("rep").alias("b")).union(held.select("lead", F.col("lead").alias("b")).distinct())
    return members.join(bounded(best, ID_BYTES), F.col("lead") == F.col("l")).select("a", "b").where("a <> b").distinct()


def pairs_by_differences(held: DataFrame) -> DataFrame:
    """Pairs (a, b) that may link, of members held against the same lead that are in different components so far.

    ``held`` has lead, lead_n (its set size), rep, n (set size), diff, ok (linked to the lead) and
    component. With D the differences from the lead, x and y link only if |Dx & Dy| >= T =
    (|Dx| + |Dy| - (|x| + |y|) / 7) / 2, so they share one among the first |D| - T + 1 of each D in any
    common order; here rare differences come first. Whatever the partner, T is at least |Dx| - |x| / 3
    (no set exceeds 4/3 of a linked one) and (7 |Dx| - |x| - |lead|) / 8 (|y| is at most |lead| + |Dy|).
    It is over (7 |Dx| + |lead| - |x|) / 14, 3/7 of |Dx| or more, only if y is not linked to the lead:
    7 |Dy| > |y| + |lead|. Two that are linked to it need no pair, so for a linked x that is always so;
    an x that is not linked goes deeper into its differences for linked partners than for others.
    """
    held = of_several_components(held)
    own = ["lead", "lead_n", "rep", "n", "ok", "component", "d"]
    each = held.withColumn("d", F.size("diff")).select(*own, F.explode("diff").alias("token"))
    # Differences that the same members have would all give the same pairs: they go on as one, with their number.
    holders = [F.bit_xor(F.xxhash64(F.lit(i), "rep")).alias(f"h{i}") for i in (1, 2)]
    often = each.groupBy("lead", "token").agg(F.count("*").alias("uses"), *holders).where("uses > 1").withColumnsRenamed({"lead": "l", "token": "t"})
    shared = each.join(often, (F.col("lead") == F.col("l")) & (F.col("token") == F.col("t"))).groupBy(*own, "uses", "h1", "h2").agg(F.count("*").alias("w"))
    # Differences that nobody shares come first and match nothing, so only their number counts.
    mine = Window.partitionBy("lead", "rep")
    before = F.coalesce(F.sum("w").over(mine.orderBy("uses", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = shared.withColumn("pos", F.col("d") - F.sum("w").over(mine) + before)
    d, n, lead_n, pos = F.col("d"), F.col("n"), F.col("lead_n"), F.col("pos")
    least = F.greatest(F.lit(1), d - F.floor(n / 3), F.ceil((7 * d - n - lead_n) / 8))
    least_far = F.greatest(least, F.floor((7 * d + lead_n - n) / 14) + 1)
    # Each row may go with one that is not linked to the lead ("first"), or only with linked ones.
    rows = rows.withColumn("first", pos <= d - least_far).where(F.col("first") | (~F.col("ok") & (pos <= d - least)))
    # At a common difference x and y can have T in common only if room(x) >= need(y) and room(y) >= need(x).
    rows = rows.select("lead", "rep", "n", "ok", "component", "first", "uses", "h1", "h2", (7 * d - 14 * pos + n).alias("room"), (7 * d - n).alias("need"))
    rows = materialise(rows, "difference-rows")
    key = ["lead", "uses", "h1", "h2"]
    over = lambda c, ok: F.when(F.col("ok") if ok else ~F.col("ok"), F.col(c))
    best = rows.groupBy(*key).agg(F.min(over("need", False)).alias("need_far"), F.min(over("need", True)).alias("need_near"), F.max(over("room", False)).alias("room_far"), F.max(over("room", True)).alias("room_near"), F.count("*").alias("many"))
    best = best.where("many > 1 AND need_far IS NOT NULL").select(*[F.col(c).alias(f"k_{c}") for c in key], "need_far", "need_near", "room_far", "room_near")
    rows = rows.join(best, (F.col("lead") == F.col("k_lead")) & (F.col("uses") == F.col("k_uses")) & (F.col("h1") == F.col("k_h1")) & (F.col("h2") == F.col("k_h2")))
    need, room = (F.when(F.col("ok"), F.col(f"{c}_far")).otherwise(pick(f"{c}_far", f"{c}_near")) for c, pick in (("need", F.least), ("room", F.greatest)))
    rows = materialise(rows.where((F.col("room") >= need) & (F.col("need") <= room)).drop("k_lead", "k_uses", "k_h1", "k_h2", "need_far", "need_near", "room_far", "room_near"), "difference-rows")
    far, near = rows.where("NOT ok"), rows.where("ok")
    sizes = 4 * F.least("n", "o_n") >= 3 * F.greatest("n", "o_n")
    on = (F.col("lead") == F.col("o_lead")) & (F.col("uses") == F.col("o_uses")) & (F.col("h1") == F.col("o_h1")) & (F.col("h2") == F.col("o_h2"))
    on = on & (F.col("component") != F.col("o_component")) & sizes & (F.col("room") >= F.col("o_need")) & (F.col("o_room") >= F.col("need"))

    def joined(x: DataFrame, y: DataFrame, also: Column) -> DataFrame:
        return x.join(y.select(*[F.col(c).alias(f"o_{c}") for c in y.columns]), on & also).select(F.least("rep", "o_rep").alias("a"), F.greatest("rep", "o_rep").alias("b"))

    return joined(far.where("first"), far.where("first"), F.col("rep") < F.col("o_rep")).union(joined(far, near, F.lit(True))).distinct()


def confirmed_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links between the nodes (rep, bands) that share a bucket, each confirmed on full sets."""
    buckets = nodes.select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "lead", "n")
    members = materialise(buckets.join(shared, F.col("key") == F.col("k")).select("key", "rep", "lead", "n"), "bucket-members")
    sets = materialise(full_sets(docs, materialise(members.select("rep").distinct(), "member-ids")), "shingle-sets")

    few = members.where(F.col("n") <= SMALL)
    other = bounded(few, ROW_BYTES).select(F.col("key").alias("k"), F.col("rep").alias("b"))
    pairs = few.join(other, (F.col("key") == F.col("k")) & (F.col("rep") < F.col("b"))).select(F.col("rep").alias("a"), "b").distinct()
    held = members.where((F.col("n") > SMALL) & (F.col("rep") > F.col("lead"))).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    held = differences(held, sets)
    found = verify(materialise(pairs, "pairs"), sets).where(linked()).select("a", "b").union(links_to_leads(held))
    found = materialise(found.distinct(), "links-so-far")
    mixed = materialise(of_several_components(labelled(held, found)), "mixed-groups")
    if not mixed.limit(1).count():
        return found
    # The least member may be an odd one. Held against the most central one, members that link to
    # others mostly link to it, and those that do not differ from it in little that they share.
    held = differences(medoid_pairs(mixed), sets)
    found = materialise(found.union(links_to_leads(held)).distinct(), "links-so-far")
    more = materialise(pairs_by_differences(labelled(held, found)), "pairs-by-differences")
    return found.union(verify(more, sets).where(linked()).select("a", "b")).distinct()


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, lead_n, rep, n, diff, ok) of pairs (a, b) of a lead and a member: sizes, differences, and whether they link; written."""
    held = verify(materialise(pairs, "held-against-lead"), sets, differences=True)
    return materialise(held.select(F.col("a").alias("lead"), (F.col("total") + F.col("inter") - F.col("nb")).alias("lead_n"), F.col("b").alias("rep"), F.col("nb").alias("n"), "diff", linked().alias("ok")), "differences")


def links_to_leads(held: DataFrame) -> DataFrame:
    return held.where("ok").select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b"))


def labelled(held: DataFrame, found: DataFrame) -> DataFrame:
    """``held`` with each member's component by the links found so far."""
    so_far = bounded(materialise(components(found), "components-so-far"), ID_BYTES)
    return held.join(so_far, F.col("rep") == F.col("node"), "left").select(*held.columns, F.coalesce("component", "rep").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of a link with the least node it reaches.

    Large-star links a node's larger neighbours to its least one, small-star its smaller ones;
    repeated, this leaves stars. Only grouped minima and joins are used, so a node with many links
    is no group of its own anywhere.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        sized = F.broadcast if small(edges.count(), ID_BYTES) else (lambda df: df)
        # Large-star: over all neighbours; the larger ones move to the least.
        near = edges.union(edges.select("v", "u"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = near.join(sized(least), F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        # Small-star: over smaller neighbours; they and the node move to the least.
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        moved = large.join(sized(small_least), F.col("u") == F.col("c"))
        smaller = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(moved.select("u", "m")).distinct()
        edges = materialise(smaller, "small-star")
        # Done when no node is both a center and an end, and every end has one center.
        centers = edges.select(F.col("v").alias("c"))
        both = edges.join(sized(centers), F.col("u") == F.col("c"), "left_semi").limit(1).count()
        if not both and edges.select("u").distinct().count() == edges.count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Documents are linked if their shingle sets have a Jaccard similarity of 0.75 or more; the
    component is the least doc_id that links reach, and its document is kept. Shingles are compared
    as 64-bit hashes, so n_shingles is a number of distinct hashes. Null and empty texts
    and texts without words have an empty set and stand alone. Very long texts are taken whole. Rows that share a doc_id are one
    document. A row without a doc_id can lead no component: it joins that of its text if a
    document has it, and else has a null component and is kept. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    rows = materialise(sketches(docs), "sketches")
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    classes = materialise(classes.where("rep IS NOT NULL"), "classes")
    c = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep")
    nodes = full.join(c, (F.col("doc_id") == F.col("rep")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).select("rep", "bands")
    found = materialise(components(confirmed_links(docs, nodes)), "components")
    moved = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.coalesce("component", "rep").alias("component"), (F.col("component").isNotNull() | (F.col("size") > 1)).alias("shared"))
    moved = moved.where("shared").drop("shared")
    joined = rows.join(moved, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: that with the least doc_id.

    Rows are dropped by doc_id: rows that share one stay or go together, also if their texts differ,
    and rows without one stay. An empty table stays empty; other columns are passed on.
    """
    dropped = materialise(near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct(), "dropped")
    return keep_ids(docs, dropped, "left_anti")


def op4_near_dups(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


#: DuckDB SQL for op4: all pairs that share a shingle, and the closure of the links.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], chr(10)) AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT e.b, reach.r FROM reach JOIN e ON reach.doc_id = e.a
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
