"""Token-id output: binary files of concatenated ids with Elias-Fano document boundaries.

A file holds a run of documents in ascending doc_id order: the ids of all of them one after the
other in 2 or 4 bytes each, and two Elias-Fano sequences, one of the document ends within the
file and one of the doc_ids. A boundary is read by ``select`` with sampled positions, so that
no table of 64-bit offsets is stored. Files are bounded in ids; a manifest table has a row a file.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch

MAGIC = b"SPANTOK1"
END_ID = 0
_HEAD = struct.Struct("<8sHHIQQq")  # magic, id width, 0, documents without doc_id, documents, ids, smallest doc_id
_EF_HEAD = struct.Struct("<QQBxxxxxxxQQ")  # count, largest value, low bits, bytes of low, bytes of high
#: Every so many-th one-bit of the high part has its place stored.
SELECT_EVERY = 64
#: Parts that one sort deals, each a task, and tasks that write a group of parts.
GROUP_PARTS, GROUP_TASKS = 8192, 64


class EliasFano:
    """A non-decreasing sequence of integers >= 0 in about 2 + log2(largest / count) bits each."""

    def __init__(self, count: int, largest: int, bits: int, low: bytes, high: bytes, samples: bytes):
        self.count, self.largest, self.bits, self.low, self.high, self.samples = count, largest, bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        import numpy as np

        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        largest = int(v[-1]) if n else 0
        bits = max(0, int(math.floor(math.log2(largest / n)))) if n and largest > n else 0
        low = np.packbits(((v[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes() if bits else b""
        ones = (v >> bits) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        high[ones] = 1
        samples = ones[::SELECT_EVERY].astype("<u4").tobytes()
        return cls(n, largest, bits, low, np.packbits(high, bitorder="little").tobytes(), samples)

    def select(self, i: int) -> int:
        """The i-th value: from the sampled one-bit before it on, bytes are counted, then bits."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place = struct.unpack_from("<I", self.samples, i // SELECT_EVERY * 4)[0]
        left, byte = i % SELECT_EVERY, place >> 3
        word = self.high[byte] >> (place & 7) << (place & 7)
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        top = (byte << 3) + (word & -word).bit_length() - 1 - i
        first = i * self.bits
        chunk = int.from_bytes(self.low[first >> 3 : (first + self.bits + 7) >> 3], "little") >> (first & 7)
        return top << self.bits | chunk & ((1 << self.bits) - 1)

    def all(self):
        import numpy as np

        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.count]
        out = (ones - np.arange(self.count)).astype(np.int64) << self.bits
        if self.bits:
            low = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.count * self.bits, bitorder="little").reshape(-1, self.bits)
            out |= low.astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        return _EF_HEAD.pack(self.count, self.largest, self.bits, len(self.low), len(self.high)) + self.low + self.high + self.samples

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        count, largest, bits, low, high = _EF_HEAD.unpack_from(data, at)
        a = at + _EF_HEAD.size
        b, c = a + low, a + low + high
        end = c + -(-count // SELECT_EVERY) * 4
        return cls(count, largest, bits, data[a:b], data[b:c], data[c:end]), end


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """File content. doc_ids ascend, those without one come first; ids are little-endian, ``width`` bytes each."""
    import numpy as np

    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum(np.array(lengths, np.int64))
    return _HEAD.pack(MAGIC, width, 0, len(doc_ids) - len(known), len(doc_ids), int(ends[-1]), least) + EliasFano.of(ends).to_bytes() + EliasFano.of(known - least).to_bytes() + ids


class TokenFile:
    """Random access to one file's documents."""

    def __init__(self, data: bytes):
        magic, self.width, _, self.unnamed, self.documents, self.ids, self.least = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.read(data, _HEAD.size)
        self.names, self.at = EliasFano.read(data, at)
        self.data = data

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def tokens(self, start: int, end: int):
        import numpy as np

        return np.frombuffer(self.data, f"<u{self.width}", end - start, self.at + start * self.width)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.unnamed + (self.names.all() + self.least).tolist()


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, which gets each distinct chunk once.

    A byte-level BPE splits words off before it merges: never does a piece go on from a visible
    character into white space, nor from a letter into one of ``.,;:!?``. So a text is cut there,
    and the ids of its chunks, kept in a bounded table, are those of the text. New chunks go to the
    library many at a time, with a NUL between them, which no merge touches. Texts with characters
    that Python and the library may class differently, with a NUL or an added token (which the library
    finds in a text before it splits it) are passed whole.
    """

    chunk = re.compile(r"\s?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\s.,;:!?])|[.,;:!?]++(?!\S)|\s*+\S++|\s++")
    simple = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str, most: int = 450_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        # The chunks of late and those before them; the latter go when the former are many.
        self.most, self.known, self.older = most, {}, {}
        self.unsure = [*"\x00\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff", *(t.content for t in self.model.get_added_tokens_decoder().values())]
        nul = self.model.encode("\x00", add_special_tokens=False).ids
        # Only a vocabulary in which NUL is a token of its own, and part of no other, can be asked for many chunks at once.
        byte = self.model.id_to_token(nul[0]) if len(nul) == 1 else None
        self.nul = nul[0] if byte and sum(byte in t for t in self.model.get_vocab()) == 1 else None
        # A byte-level vocabulary writes visible Latin-1 characters as they are and other bytes as characters from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}
        probe = ["a", " the", " Äpfel", " señor", "ÉTÉ", " ÿ", " àé"]
        self.direct = [self.word(c) for c in probe] == [self.whole(c) for c in probe]

    def word(self, chunk: str) -> bytes:
        """Ids of letters with at most one space before them: the library's merges without its splitting."""
        written = chunk.replace(" ", "\u0120") if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.model.tokenize(written)]
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.model.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def many(self, chunks: list[str]) -> list[bytes]:
        import numpy as np

        if self.nul is None:
            return [self.whole(c) for c in chunks]
        out = []
        for at in range(0, len(chunks), 1000):
            ids = np.array(self.model.encode("\x00".join([*chunks[at : at + 1000], ""]), add_special_tokens=False).ids, f"<u{self.width}")
            data, first = ids.tobytes(), 0
            for end in np.flatnonzero(ids == self.nul).tolist():
                out.append(data[first * self.width : end * self.width])
                first = end + 1
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        cut = [None if any(u in text for u in self.unsure) else self.chunk.findall(text) for text in texts]
        new = []
        for c in set(chain.from_iterable(c for c in cut if c)):
            if c not in known:
                if c in older:
                    known[c] = older[c]
                elif self.direct and self.simple.fullmatch(c):
                    known[c] = self.word(c)
                else:
                    new.append(c)
        # White space and apostrophes are split by what stands beside them, so these never meet a NUL.
        alone = [c for c in new if c[0] == "'" or c.isspace()]
        known.update((c, self.whole(c)) for c in alone)
        new = [c for c in new if c not in known]
        known.update(zip(new, self.many(new), strict=True))
        return [self.whole(text) if chunks is None else b"".join(map(known.__getitem__, chunks)) for text, chunks in zip(texts, cut, strict=True)]


@lru_cache(1)
def encoder_for(path: str) -> ChunkEncoder:
    """One encoder for a worker process, whatever the number of its tasks."""
    return ChunkEncoder(path)


def small_lists(values: list, most: int = 3 << 20) -> Iterator[list]:
    """Runs of texts of about ``most`` characters; a longer one stands alone."""
    held, size = [], 0
    for v in values:
        if held and size + len(v) > most:
            yield held
            held, size = [], 0
        held.append(v)
        size += len(v)
    if held:
        yield held


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_files(docs: DataFrame, vocabulary: str | None = None, path: str | None = None, partition_bytes: int = 8 << 20, file_ids: int = 4 << 20, group_parts: int = GROUP_PARTS) -> tuple[str, DataFrame]:
    """Encode (doc_id, text), end each document with id 0, write files in ascending doc_id order.

    Gives the folder and its manifest (file, part, seq, n_docs, n_ids, first_id), one row a file.
    Null and empty texts have the end id only; rows without a doc_id come first; repeated rows are
    written each; an empty table writes no file; very long texts make longer files. Rows of one
    doc_id follow each other by a hash of their texts, so many of them make several parts. Each attempt
    of a task writes under names of its own, and the manifest lists those of the attempts that Spark
    took. A sort deals ``group_parts`` parts of ``partition_bytes`` at most; larger tables are first
    written in groups of doc_ids between bounds from a quantile sketch, and sorted group by group.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    path = path or scratch(spark, "token-files")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, math.ceil(size / partition_bytes))
    sizes = [(0, parts)]
    if parts > group_parts:
        docs, sizes = _grouped(docs, math.ceil(parts / group_parts), partition_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = first_part + task.partitionId(), task.taskAttemptId()
        encoder = encoder_for(vocabulary)
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(f"{folder}/data", recursive=True)
        names, lengths, ids, held, seq = [], [], [], 0, 0
        end = END_ID.to_bytes(encoder.width, "little")

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:05d}-{attempt}.tok"
            with store.open_output_stream(f"{folder}/data/{name}") as out:
                out.write(pack_file(names, lengths, b"".join(ids), encoder.width))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "n_docs": [len(names)], "n_ids": [held]}, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for texts in small_lists(batch.column("text").to_pylist()):
                for got in encoder.encode(texts):
                    names.append(next(doc_ids))
                    ids += (got, end)
                    lengths.append(len(got) // encoder.width + 1)
                    held += lengths[-1]
                    if held >= file_ids:
                        yield flush()
                        names, lengths, ids, held, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    first_part = 0
    for group, parts in sizes:
        own = docs.where(F.col("group") == group) if len(sizes) > 1 else docs
        order = ["doc_id", F.xxhash64("text"), "text"]
        # (doc_id, hash) deals the parts; equal rows stay together, whatever their number.
        dealt = own.select("doc_id", "text").repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
        files = dealt.mapInArrow(run, "file string, part int, seq int, n_docs long, n_ids long").withColumn("group", F.lit(group))
        files.write.mode("append").parquet(f"{path.rstrip('/')}/files")
        first_part += parts
    return path, _manifest(spark, path.rstrip("/"))


def _grouped(docs: DataFrame, groups: int, partition_bytes: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``docs`` written by ``group``, ranges of doc_id in ascending order, and (group, parts) of each that has rows."""
    spark = docs.sparkSession
    edges = docs.agg(F.percentile_approx("doc_id", [k / groups for k in range(1, groups)], 100 * groups)).first()[0]
    written = scratch(spark, "token-groups")
    # A group comes together in a fixed number of tasks, so that there are few files, whatever the order of the input.
    dealt = docs.withColumn("group", _place(F.col("doc_id"), edges, 0)).repartition(groups * GROUP_TASKS, "group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(GROUP_TASKS)))
    dealt.write.partitionBy("group").parquet(written)
    docs = spark.read.schema("doc_id long, text string, group int").parquet(written)
    sizes = docs.groupBy("group").agg(F.sum(F.octet_length("text")).alias("size")).orderBy("group").collect()  # one row a group
    return docs, [(r["group"], max(1, math.ceil(r["size"] / partition_bytes))) for r in sizes]


def _place(value: Column, edges: list[int], first: int) -> Column:
    """``first`` plus the number of ``edges``, which ascend, that are not above ``value``; a null is below all."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(value >= edges[mid], _place(value, edges[mid + 1 :], first + mid + 1)).otherwise(_place(value, edges[:mid], first))


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the files that tasks wrote: running sums over a part's files, a group's parts, and the groups."""
    files = spark.read.parquet(f"{path}/files")

    def ahead(rows: DataFrame, within: list[str], by: str) -> Column:
        """What rows ``by`` order hold before each row; a task has the rows of one value of ``within``."""
        window = Window.partitionBy(*within).orderBy(by) if within else Window.orderBy(by)
        return F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    of_part = files.groupBy("group", "part").agg(F.sum("n_ids").alias("n_ids"))
    of_group = of_part.groupBy("group").agg(F.sum("n_ids").alias("n_ids"))
    of_part = of_part.select("group", "part", ahead(of_part, ["group"], "part").alias("in_group"))
    of_group = of_group.select("group", ahead(of_group, [], "group").alias("ahead"))
    first = F.col("ahead") + F.col("in_group") + F.col("in_part")
    manifest = files.withColumn("in_part", ahead(files, ["part"], "seq")).join(of_part, ["group", "part"]).join(of_group, "group")
    manifest.select("file", "part", "seq", "n_docs", "n_ids", first.cast("long").alias("first_id")).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True, most: int = 20_000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and the ids of each document, from the files and manifest alone.

    Tasks, ``most`` at most, get names of files and read these one at a time; a document's place in
    its file comes from ``select`` on the stored boundaries. An empty manifest gives an empty result.
    """
    manifest = spark.read.parquet(f"{path.rstrip('/')}/manifest").select("file", "first_id")
    tasks = max(1, min(most, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                with store.open_input_stream(f"{folder}/data/{name}") as source:
                    file = TokenFile(source.read())
                ends = [file.ends.select(i) for i in range(file.documents)]
                starts = [0, *ends[:-1]]
                wide = file.tokens(0, file.ids).astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts, ends, strict=True)]
                starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
                columns = [pa.array(file.doc_ids(), pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(wide.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return manifest.repartition(tasks).mapInArrow(run, schema)


def op6_token_files(docs: DataFrame) -> DataFrame:
    path, _ = write_token_files(docs)
    return read_token_files(docs.sparkSession, path, with_ids=False)
