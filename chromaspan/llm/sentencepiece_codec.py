"""SentencePiece encoding and decoding over a streaming lattice.

Characters are taken one by one. For each boundary the best piece that ends there is kept as a
backpointer, looking back no further than the longest piece. As soon as the backpointer paths of
all boundaries within that distance meet in one boundary, the ids before it are committed and
forgotten. A unigram model keeps the piece with the best sum of scores (Viterbi). A BPE model's ids
do not follow from sums of scores; there a piece may end a path only if the merges, applied to
the last piece of the path and to it, leave the two apart: exactly one piece then fits each
boundary, and the path is the sequence of ids that merging gives.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class _Suffix(dict):
    """The longest end of the text so far that begins a piece: the next by character, with the pieces of two or more
    characters that end here (id, width, what is known of the pieces before), longest first, and the id of the last character."""

    __slots__ = ("fail", "one", "pieces", "spare")

    def __missing__(self, char: str) -> _Suffix:
        if self.fail is None:
            return self
        found = self.fail[char]
        if found.fail is not None and self.spare[0]:  # steps that are kept are bounded
            self.spare[0] -= 1
            self[char] = found
        return found


class _Chunks(dict):
    """Ids of chunks, which are found when they are first asked for."""

    __slots__ = ("find",)

    def __missing__(self, chunk: str) -> bytes:
        return self.find(chunk)


class Codec:
    """Encoder and decoder of one model file (unigram or BPE, identity normalisation)."""

    def __init__(self, model: bytes, most: int = 300_000):
        self.kind, self.prefix, pieces = UNIGRAM, True, []
        for field, value in _fields(model):
            if field == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, bytes(4)))[0], x.get(3, _NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4, 1):
                    raise ValueError("only models with identity normalisation are supported")
                self.prefix = bool(norm.get(3, 1))
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (_NORMAL, _USER)}
        self.score = [s for _, s, _ in pieces]
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == _UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.longest = max(map(len, self.ids))
        self.least = min(s for _, s, t in pieces if t == _NORMAL) - 10.0
        #: Neighbouring characters that some piece holds; a text may be cut between any others.
        self.held = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        known = set("".join(self.ids))
        self.text_of = [self._text(i) for i in range(len(pieces))]
        # Texts are cut where no piece spans two neighbours: before blanks, at a newline, and between
        # a letter and a stop, as far as this vocabulary allows each. Without any, a text is one chunk.
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        line = "" if "\n" in known else "\n"
        stops = "".join(x for x in ".,;:!?" if not any(a + x in self.held for a in _LETTERS))
        word = f"{SPACE}*[{_LETTERS}]+(?=[{re.escape(stops)}])|" if stops else ""
        self.chunk = re.compile(f"{line}{'|' if line else ''}{word}{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if apart else "(?s).+")
        # Ids of the chunks of late and of those before them; the latter go when the former are many.
        self.most, self.known, self.older, self.longer = most, _Chunks(), {}, {}
        self.known.find = self._learn
        #: Which pieces may come before each, how many such facts are held, and how each piece is merged.
        self.pairs, self.n_pairs, self.steps = {}, 0, {}
        self.width = [len(p) if p in self.ids else 1 for p, _, _ in pieces] + [1]  # the last is that of id -1
        self.root = self._suffixes()
        # Commits made before a chunk's end, and the widest stretch of boundaries that was held for one.
        self.commits = self.widest = 0

    # -- encoding -------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """BPE merges of a short string: the best-scored adjacent pair first, leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _suffixes(self) -> _Suffix:
        """The automaton of all pieces; it stands at its root where no piece goes on."""
        made, spare = {}, [self.most]
        for p in ["", *sorted({p[:i] for p in self.ids for i in range(1, len(p) + 1)}, key=len)]:
            made[p] = node = _Suffix()
            node.spare = spare
            if not p:
                node.fail, node.one, node.pieces = None, -1, ()
                continue
            parent = made[p[:-1]]
            node.fail = parent.fail[p[-1]] if parent.fail is not None else parent
            node.one, node.pieces = self.ids.get(p[-1], -1), node.fail.pieces
            k = self.ids.get(p, -1)
            if k >= 0 and len(p) > 1:
                node.pieces = ((k, len(p), self.pairs.setdefault(k, {})), *node.pieces)
            parent[p[-1]] = node
        return made[""]

    def _steps(self, k: int) -> tuple[list[tuple[float, str, str]], bool]:
        """The merges of a piece: before each its score and the first and last parts, then those left; and whether one part is left."""
        parts, steps = list(self.pieces[k][0]), []
        while True:
            best, at = float("-inf"), -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and self.score[j] > best:
                    best, at = self.score[j], i
            steps.append((best, parts[0], parts[-1]))
            if at < 0:
                return steps, len(parts) == 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging keeps two pieces apart, one a path's last and one that may come next.

        Each is merged as it is alone unless a merge across their border comes first: one with a better
        score than the next of the left and no worse than the next of the right, as ties go to the left.
        """
        if self.n_pairs > self.most:
            self.n_pairs = 0
            for known in self.pairs.values():
                known.clear()
        for k in (left, right):
            if k not in self.steps:
                self.steps[k] = self._steps(k)
        (a, whole_a), (b, whole_b) = self.steps[left], self.steps[right]
        i = j = 0
        found = whole_a and whole_b
        while found:
            (one, _, edge), (other, beyond, _) = a[i], b[j]
            across = self.ids.get(edge + beyond)
            if across is not None and self.score[across] > one and self.score[across] >= other:
                found = False
            elif i == len(a) - 1 and j == len(b) - 1:
                break
            elif j == len(b) - 1 or (i < len(a) - 1 and one >= other):
                i += 1
            else:
                j += 1
        self.pairs.setdefault(right, {})[left] = found
        self.n_pairs += 1
        return found

    def ids_of(self, text: str) -> list[int]:
        """Ids of a text, committed as they become certain; a character without a piece as its bytes or as unknown."""
        score, longest, node = self.score, self.longest, self.root
        out: list[int] = []
        # By boundary since the last commit: id of the piece that ends there, best sum of scores.
        last, total = [-1], [0.0]
        done, end, check = 0, 0, 2 * longest
        while True:
            stop = min(len(text), done + check)
            stretch = text[end:stop] if end or stop < len(text) else text
            if self.kind == BPE:
                for char in stretch:
                    node = node[char]
                    # From the longest on; if no longer piece fits, the character by itself does.
                    for k, w, pairs in node.pieces:
                        before = last[-w]
                        if before < 0 or (pairs[before] if before in pairs else self.apart(before, k)):
                            last.append(k)
                            break
                    else:
                        last.append(node.one)
            else:
                for char in stretch:
                    node = node[char]
                    best = node.one
                    most = total[-1] + (score[best] if best >= 0 else self.least)
                    for k, w, _ in reversed(node.pieces):
                        new = total[-w] + score[k]
                        if new >= most:
                            best, most = k, new
                    total.append(most)
                    last.append(best)
            end = stop
            if end - done < check:
                return out + self._back(text, last, done, len(last) - 1)
            meet = self._meeting(last, end - done)
            self.commits, self.widest = self.commits + (meet > 0), max(self.widest, end - done)
            if meet:
                out += self._back(text, last, done, meet)
                last, total = last[meet:], [x - total[meet] for x in total[meet:]]
                done += meet
            # Looked at again a piece's length later; where paths stay apart, as they may in a string that
            # repeats itself, only after half as much again, so that looking takes no more than the steps.
            check = end - done + (longest if meet else max(longest, (end - done) // 2))

    def _meeting(self, last: list[int], end: int) -> int:
        """The latest boundary that the paths of all boundaries a later piece can start from share."""
        alive = set(range(max(0, end - self.longest + 1), end + 1))
        while len(alive) > 1:
            i = max(alive)
            alive.remove(i)
            alive.add(i - self.width[last[i]])
        return alive.pop()

    def _back(self, text: str, last: list[int], done: int, end: int) -> list[int]:
        """Ids of the path from boundary ``end`` back to the last commit, in order."""
        width, path, ends = self.width, [], []
        while end > 0:
            k = last[end]
            path.append(k)
            if k < 0:
                ends.append(end)
            end -= width[k]
        path.reverse()
        if not ends:
            return path
        out: list[int] = []
        for k in path:
            if k >= 0:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes[b] for b in text[done + ends.pop() - 1].encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def forget(self) -> None:
        """Drop the older half of what has been learned of texts."""
        self.older = {}

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; what came before is looked up."""
        if not text:
            return b""
        if len(self.known) > self.most:
            self.older, self.known = self.known, _Chunks()
            self.known.find = self._learn
        chunks = self.chunk.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        ids = b"".join(map(self.known.__getitem__, chunks))
        self.longer.clear()
        return ids

    def _learn(self, chunk: str) -> bytes:
        """Ids of a chunk that is not at hand; long ones are kept for one text."""
        if len(chunk) <= 64:
            found = self.known[chunk] = self.older.get(chunk) or self._cut(chunk)
            return found
        found = self.longer.get(chunk)
        if found is None:
            found = self.longer[chunk] = self._cut(chunk)
        return found

    def _cut(self, chunk: str) -> bytes:
        """Ids of a chunk; where it is too long for one stretch, it is cut wherever no piece can span two neighbours."""
        out, first, held = [], 0, self.held
        if len(chunk) >= 2 * self.longest:
            for i in [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in held]:
                out += self.ids_of(chunk[first:i])
                first = i
        out += self.ids_of(chunk[first:] if first else chunk)
        return struct.pack(f"<{len(out)}i", *out)

    # -- decoding -------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.text_of.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _text(self, i: int) -> bytes:
        piece, _, kind = self.pieces[i]
        if kind == _BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode() if kind in (_NORMAL, _USER) else b" \xe2\x81\x87 " if kind == _UNKNOWN else b""


@lru_cache(1)
def codec_for(model: bytes) -> Codec:
    """One codec for a worker process, whatever the number of its tasks."""
    return Codec(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, round_trip): the ids of each whole text, their number, the
    crc32 of the ids as little-endian 32-bit integers, and whether decoding gives the text back.

    Null and empty texts have no ids and a crc32 of 0. A text that holds the blank symbol U+2581
    itself decodes to a space there, so round_trip is false. Very long texts are encoded whole, piece by
    piece as paths meet. Repeated rows come out alike, an empty table gives an empty result, other
    columns are not read.
    """
    with open(model or default_model(), "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        codec = codec_for(data.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                ids, sizes, crc, same = [], [], [], []
                for text in batch.column("text").to_pylist():
                    got = codec.encode(text or "")
                    ids.append(got)
                    sizes.append(len(got) // 4)
                    crc.append(zlib.crc32(got))
                    same.append(codec.decode(np.frombuffer(got, "<i4").tolist()) == (text or ""))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip"])
        codec.forget()  # the worker process goes on to other stages

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null and empty ids give an empty text, long lists are decoded
    whole, repeated rows alike, an empty table to an empty result; other columns are not read."""
    with open(model or default_model(), "rb") as file:
        data = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(data.value)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(docs: DataFrame) -> DataFrame:
    return encode_documents(docs)
