"""License scans: short notices found with a bounded number of edits.

A notice of m characters with at most k edits is cut into k + 1 pieces; by the pigeonhole principle
any text within k edits of it holds one of the pieces unchanged. One Aho-Corasick pass over a
document's words finds the pieces; around each, the regex library's bounded-error matching decides
and gives the span and the number of edits. Exact phrases of the base rule are found on the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The phrases of the base rule and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices in the word rule's form (A-Z lowered, words joined by one space) and their labels.
NOTICES = {
    "all rights reserved": "reserved",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license version 2 0": "mpl-2.0",
    "spdx license identifier": "spdx",
    "without warranty of any kind": "no-warranty",
}


def allowed(notice: str, rate: float = 0.08) -> int:
    """Edits that a notice may have: a twelfth of its length, one at least."""
    return max(1, int(len(notice) * rate))


class NoticeFinder:
    """Fuzzy search for a library of notices in normalised text."""

    def __init__(self, notices: dict[str, str] = NOTICES):
        import ahocorasick
        import regex

        self.seeds = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        self.notices = []
        for number, (notice, label) in enumerate(notices.items()):
            k, size = allowed(notice), len(notice)
            cuts = [size * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(notice[a:b], []).append((number, a))
            self.notices.append((notice, label, k, regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}")))
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of each notice's non-overlapping best matches, in characters."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.seeds.iter(text):
            for number, at in uses:
                notice, _, k, _ = self.notices[number]
                low = last + 1 - size - at - k
                high = low + len(notice) + 2 * k
                mine = windows.setdefault(number, [])
                if mine and low <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], high)
                    mine[-1][0] = min(mine[-1][0], low)
                else:
                    mine.append([low, high])
        found = []
        for number, mine in windows.items():
            notice, label, k, pattern = self.notices[number]
            for low, high in mine:
                # The best match of a window may stand behind worse ones: what lies before it is searched again.
                parts = [(max(0, low), min(len(text), high))]
                while parts:
                    a, b = parts.pop()
                    m = pattern.search(text, a, b) if b - a >= len(notice) - k else None
                    if m:
                        found.append((m.start(), m.end(), label, sum(m.fuzzy_counts)))
                        parts += [(a, m.start()), (m.end(), b)]
        return sorted(found)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        at = -1
        try:
            while True:
                at = words.index(parts[0], at + 1)
                if words[at : at + len(parts)] == parts:
                    out.append((at, label))
        except ValueError:
            pass
    return sorted(out)


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, base (word, label) and fuzzy spans.

    ``spans`` has each fuzzy match as first word, word after the last, label and edits. Null and
    empty texts have no words and no spans; very long texts are scanned whole; repeated rows are
    scanned alike; an empty table gives an empty result; columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        finder = NoticeFinder(notices)
        gates = [p.split()[-1].encode() for p in PHRASES]
        for batch in batches:
            n_words, base, spans = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = WORD.findall((text or b"").lower())
                n_words.append(len(words))
                joined = b" ".join(words)
                base.append([{"word": a, "label": x} for a, x in base_places(words)] if any(g in joined for g in gates) else [])
                normal = joined.decode()
                got = finder.find(normal)
                if got:
                    starts, at = [], 0
                    for w in normal.split(" "):
                        starts.append(at)
                        at += len(w) + 1
                    got = [{"first": bisect_right(starts, a) - 1, "end": bisect_right(starts, b - 1), "label": x, "edits": e} for a, b, x, e in got]
                spans.append(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(base, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())])))],
                ["doc_id", "n_words", "base", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, base array<struct<word:long,label:string>>, spans array<struct<first:long,end:long,label:string,edits:int>>")


def op3_license_scan(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    label = lambda x: x["label"]
    base = F.array_sort(F.array_distinct(F.transform("base", label)))
    labels = F.array_sort(F.array_union(F.transform("base", label), F.transform("spans", label)))
    best = F.array_max(F.transform("spans", lambda x: 1.0 - x["edits"] / 10.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"), F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["first"].cast("string"), x["end"].cast("string"), x["edits"].cast("string"))), ",").alias("fuzzy_spans"),
    )
