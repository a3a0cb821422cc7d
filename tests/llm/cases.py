"""Small tables with the awkward cases, and the brute-force versions that results are held against."""

import hashlib
import re
from collections import Counter

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LINE = "This line is shared by several documents, word for word."
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
TEXTS = [
    None, "", " \n\t ", "???", "é", "word", "Mail a.b@c-d.com or +1 (555) 123-4567, card 4111 1111 1111 1111, ip 10.0.0.255 and 1.2.3.4567",
    BASE, BASE + "and an ending", BASE.upper(), BASE.replace("ten", "TENTH", 1), LINE + "\nfirst", "  " + LINE.upper() + "\t\nsecond\n\n" + LINE, LINE + "\nthird",
    "x" * 5000, "word " * 20_000, "1 " * 4000, "\n" * 50, "日本語 テキスト " * 20, "no\x00nul\x1chere <|endoftext|> 's it's　end ", "Licensed under CC BY-NC 4.0. All rihts reserved.",
    "der die das und ist nicht ein eine mit " * 10, "the and of to is that with for " * 10,
]


def documents(spark, texts=TEXTS, repeat=True):
    """Rows with ids from 0; a repeated row, one without an id, extra columns with clashing names."""
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 2}" if i % 5 else None, len(t or ""), -1, "x") for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[-1], (None, texts[-1], "en", None, 0, -1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string")


def sf_documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often, covered, seen, dup = Counter(windows), set(), set(), 0
    for k, g in enumerate(windows):
        if often[g] > 1:
            covered |= {k, k + 1, k + 2}
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def shingle_set(text):
    words = SPACE.findall((text or "").translate(AZ))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
