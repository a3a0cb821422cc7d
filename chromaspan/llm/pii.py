"""Personal data by weak supervision, on DataFrame functions only.

Patterns propose candidate spans; labelers (format, checksum, gazetteers, context words, company of
other candidates) vote on each: 1, -1 or 0 to abstain. Expectation-maximisation over the counted
vote patterns estimates, by kind, how reliable each labeler is, and from that how likely each vote
pattern is personal data. With those soft labels a final span classifier is trained: naive Bayes
over the word before, the shape, the length, the character after and the votes. Spans of
the base kinds that pass their own test are always reported; the classifier decides on the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialise

#: Base kinds in order, with their patterns. Possessive forms match the same and need no stack; a
#: local part or number is only tried from its start or from the end of the last match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a search.
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Further kinds that the method adds.
MORE = {
    "local_phone": r"(?<![0-9+(])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z]{2,24}",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,250}|[prs]k_(?:live|test)_[A-Za-z0-9]{16,250}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000})|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:api|access|secret|private|auth|client)?[\x20_-]?(?:key|token|secret|passw(?:or)?d|passphrase|pwd|credentials?)[\x22\x27]?\x20{0,2}[:=]\x20{0,2}[\x22\x27]?[^\s\x22\x27<>,;]{6,200}",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
}
MORE_GATE = {"local_phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}", "spelled_email": r"(?i)[\[(]at[\])]", "national_id": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "access_key": "AKIA|ASIA|gh[pousr]_|xox[abprs]-|[prs]k_(?:live|test)_|AIza|eyJ|PRIVATE KEY", "secret": r"(?i)(?:key|token|secret|passw(?:or)?d|passphrase|pwd|credentials?)[\x22\x27]?\x20{0,2}[:=]", "name": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\.?\x20"}
KINDS = [*BASE, *MORE]
#: Parts of an address up to 255.
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: Values that stand for a secret without being one.
PLACEHOLDER = r"(?i)[:=]\s*\W?(?:x{4,}|\*{4,}|your|example|changeme|placeholder|none|null|true|false|undefined|required)"
#: Gazetteers: top-level domains, country calling codes, card issuers' first digits, country codes, first names.
TOP_LEVEL = ["com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ca", "ch", "at", "be", "pl", "mx", "ar", "br", "jp", "cn", "in", "au", "ru", "kr", "se", "no", "dk", "fi", "pt", "ie", "cz", "gr", "hu", "ro", "tr", "za", "nz", "cl", "co", "pe", "app", "dev", "ai", "me", "tv", "online", "shop", "xyz"]
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6)"
COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
FIRST_NAMES = ["Anna", "Maria", "John", "James", "Mary", "Robert", "Michael", "David", "Peter", "Paul", "Thomas", "Jean", "Pierre", "Marie", "Claire", "Hans", "Karl", "Klaus", "Julia", "Laura", "Carlos", "Juan", "Jose", "Luis", "Ana", "Carmen", "Sofia", "Emma", "Linda", "Susan", "William", "Richard", "Joseph", "Charles", "Daniel", "Matthew", "Mark", "Andrew", "Elizabeth", "Barbara", "Sarah", "Karen", "Lisa", "Nancy", "Jürgen", "Wolfgang", "Stefan", "Andreas", "Sabine", "Petra", "Ursula", "Heike", "Philippe", "Michel", "Nathalie", "Isabelle", "Sophie", "Manuel", "Antonio", "Francisco", "Javier", "Isabel", "Pilar", "Lucia"]
#: Context words that speak for a kind, and such that speak against any.
FOR = {
    "email": r"(?i)mail|contact|write|reach", "ip": r"(?i)\bip\b|address|host|server|login|from", "card": r"(?i)card|visa|master|amex|credit|pay|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobil|cell|fax|contact", "local_phone": r"(?i)phone|call|tel|mobil|cell|fax|contact", "spelled_email": r"(?i)mail|contact|write|reach",
    "national_id": r"(?i)ssn|social|security|tax|\bid\b", "iban": r"(?i)iban|account|bank|konto|compte|cuenta", "name": r"(?i)dear|by|from|with|meet|regards|signed",
    "access_key": r"(?i)key|token|secret|credential|export|auth", "secret": r"(?i)export|config|env|login|credential|auth|set",
}
AGAINST = r"(?i)version|isbn|issn|order|invoice|ratio|figure|table|chapter|page|section|build|release|item|example|\bv$|[#$€£]\s*$"
LABELERS = ["format", "checksum", "gazetteer", "context", "counter", "company"]
#: Least and largest odds that a vote may speak for.
BETTER = {1: (2.0, 1e6), 0: (0.8, 1.25), -1: (1e-6, 0.5)}
#: Spans of the usual kind that are added to each class of the span classifier.
SMOOTH = 10.0
SPAN = "kind string, start int, end int, value string, before string, after string"


def running_sums(lens: Column) -> Column:
    """Inclusive sums of an array of integers, in blocks so that long arrays are not copied for each element."""
    step = 256

    def sums(block: Column, first: Column) -> Column:
        grown = F.aggregate(block, F.array(first), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
        return F.slice(grown, F.lit(2), F.size(block))

    blocks = F.transform(F.sequence(F.lit(1), F.size(lens), F.lit(step)), lambda at: F.slice(lens, at, F.lit(step)))

    def whole(bs: Column) -> Column:
        totals = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        offsets = F.concat(F.array(F.lit(0)), sums(totals, F.lit(0)))
        return F.flatten(F.zip_with(bs, F.slice(offsets, F.lit(1), F.size(bs)), sums))

    return let(blocks, whole)


def spans(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches as SPAN structs: places are code points, context is what lies between matches."""
    matches = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def located(m: Column) -> Column:
        def build(gaps: Column) -> Column:
            ends = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.char_length(g) + F.char_length(x)))
            one = lambda x, k, e: F.struct(F.lit(kind).alias("kind"), (F.get(e, k) - F.char_length(x)).alias("start"), F.get(e, k).alias("end"), x.alias("value"), F.right(F.get(gaps, k), F.lit(24)).alias("before"), F.left(F.get(gaps, k + 1), F.lit(12)).alias("after"))
            return let(ends, lambda e: F.transform(m, lambda x, k: one(x, k, e)))

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), build))

    none = F.array().cast(f"array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")
    return F.coalesce(F.when(matches.isNotNull(), let(matches, located)), none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    terms = F.transform(F.sequence(F.lit(1), F.char_length(d)), lambda i: let(F.substring(d, F.char_length(d) - i + 1, F.lit(1)).cast("int"), lambda x: F.when(i % 2 == 1, x).otherwise(double(x))))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(x: Column) -> Column:
    """The base kinds' own test; other kinds have none."""
    size = F.char_length(digits(x["value"]))
    return (
        F.when(x["kind"] == "email", F.lit(True))
        .when(x["kind"] == "ip", x["value"].rlike(_OCTETS))
        .when(x["kind"] == "card", size.between(14, 19) & luhn(digits(x["value"])))
        .when(x["kind"] == "phone", size.between(10, 15))
        .otherwise(F.lit(False))
    )


def votes(x: Column, n_kinds: Column) -> list[Column]:
    """One vote of each labeler on a span: 1, -1 or 0."""
    kind, value = x["kind"], x["value"]
    size = F.char_length(digits(value))
    yes_no = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))
    by_kind = lambda cases: F.coalesce(*[F.when(kind == k, v) for k, v in cases.items()], F.lit(0))
    shape = by_kind({
        "email": yes_no(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9-]*(\.[A-Za-z0-9][A-Za-z0-9-]*)*\.[A-Za-z]{2,}$")),
        "ip": yes_no(~value.rlike(r"(^|\.)0[0-9]")), "card": yes_no(value.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$")),
        "phone": yes_no(size.between(10, 13)), "local_phone": F.lit(1), "national_id": yes_no(~value.rlike("^(000|666|9)|-00-|-0000$")), "iban": yes_no(F.char_length(F.replace(value, F.lit(" "))).between(15, 34)),
        "access_key": F.lit(1), "secret": yes_no(value.rlike(r"[:=]\s*\W?(?=\S*[0-9])(?=\S*[A-Za-z])\S{8,}$")),
    })
    check = by_kind({"ip": yes_no(value.rlike(_OCTETS)), "card": yes_no(size.between(14, 19) & luhn(digits(value))), "phone": yes_no(size.between(10, 15))})
    known = by_kind({
        "email": yes_no(F.lower(F.substring_index(value, ".", -1)).isin(TOP_LEVEL)), "ip": yes_no(~value.rlike(r"^(0|10|127|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.")),
        "card": yes_no(value.rlike(ISSUERS)), "phone": yes_no(value.rlike(CALLING)), "spelled_email": yes_no(F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1)).isin(TOP_LEVEL)),
        "iban": yes_no(F.substring(value, 1, 2).isin(COUNTRIES)), "name": F.when(F.element_at(F.split(value, " "), 2).isin(FIRST_NAMES), F.lit(1)).otherwise(F.lit(0)),
        "access_key": F.lit(1), "secret": yes_no(~value.rlike(PLACEHOLDER)),
    })
    context = by_kind({k: F.when(x["before"].rlike(p), F.lit(1)).otherwise(F.lit(0)) for k, p in FOR.items()})
    counter = F.when(x["before"].rlike(AGAINST) | x["after"].rlike(r"^\s*%"), F.lit(-1)).otherwise(F.lit(0))
    company = F.when(n_kinds > 1, F.lit(1)).otherwise(F.lit(0))
    return [shape, check, known, context, counter, company]


def features(x: Column, vote: Column) -> Column:
    """Feature values of a span; words and shapes are hashed, so a kind has a bounded number of each."""
    word = F.lower(F.regexp_extract(x["before"], r"(\S+)\s*$", 1))
    outline = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["value"], "[0-9]+", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    after = F.when(x["after"] == "", F.lit("end")).when(x["after"].rlike(r"^\s"), F.lit("space")).when(x["after"].rlike(r"^[\p{L}0-9]"), F.lit("word")).otherwise(F.lit("mark"))
    return F.array(
        F.concat(F.lit("word="), F.pmod(F.xxhash64(word), F.lit(256)).cast("string")),
        F.concat(F.lit("shape="), F.pmod(F.xxhash64(outline), F.lit(256)).cast("string")),
        F.concat(F.lit("length="), F.floor(F.log2(F.char_length(x["value"]) + 1)).cast("string")),
        F.concat(F.lit("after="), after),
        F.concat(F.lit("votes="), vote),
    )


def candidates(docs: DataFrame, row: Column) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row (a number of its own), base (spans that passed) and cands (kind, start, end, vote, features of all others)."""
    text = F.coalesce("text", F.lit(""))
    located = {k: spans(F.col("text"), k, p, F.col("text").contains(GATE[k]) if k == "email" else F.col("text").rlike(GATE[k])) for k, p in BASE.items()}
    located |= {k: spans(F.col("text"), k, p, F.col("text").rlike(MORE_GATE[k])) for k, p in MORE.items()}
    rows = docs.select("doc_id", row.alias("row"), text.alias("text")).select("doc_id", "row", *[c.alias(k) for k, c in located.items()])
    rows = rows.select("doc_id", "row", F.concat(*KINDS).alias("all"))
    rows = rows.select("doc_id", "row", "all", F.size(F.array_distinct(F.transform("all", lambda x: x["kind"]))).alias("n_kinds"))

    def judged(x: Column) -> Column:
        vote = F.concat_ws(",", *[v.cast("string") for v in votes(x, F.col("n_kinds"))])
        return let(vote, lambda v: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), valid(x).alias("base"), v.alias("vote"), features(x, v).alias("features")))

    return rows.select("doc_id", "row", F.transform("all", judged).alias("found"))


def reliabilities(patterns: DataFrame, rounds: int = 8, strength: float = 20.0) -> DataFrame:
    """EM over counted vote patterns (kind, vote, n): the same rows with ``p``, the probability of personal data.

    Only the parameters (kinds x labelers x 3 votes x 2 classes) come to the driver. Prior counts of
    ``strength`` keep a vote's meaning in place where data are few. A labeler counts as better than
    chance: where all candidates of a kind look alike, the counts alone could not tell the classes
    apart, so the odds of a vote stay within BETTER.
    """
    prior_vote = {1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.15, 0: 0.35, -1: 0.5}}
    # A failed checksum is all but a proof to the contrary.
    prior_check = {1: {1: 0.69, 0: 0.3, -1: 0.01}, 0: {1: 0.1, 0: 0.3, -1: 0.6}}
    believed = lambda j, v, y: (prior_check if LABELERS[j] == "checksum" else prior_vote)[y][v]
    like = {(k, j, v, y): believed(j, v, y) for k in KINDS for j in range(len(LABELERS)) for v in (1, 0, -1) for y in (0, 1)}
    prior = dict.fromkeys(KINDS, 0.5)
    given = F.split("vote", ",")
    scored = patterns
    for _ in range(rounds):
        odds = F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k, math.log(prior[k] / (1 - prior[k])))]), F.col("kind"))
        for j in range(len(LABELERS)):
            ratio = F.create_map(*[F.lit(x) for k in KINDS for v in (1, 0, -1) for x in (f"{k},{v}", math.log(like[k, j, v, 1] / like[k, j, v, 0]))])
            odds = odds + F.element_at(ratio, F.concat_ws(",", "kind", F.get(given, F.lit(j))))
        scored = patterns.withColumn("p", 1 / (1 + F.exp(-odds)))
        sums = [F.sum(F.when(F.get(given, F.lit(j)) == str(v), F.col("n") * (F.col("p") if y else 1 - F.col("p"))).otherwise(0.0)).alias(f"{j},{v},{y}") for j in range(len(LABELERS)) for v in (1, 0, -1) for y in (0, 1)]
        for row in scored.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("yes"), *sums).collect():
            k, by = row["kind"], {1: row["yes"], 0: row["n"] - row["yes"]}
            prior[k] = min(0.99, max(0.01, (by[1] + strength / 2) / (row["n"] + strength)))
            for j in range(len(LABELERS)):
                for v in (1, 0, -1):
                    for y in (0, 1):
                        like[k, j, v, y] = (row[f"{j},{v},{y}"] + strength * believed(j, v, y)) / (by[y] + strength)
                    ratio = like[k, j, v, 1] / like[k, j, v, 0]
                    shift = math.sqrt(min(max(ratio, BETTER[v][0]), BETTER[v][1]) / ratio)
                    like[k, j, v, 1], like[k, j, v, 0] = like[k, j, v, 1] * shift, like[k, j, v, 0] / shift
    return scored


def classify(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, p) of every candidate (row, kind, start, end, vote, features) by the trained classifier."""
    patterns = materialise(found.groupBy("kind", "vote").agg(F.count("*").alias("n")), "vote-patterns")
    soft = materialise(reliabilities(patterns), "soft-labels").select(F.col("kind").alias("k"), F.col("vote").alias("v"), "n", "p")
    totals = soft.groupBy("k").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    each = found.select("kind", "vote", F.explode("features").alias("feature")).groupBy("kind", "vote", "feature").agg(F.count("*").alias("times"))
    each = each.join(soft.drop("n"), (F.col("kind") == F.col("k")) & (F.col("vote") == F.col("v")))
    weights = each.groupBy("kind", "feature").agg(F.sum(F.col("times") * F.col("p")).alias("f_yes"), F.sum(F.col("times") * (1 - F.col("p"))).alias("f_no"))
    weights = weights.join(totals, F.col("kind") == F.col("k"))
    # Both classes are smoothed towards the kind's whole distribution, so that a rare value speaks for neither.
    usual = SMOOTH * (F.col("f_yes") + F.col("f_no")) / (F.col("yes") + F.col("no"))
    weight = F.log((F.col("f_yes") + usual) / (F.col("yes") + SMOOTH)) - F.log((F.col("f_no") + usual) / (F.col("no") + SMOOTH))
    odds = F.log((F.col("yes") + 1) / (F.col("no") + 1))
    # At most some hundred features by kind (hashed words, hashed shapes, vote patterns), so this may be broadcast.
    model = F.broadcast(materialise(weights.select(F.col("kind").alias("mk"), F.col("feature").alias("mf"), weight.alias("w"), odds.alias("o")), "span-classifier"))
    scored = found.select("row", "kind", "start", "end", F.explode("features").alias("feature")).join(model, (F.col("kind") == F.col("mk")) & (F.col("feature") == F.col("mf")))
    return scored.groupBy("row", "kind", "start", "end").agg((1 / (1 + F.exp(-(F.max("o") + F.sum("w"))))).alias("p"))


def find_pii(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """(doc_id, base, spans) for each row of ``docs``: arrays of (start, rank, kind, end), sorted.

    ``base`` has the spans of the base kinds that pass their test, ``spans`` these and what the
    classifier accepts with a probability over ``accept``. Null and empty texts have none; repeated
    rows come out alike; a null doc_id stays; an empty table gives an empty result. Whole texts are
    searched, however long. Only doc_id and text are read.
    """
    return _find(materialise(candidates(docs, F.monotonically_increasing_id()), "span-candidates"), accept).drop("row")


def _find(rows: DataFrame, accept: float) -> DataFrame:
    """(row, doc_id, base, spans) of written ``candidates``."""
    rank = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(KINDS)])
    as_span = lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("found", lambda x: x["base"]), as_span))
    found = rows.select("row", F.explode("found").alias("x")).select("row", "x.kind", "x.start", "x.end", "x.base", "x.vote", "x.features")
    accepted = classify(found).where(F.col("p") > accept)
    more = accepted.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("start", rank(F.col("kind")).alias("rank"), "kind", "end")).alias("more"))
    joined = rows.select("doc_id", "row", base.alias("base")).join(more, F.col("row") == F.col("r"), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return joined.select("row", "doc_id", "base", F.array_sort(F.array_union("base", F.coalesce("more", none))).alias("spans"))


def redact(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """``docs`` with ``spans``, and in ``text`` each span replaced by its kind in angle brackets; of overlapping spans the first counts.

    Rows are told apart by a number of their own, so repeated rows and doc_ids come out once each; a
    null text stays null, and very long texts are redacted whole; an empty table gives an empty
    result; a column ``spans`` is replaced.
    """
    docs = docs.drop("spans")
    row, r = fresh(docs, "row_", "found_row_")
    docs = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    rows = materialise(candidates(docs, F.col(row)), "span-candidates")
    found = _find(rows, accept).select(F.col("row").alias(r), "spans")
    joined = docs.join(found, F.col(row) == F.col(r)).drop(row, r)

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        more = F.struct(x["end"].alias("at"), F.concat(acc["parts"], F.array(gap, F.concat(F.lit("<"), x["kind"], F.lit(">")))).alias("parts"))
        return F.when(x["start"] >= acc["at"], more).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"] + 1, F.char_length("text")))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, end)).otherwise(F.col("text"))
    return joined.withColumn("text", clean)


def op2_pii(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
