"""Quality rules: thresholds that adapt to each language and source.

Every document gets a few ratios, taken as if a little text of the usual kind were added to it, so
that short texts and zeros have a place on a logarithmic scale. For each (lang, source) and ratio a
histogram is counted: bucket k holds the values in (g^(k-1), g^k], so counts of any two histograms
add up, and any quantile of the sum is known within the relative error of the bucket width. The
fences of a group are so many quartile distances above and below its median, in buckets; there are
no fixed cutoffs. Groups with few rows borrow those of the language, and then of all documents, and
no group's fence goes further than FACTOR times that of its language, nor a language's than FACTOR
times that of all: so a source that is junk for the most part does not set its own standard.
Documents outside a fence of their group are dropped by a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_SEPARATORS, let, materialise, words

SYMBOLS = r"[#*$%&|<>]"
#: Width of the buckets: values of one bucket differ by at most this part.
ACCURACY = 0.02
#: Groups with fewer rows borrow the thresholds of the next wider group.
MIN_ROWS = 100
#: Tables of thresholds of at most so many rows (some 100 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
#: For each ratio: what is counted, of what, and what is added to both. The added text is of 50 words or
#: 10 lines; a window that is found twice has 6 words.
RATIOS = {"symbol_ratio": ("n_symbols", "n_words", 0.5, 50), "dup_line_ratio": ("n_dup_lines", "n_lines", 0.5, 10), "repeat_ratio": ("n_repeat_words", "n_words", 5.0, 50), "mean_word": ("word_chars", "n_words", 0.0, 0)}
#: Ratios that are also held against a lower fence.
LOWER = {"mean_word"}
#: Quartile distances from the median to a fence, and how far a fence may be from that of the wider group.
SPREAD, FACTOR = 9, 4.0


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more."""
    starts = F.when(F.size(w) >= 4, F.sequence(F.lit(0), F.size(w) - 3))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(pairs: Column) -> Column:
        # Sorted by hash, a repeated window stands beside its equal.
        same = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
        places = F.array_sort(F.transform(same, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    def count(h: Column) -> Column:
        unique = F.size(F.array_distinct(h)) == F.size(h)
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(unique, F.lit(0)).otherwise(let(pairs, covered))

    return F.coalesce(F.when(starts.isNotNull(), let(hashes, count)), F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row's text (null: none)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"), words(F.col("text"), SPACE_SEPARATORS).alias("w"), lines.alias("lines"))
    return rows.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )


def ratio(name: str) -> Column:
    """A ratio of the measures; null for a text without words."""
    part, whole, more, base = RATIOS[name]
    return F.when(F.col(whole) > 0, (F.col(part) + F.lit(more)) / (F.col(whole) + F.lit(base)))


def bucket(value: Column) -> Column:
    """The bucket of a value >= 0; all values under a millionth share one."""
    return F.ceil(F.log(F.greatest(value, F.lit(1e-6))) / math.log1p(ACCURACY)).cast("int")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable histograms of the groups."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bucket(ratio(r)).alias("bucket")) for r in RATIOS])).alias("x")
    return rows.select("lang", "source", each).where("x.bucket IS NOT NULL").groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def fences(hist: DataFrame, by: list[str], spread: int) -> DataFrame:
    """Fences of each group and ratio, as buckets: the median and ``spread`` times the distance to the quartile on that side.

    A distance counts as one bucket at least, which is what a quantile is known to; ``flat`` tells that no quartile differs.
    """
    hist = hist.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "ratio")
    run = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = hist.select(*by, "ratio", "bucket", "n", run.alias("run"), F.sum("n").over(group).alias("total"))
    at = lambda q: F.min(F.when(F.col("run") >= F.ceil(F.col("total") * q), F.col("bucket")))
    q = ranked.groupBy(*by, "ratio").agg(F.max("total").alias("rows"), at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))
    high, low = (F.col("q50") + sign * spread * F.greatest(F.lit(1), width) for sign, width in ((1, F.col("q75") - F.col("q50")), (-1, F.col("q50") - F.col("q25"))))
    return q.select(*by, "ratio", "rows", high.alias("high"), low.alias("low"), (F.col("q25") == F.col("q75")).alias("flat"))


def group_fences(hist: DataFrame, spread: int = SPREAD, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, ratio, high, low, flat): the fences that hold for a group, its own or borrowed ones."""
    own = fences(hist, ["lang", "source"], spread)
    wider = fences(hist, ["lang"], spread).select(F.col("lang").alias("l"), F.col("ratio").alias("lr"), F.col("rows").alias("l_rows"), F.col("high").alias("l_high"), F.col("low").alias("l_low"), F.col("flat").alias("l_flat"))
    widest = fences(hist, [], spread).select(F.col("ratio").alias("ar"), F.col("high").alias("a_high"), F.col("low").alias("a_low"), F.col("flat").alias("a_flat"))
    joined = own.join(wider, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("lr"))).join(widest, F.col("ratio") == F.col("ar"))
    far = math.ceil(math.log(FACTOR) / math.log1p(ACCURACY))
    many, l_many = F.col("rows") >= min_rows, F.col("l_rows") >= min_rows
    l_high = F.when(l_many, F.least("l_high", F.col("a_high") + far)).otherwise(F.col("a_high"))
    l_low = F.when(l_many, F.greatest("l_low", F.col("a_low") - far)).otherwise(F.col("a_low"))
    return joined.select(
        "lang", "source", "ratio", F.when(many, F.least("high", l_high + far)).otherwise(l_high).alias("high"), F.when(many, F.greatest("low", l_low - far)).otherwise(l_low).alias("low"),
        F.when(many, F.col("flat")).when(l_many, F.col("l_flat")).otherwise(F.col("a_flat")).alias("flat"),
    )


def thresholds(hist: DataFrame, spread: int, min_rows: int) -> DataFrame:
    """One row for each (lang, source) with a low and high fence per ratio."""
    both = [F.max(F.when(F.col("ratio") == r, F.col(c))).alias(f"{c}_{r}") for r in RATIOS for c in ("high", "low")]
    return group_fences(hist, spread, min_rows).groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*both)


def judge(docs: DataFrame, spread: int = SPREAD, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, lang, source, text): its measures, ``base_failed``,
    ``failed_rules`` (names of the fences it is outside of) and ``kept``.

    A null text has no words and fails the base rule, as do texts under 50 words and very repetitive
    ones. Null languages and sources form groups of their own. Repeated rows are judged alike. Very
    long texts count whole. An empty table gives an empty result; further columns are not looked at.
    """
    rows = materialise(measures(docs), "quality-measures")
    t = materialise(thresholds(sketches(rows), spread, min_rows), "quality-thresholds")
    if t.count() <= BROADCAST_ROWS:
        t = F.broadcast(t)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # A value is compared by its bucket, as the fences are, and a rule needs a fence.
    outside = lambda r: F.coalesce(bucket(ratio(r)) > F.col(f"high_{r}"), F.lit(False)) | (F.coalesce(bucket(ratio(r)) < F.col(f"low_{r}"), F.lit(False)) if r in LOWER else F.lit(False))
    rules = F.array_compact(F.array(*[F.when(outside(r), F.lit(r)) for r in RATIOS]))
    judged = rows.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    judged = judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), rules.alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op7_quality_rules(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def _fence_sql(name: str, by: str) -> str:
    """The fences of one way of grouping, as common table expressions."""
    keys = f"{by}, " if by else ""
    return f"""{name}_h AS (SELECT {keys}k, bucket, count(*) AS n FROM r GROUP BY {keys}k, bucket),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {keys}k ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {keys}k) AS total FROM {name}_h),
{name} AS (SELECT {keys}k, rows, q50 + {SPREAD} * greatest(1, q75 - q50) AS high, q50 - {SPREAD} * greatest(1, q50 - q25) AS low FROM (
  SELECT {keys}k, max(total) AS rows, min(CASE WHEN run >= ceil(total * 0.25) THEN bucket END) AS q25, min(CASE WHEN run >= ceil(total * 0.5) THEN bucket END) AS q50, min(CASE WHEN run >= ceil(total * 0.75) THEN bucket END) AS q75
  FROM {name}_r GROUP BY {keys}k))"""


#: A factor of 4 in buckets of 2 percent.
_FAR = 71


def _ratio_sql(name: str) -> str:
    part, whole, more, base = RATIOS[name]
    return f"SELECT doc_id, lang, source, '{name}' AS k, (CAST({part} AS DOUBLE) + {more}) / ({whole} + {base}) AS v FROM m WHERE {whole} > 0"


#: DuckDB SQL for op7: the same counts, histograms and fences.
OP7_SQL = rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), win AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words FROM t LEFT JOIN cov USING (doc_id)
), r AS (
  SELECT doc_id, lang, source, k, v, CAST(ceil(ln(greatest(v, 1e-6)) / ln(1.02)) AS INTEGER) AS bucket FROM (
    {" UNION ALL ".join(map(_ratio_sql, RATIOS))}
)
), {_fence_sql("own", "lang, source")}, {_fence_sql("wider", "lang")}, {_fence_sql("widest", "")},
held AS (
  SELECT o.lang, o.source, o.k, o.rows, o.high, o.low, CASE WHEN l.rows >= 100 THEN least(l.high, a.high + {_FAR}) ELSE a.high END AS l_high, CASE WHEN l.rows >= 100 THEN greatest(l.low, a.low - {_FAR}) ELSE a.low END AS l_low
  FROM own o JOIN wider l ON o.lang IS NOT DISTINCT FROM l.lang AND o.k = l.k JOIN widest a ON o.k = a.k
), f AS (
  SELECT r.doc_id, r.k FROM r JOIN held h ON r.lang IS NOT DISTINCT FROM h.lang AND r.source IS NOT DISTINCT FROM h.source AND r.k = h.k
  WHERE bucket > CASE WHEN rows >= 100 THEN least(high, l_high + {_FAR}) ELSE l_high END OR r.k = 'mean_word' AND bucket < CASE WHEN rows >= 100 THEN greatest(low, l_low - {_FAR}) ELSE l_low END
), g AS (SELECT doc_id, string_agg(k, ',' ORDER BY CASE k {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(RATIOS))} END) AS failed_rules FROM f GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
FROM m LEFT JOIN g USING (doc_id)
"""
