"""The corpus pipeline: five stages over ``documents``, each applying one operator of chromaspan.llm.

A stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaspan.llm import decontamination, language_id, line_dedup, near_dups, sentencepiece_codec
from chromaspan.llm.common import fresh, materialise, table

#: Documents whose best language has a smaller part of the text are rejected.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those in which no language has half; ``lang`` becomes the language found.

    So null and empty texts go. Repeated rows stay or go together; an empty table, or one without any
    labelled text to learn from, gives an empty result; columns of any other name are passed on.
    """
    return language_id.keep_languages(docs, language_id.learn(docs), LEAST_SHARE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that three or more rows share out of all but that with the largest doc_id; ``n_chars`` follows the text.

    All rows stay; a null text becomes an empty one; repeated rows count as documents of their own and
    lose the same lines. Columns of any other name are passed on.
    """
    (new,) = fresh(docs, "new")
    text = F.col(f"{new}.text")
    changed = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return line_dedup.docs_without_lines(docs, new).select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near copies.

    Texts without words stay. Rows are dropped by doc_id: those that share one stay or go together, those without one stay.
    """
    return near_dups.dedup(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in which a window of a benchmark item occurs; null and empty texts stay, repeated rows go together."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, round_trip) of each row that is left; a null or empty text has no ids."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dups", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Mixture inference and merges are beyond SQL; the tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder, and the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
