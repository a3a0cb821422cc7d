"""Language identification by inference of a mixture.

Training counts byte trigrams of every labelled training text, by language, in 2^15 hashed bins.
A document is taken as drawn from a mixture of the languages' trigram distributions: expectation-
maximisation gives the proportions within a set of languages, and the set grows from the best
single language as long as the log-likelihood gains more than a penalty. Two bounds decide most
documents without an iteration: the log-likelihood is concave in a new language's proportion, so
its gain is at most n * (mean likelihood ratio - 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, scratch, slices

BINS = 1 << 15
#: Languages of one block of the model (BINS * 4 bytes each); one block is broadcast, more are read in turn.
BLOCK_LANGUAGES = 200
#: Overlapping trigrams repeat each character three times, so the penalty of a language is three times that of BIC.
PENALTY = 1.5
UNKNOWN = "und"
#: What a prediction holds: the language, its proportion, and the selected set with its proportions.
PREDICTION = "lang_pred string, score double, languages string"


def _letters():
    """Byte table: A-Z lowered, other ASCII but letters to a blank, bytes of non-ASCII characters as they are."""
    import numpy as np

    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


def trigrams(texts: list[bytes], table):
    """Bin of each trigram of each text, one after the other, and the number of trigrams by text."""
    import numpy as np

    data = table[np.frombuffer(b" ".join([b"", *(b" " + t for t in texts), b""]), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    owner = np.concatenate([[0], owner])[: len(data)]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    data, owner = data[keep].astype(np.uint32), owner[keep]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    # A trigram belongs to a text if its middle does and is no blank.
    inside = data[1:-1] != 32
    bins = (code[inside] * np.uint32(2654435761)) >> np.uint32(32 - 15)
    return bins.astype(np.int64), np.bincount(owner[1:-1][inside], minlength=len(texts))


def train(labelled: DataFrame) -> Model:
    """The model of (lang, text), nulls left out; any number of languages, of which a block at a time comes to the driver.

    Every row counts. Tasks add up their own counts, so a language gives BINS rows a task at most.
    """
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = _letters(), {}
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part, by = batch.slice(a, b - a), {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, own in by.items():
                    got = np.bincount(trigrams(own, table)[0], minlength=BINS)
                    counts[lang] = counts[lang] + got if lang in counts else got
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bin", "n"])

    rows = labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "lang string, bin int, n long")
    summed = materialise(rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "language-counts")
    names = sorted(r["lang"] for r in summed.select("lang").distinct().collect())
    blocks = []
    for at in range(0, len(names), BLOCK_LANGUAGES):
        own = names[at : at + BLOCK_LANGUAGES]
        counts = summed.where(F.col("lang").isin(own)).toArrow()
        c = np.full((len(own), BINS), 0.1)
        row = np.searchsorted(own, counts.column("lang").to_numpy(zero_copy_only=False).astype(str)) if len(own) > 1 else np.zeros(counts.num_rows, dtype=np.int64)
        c[row, counts.column("bin").to_numpy()] += counts.column("n").to_numpy()
        blocks.append(np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32))
    return Model.put(summed.sparkSession, names, blocks)


class Model:
    """Languages and, in blocks of rows, their log-probabilities.

    One block is kept as it is, and broadcast; of several, each is a file in the shared folder that
    tasks read one at a time.
    """

    def __init__(self, names: list[str], block=None, paths: list[str] | None = None, size: int = 0) -> None:
        self.names, self.block, self.paths, self.size = names, block, paths or [], size

    @classmethod
    def put(cls, spark: SparkSession, names: list[str], blocks: list) -> Model:
        from pyarrow import fs

        if len(blocks) <= 1:
            return cls(names, blocks[0] if blocks else None)
        store, folder = fs.FileSystem.from_uri(path := scratch(spark, "language-model"))
        store.create_dir(folder, recursive=True)
        paths = []
        for k, block in enumerate(blocks):
            with store.open_output_stream(f"{folder}/{k}") as out:
                out.write(block.tobytes())
            paths.append(f"{path}/{k}")
        return cls(names, None, paths, len(blocks[0]))

    def blocks(self) -> Iterator[tuple[int, object]]:
        """The number of each block's first language, and the block."""
        import numpy as np
        from pyarrow import fs

        if self.block is not None:
            yield 0, self.block
        for k, path in enumerate(self.paths):
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_stream(place) as source:
                yield k * self.size, np.frombuffer(source.read(), np.float32).reshape(-1, BINS)


def proportions(p, n, rounds: int = 30):
    """EM: mixture proportions and log-likelihood of counts ``n`` under the columns of ``p``."""
    import numpy as np

    pi = np.full(p.shape[1], 1 / p.shape[1])
    total, last = n.sum(), -np.inf
    for _ in range(rounds):
        mix = p @ pi
        like = float(n @ np.log(mix))
        if like - last < 1e-3:
            break
        last = like
        pi = pi * (p.T @ (n / mix)) / total
    return pi, float(n @ np.log(p @ pi))


def counted(bins):
    """Distinct bins of a document and how often each stands there."""
    import numpy as np

    if len(bins) < 4000:
        return np.unique(bins, return_counts=True)
    counts = np.bincount(bins)
    return (u := np.flatnonzero(counts)), counts[u]


def infer(documents: list, model: Model) -> list[tuple[list[int], object]]:
    """The selected languages of each document and their proportions; ``documents`` are the bins of their trigrams.

    All documents take a step together, and a step goes through the model block by block: first the
    best single language, then, as long as one gains more than the penalty, the one that gains most.
    So the result is the same for any number of languages and any size of blocks.
    """
    import numpy as np

    counts = [(u, n.astype(float)) for u, n in map(counted, documents)]
    best = [(-np.inf, -1, None)] * len(counts)
    for first, logp in model.blocks():
        for i, (u, n) in enumerate(counts):
            own = logp[:, u].astype(np.float64)
            single = own @ n
            k = int(np.argmax(single))
            if single[k] > best[i][0]:
                best[i] = (single[k], first + k, np.exp(own[k]))
    chosen, pi = [[k] for _, k, _ in best], [np.ones(1) for _ in best]
    like, parts = [x[0] for x in best], [x[2][:, None] for x in best]
    active = list(range(len(counts))) if len(model.names) > 1 else []
    while active:
        gains: dict[int, tuple] = {}
        for first, logp in model.blocks():
            for i in active:
                u, n = counts[i]
                p = np.exp(logp[:, u].astype(np.float64)).T
                penalty = PENALTY * np.log(n.sum() + 1)
                bound = (n / (parts[i] @ pi[i])) @ p - n.sum()
                for k in np.flatnonzero(bound > penalty):
                    if first + k not in chosen[i]:
                        more = np.concatenate([parts[i], p[:, k : k + 1]], axis=1)
                        new, got = proportions(more, n)
                        if got - like[i] > penalty and (i not in gains or got > gains[i][0]):
                            gains[i] = (got, first + int(k), new, more)
        for i, (got, k, new, more) in gains.items():
            chosen[i], like[i], pi[i], parts[i] = [*chosen[i], k], got, new, more
        active = [i for i in gains if len(chosen[i]) < len(model.names)]
    return list(zip(chosen, pi, strict=True))


def prediction(docs: DataFrame, model: Model) -> Column:
    """A PREDICTION struct from the column ``text`` of ``docs``; only texts go to Python, and only predictions come back.

    Null texts and those without a letter are UNKNOWN; very long texts are taken whole, in slices by bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        import numpy as np

        known, table = shared.value, _letters()
        names = known.names
        pred, score, sets = [], [], []
        for a, b in slices(texts):
            strings = texts.slice(a, b - a).to_pylist()
            bins, sizes = trigrams([t.encode() if t else b"" for t in strings], table)
            parts = np.split(bins, np.cumsum(sizes)[:-1]) if strings else []
            told = [bool(size and names and any(map(str.isalpha, text))) for text, size in zip(strings, sizes.tolist(), strict=True)]
            found = iter(infer([p for p, yes in zip(parts, told, strict=True) if yes], known))
            for yes in told:
                if not yes:
                    pred.append(UNKNOWN), score.append(0.0), sets.append("")
                    continue
                chosen, pi = next(found)
                by = sorted(range(len(chosen)), key=lambda j: (-pi[j], chosen[j]))  # noqa: B023
                pred.append(names[chosen[by[0]]]), score.append(min(1.0, float(pi[by[0]])))
                sets.append(",".join(f"{names[chosen[j]]}:{pi[j]:.3f}" for j in by if pi[j] > 0))
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], ["lang_pred", "score", "languages"])

    # Marked as not deterministic, it is computed once, wherever its fields are used.
    return F.arrow_udf(predict, PREDICTION).asNondeterministic()("text")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` plus ``lang_pred``, ``score`` (proportion of that language)
    and ``languages`` (the selected set with its proportions).

    Only the text decides. A text that is null or has no letter gives ``und`` with score 0, as does
    every text without a learned language. Of languages that are equally likely the first by name
    counts. Whole texts count, however long; a very long one is taken through the arrays alone.
    Repeated rows come out alike; an empty table gives an empty result; columns named like the new
    ones are replaced.
    """
    docs = docs.drop("lang_pred", "score", "languages")
    (found,) = fresh(docs, "found")
    return docs.withColumn(found, prediction(docs, model)).select(*[docs[f"`{c}`"] for c in docs.columns], f"{found}.*")


def keep_languages(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of ``docs`` whose language has at least ``least`` of the text, with that language in ``lang``; other columns stay as they are.

    Null and empty texts and those without a letter go; repeated rows stay or go together; very long
    texts count whole; an empty table, or a model without languages, gives an empty result.
    """
    (found,) = fresh(docs, "found")
    kept = docs.withColumn(found, prediction(docs, model)).where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= least))
    return kept.select(*[F.col(f"{found}.lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from; those without a doc_id are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Model:
    return train(docs.where(~held_out(F.col("doc_id"))))


def op8_language_id(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
