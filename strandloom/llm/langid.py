"""Language identification: multinomial naive Bayes over hashed character n-grams.

A model is a matrix of log-probabilities, one row per hash bucket and one column
per language.  It is broadcast; a batch of texts is scored as a sparse matrix
(the n-gram positions of all its texts, row by row) times that matrix, in numpy.
Log-probabilities are fixed-point integers, so a sum doesn't depend on the order
or on the batches in which its terms are added.

Defined results: a null or empty text, or one without a letter, is ``und`` with
score 0; so is every text if no row has a language to learn from.  Rows with a
null language or a null id are never learned from.  A very long text is scored
whole, some characters at a time, whose number follows the number of languages.
Of languages with equal scores (ties) the first by name counts.  Copies of a text
and repeated rows get the same result and a row each; an empty table gives no
rows.  Columns besides id, text and language are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm._shared import give_back, short_batches

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SCALE = 1 << 16
#: Characters whose n-grams are looked at together, and numbers that they are
#: scored with (8 bytes each).
PIECE, GATHERED = 200_000, 4_000_000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_PAD = "\n" * (max(ORDERS) - 1)


def _buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram of the given order that begins at each position."""
    n = len(points) - order + 1
    h = np.full(n, order, np.uint32)
    for i in range(order):
        h ^= points[i : i + n]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h >> np.uint32(16)


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of about PIECE characters: index of the text of each piece, code
    points of all pieces, and where each piece begins and ends in them.  A long
    text is cut; each piece also has the characters that its last n-grams need."""
    owner, held, size = [], [], 0

    def group():
        joined = "".join(p + _PAD[: len(_PAD) - look] for p, _, look in held)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p) + len(_PAD) - look for p, _, look in held])
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return list(owner), points, begin, begin + np.array([n for _, n, _ in held])

    for i, text in enumerate(texts):
        low = text.lower() if text else ""
        for a in range(0, len(low), PIECE):
            n = min(PIECE, len(low) - a)
            piece = low[a : a + n + len(_PAD)]
            owner.append(i)
            held.append((piece, n, len(piece) - n))
            size += n
            if size >= PIECE:
                yield group()
                owner, held, size = [], [], 0
    if held:
        yield group()


@dataclass(frozen=True)
class LanguageModel:
    """``log_prob`` [bucket, language] and ``prior`` [language], times SCALE."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    prior: np.ndarray

    @staticmethod
    def from_counts(languages: list[str], documents: list[int], counts: np.ndarray, alpha: float = 0.1) -> LanguageModel:
        smooth = counts.T + alpha
        log_prob = np.log(smooth / smooth.sum(axis=0, keepdims=True)) if languages else smooth
        prior = np.log(np.array(documents, float) / max(1, sum(documents))) if languages else np.zeros(0)
        return LanguageModel(tuple(languages), np.rint(log_prob * SCALE).astype(np.int32), np.rint(prior * SCALE).astype(np.int64))

    def _add(self, total: np.ndarray, owner: np.ndarray, buckets: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Add the rows of ``buckets`` from begin to end to the totals of their
        owners, as many at a time as GATHERED numbers hold."""
        most = max(1, GATHERED // len(self.languages))
        for a in range(0, len(buckets), most):
            b = min(len(buckets), a + most)
            first = np.clip(begin, a, b) - a
            last = np.clip(end, a, b) - a
            here = np.flatnonzero(last > first)
            if len(here):
                edges = np.stack((first[here], last[here]), 1).ravel()
                # What follows the last piece, if anything, is padding and counts for none.
                edges = edges[:-1] if edges[-1] == b - a else edges
                sums = np.add.reduceat(self.log_prob[buckets[a:b]], edges, axis=0, dtype=np.int64)[::2]
                np.add.at(total, owner[here], sums)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n)
        total = np.tile(self.prior, (n, 1))
        for owner, points, begin, end in _pieces(texts):
            for order in ORDERS:
                self._add(total, np.array(owner), _buckets(points, order), begin, end)
        share = np.exp((total - total.max(axis=1, keepdims=True)) / SCALE)
        best = total.argmax(axis=1)
        score = share[np.arange(n), best] / share.sum(axis=1)
        known = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool) if n else np.zeros(0, bool)
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, score, 0.0)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is left out of the training; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def fit(docs: DataFrame, rows_per_language: int = 20_000, max_languages: int = 256) -> LanguageModel:
    """Learn from the ``text`` and ``lang`` of documents that aren't held out.

    ``rows_per_language`` bounds the sample: of a language with more rows, rows
    are taken by a hash of their ids with such a probability that this many are
    expected.  ``max_languages`` bounds the matrix; more is an error.
    """
    short_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect())
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = [x for x, _ in found]
    index = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS), np.int64)
    if languages:
        chance = F.lit(0.0)
        for language, n in found:
            chance = F.when(F.col("lang") == language, min(1.0, rows_per_language / n)).otherwise(chance)
        taken = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < chance * (1 << 20))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros((len(index), BUCKETS), np.int64)
            for batch in batches:
                langs = [index[x] for x in batch.column("lang").to_pylist()]
                for owner, points, begin, end in _pieces(batch.column("text").to_pylist()):
                    lang_at = np.full(len(points), -1)
                    for i, a, b in zip(owner, begin, end):
                        lang_at[a:b] = langs[i]
                    for order in ORDERS:
                        found = _buckets(points, order)
                        at = lang_at[: len(found)]
                        np.add.at(own, (at[at >= 0], found[at >= 0]), 1)
            where = own.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(where[0], pa.int32()), pa.array(where[1], pa.int32()), pa.array(own[where])], ["lang", "bucket", "n"])
            del own, where
            give_back()

        sums = taken.select("text", "lang").mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[sums["lang"], sums["bucket"]] = sums["n"]
    return LanguageModel.from_counts(languages, [n for _, n in found], counts)


def predictor(spark, model: LanguageModel):
    """Column function: text -> struct(lang_pred, score)."""
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            languages, scores = shared.value.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": languages, "score": scores})
        give_back()

    return predict


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = model or fit(docs)
    predict = predictor(docs.sparkSession, model)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents whose language can be told, with their columns as they are."""
    predict = predictor(docs.sparkSession, fit(docs))
    p = "_strandloom_p"
    return docs.withColumn(p, predict("text")).where((F.col(f"{p}.lang_pred") != UNDETERMINED) & (F.col(f"{p}.score") >= min_score)).select(*docs.columns)
