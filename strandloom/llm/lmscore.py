"""Language-model scoring by masked pseudo-likelihood.

A small network sees the ``REACH`` words on either side of a position, never the
word at it, and gives a distribution over words there: embeddings of the
neighbours, side by side, then a tanh layer, then a softmax in two levels (class
of the id, id in its class).  The score of a document is the sum over all its
words of the log-probability given both sides.

Words are hash buckets, of which there are so many that most words have one of
their own; their counts over the whole corpus are summed in Spark.  The most
frequent are ids of their own.  The others share ids, bands of frequency of about
equal mass, and a word's probability is that of its id times the word's own share
of the id's occurrences, so every word has its own.  The number of ids grows with
the number of words.

Training is distributed, and what it gives doesn't depend on how the table is
partitioned.  Documents are dealt by their content into shards of about
``SHARD_WORDS`` words.  In each round every shard starts from the same weights and
trains in numpy on masked positions of all its texts, other ones in each round, so
that the rounds reach every position once; the weights, times the positions they
were trained on, are added up in two levels, in the order of shards.  So what is
gathered grows with the corpus, while the model that is broadcast is bounded.

Defined results: a null or empty text has no words, log-likelihood 0 and a null
mean; a very long text is scored whole; copies of a text (ties, repeated rows) get
the same score up to rounding and a row each, null ids as well; a table without
words is scored with weights that were never trained, an empty table gives no rows;
columns besides doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from strandloom.llm._shared import materialize, short_batches, word_hashes

REACH, DIM, HIDDEN, CLASSES = 2, 16, 32, 32
#: Ids in a class: with fewer distinct words than MANY, and otherwise.
PER_CLASS, MANY = (32, 64), 1 << 17
BUCKET_BITS = 20
ROUNDS, RATE = 2, 0.1
#: Positions in the first step of training and in the last; they grow step by step.
FIRST_BATCH, BATCH, BATCH_GROWTH = 64, 2048, 8
#: Words of a shard, about, and words of it that are looked at together.
SHARD_WORDS, CHUNK = 1_000_000, 1 << 17
#: Words scored together.
SCORED = 1 << 15
#: Weights in a row of those that are added up, and groups on the first level.
SLICE, FAN = 4096, 64

@dataclass(frozen=True)
class Vocabulary:
    """Id and log of the own share of each bucket; the words of the corpus."""

    per_class: int
    ids: np.ndarray
    log_share: np.ndarray
    words: int

    @property
    def size(self) -> int:
        return CLASSES * self.per_class

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        """From the count of each bucket.  Three quarters of the ids are the most
        frequent buckets (ties by number), the others are shared."""
        per_class = PER_CLASS[int(np.count_nonzero(counts) >= MANY)]
        size = CLASSES * per_class
        own = size - size // 4
        order = np.argsort(-counts, kind="stable")
        order = order[: np.count_nonzero(counts)]
        ids = np.full(len(counts), size - 1, np.uint16)
        ids[order[:own]] = np.arange(min(own, len(order)))
        rest = order[own:]
        mass = np.cumsum(counts[rest])
        if len(rest):
            ids[rest] = own + ((mass - counts[rest]) * (size - own) // mass[-1]).astype(np.uint16)
        whole = np.bincount(ids, counts, minlength=size)
        # A bucket that the corpus lacks counts as if it occurred once.
        share = np.maximum(counts, 1) / np.maximum(whole[ids] + (counts == 0), 1)
        return cls(per_class, ids, np.log(share).astype(np.float32), int(counts.sum()))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Network:
    def __init__(self, per_class: int, flat: np.ndarray):
        self.per_class, self.flat, at = per_class, flat.astype(np.float32), 0
        self._memory: dict[str, np.ndarray] = {}
        for name, shape in self.shapes(per_class).items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def shapes(per_class: int) -> dict[str, tuple[int, ...]]:
        # The last embedding is that of what lies beyond a text.
        return {
            "embed": (CLASSES * per_class + 1, DIM),
            "w": (2 * REACH * DIM, HIDDEN),
            "b": (HIDDEN,),
            "cw": (HIDDEN, CLASSES),
            "cb": (CLASSES,),
            "ww": (CLASSES, HIDDEN, per_class),
            "wb": (CLASSES, per_class),
        }

    @classmethod
    def size(cls, per_class: int) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes(per_class).values())

    @classmethod
    def fresh(cls, per_class: int, seed: int = 5) -> Network:
        made = cls(per_class, np.random.default_rng(seed).normal(0, 0.1, cls.size(per_class)))
        for x in (made.b, made.cb, made.wb):
            x[:] = 0
        return made

    @classmethod
    def unseen(cls, per_class: int) -> Network:
        """Sums of squared gradients before the first."""
        return cls(per_class, np.full(cls.size(per_class), 1e-3))

    def _held(self, name: str, n: int, width: int) -> np.ndarray:
        """Memory that steps use again: fresh pages would cost as much as the sums."""
        if len(self._memory.get(name, ())) < n:
            self._memory[name] = np.empty((n, width), np.float32)
        return self._memory[name][:n]

    def _bounded(self) -> bool:
        """Whether no sum of a softmax can be so large that exp must be shifted."""
        most = max((np.abs(self.cw).sum(0) + np.abs(self.cb)).max(), (np.abs(self.ww).sum(1) + np.abs(self.wb)).max())
        return bool(most < 30)

    def _front(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(ctx)
        x = np.take(self.embed, ctx.ravel(), axis=0, out=self._held("x", n * 2 * REACH, DIM), mode="clip").reshape(n, -1)
        h = np.matmul(x, self.w, out=self._held("h", n, HIDDEN))
        h += self.b
        return x, np.tanh(h, out=h)

    def _sorted(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Order of the rows by class, the hidden rows in that order, class and
        number within it, and where each class begins."""
        order = np.argsort(ids, kind="stable")
        cls, within = np.divmod(ids[order].astype(np.int64), self.per_class)
        h = np.take(h, order, axis=0, out=self._held("sorted", len(ids), HIDDEN), mode="clip")
        return order, h, cls, within, np.searchsorted(cls, np.arange(CLASSES + 1))

    def _exps(self, h: np.ndarray, cls: np.ndarray, within: np.ndarray, cut: np.ndarray, bounded: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For classes, then for ids within them: exponentials, the targets, and what
        the targets' own sums are above the shift."""
        z = np.matmul(h, self.cw, out=self._held("class", len(h), CLASSES))
        z += self.cb
        own = np.take(self.wb, cls, axis=0, out=self._held("id", len(h), self.per_class), mode="clip")
        more = self._held("more", len(h), self.per_class)
        for c in np.flatnonzero(np.diff(cut)):
            np.matmul(h[cut[c] : cut[c + 1]], self.ww[c], out=more[cut[c] : cut[c + 1]])
        own += more
        rows = np.arange(len(h))
        for z, target in ((z, cls), (own, within)):
            if not bounded:
                z -= z.max(axis=1, keepdims=True)
            at = z[rows, target]
            yield np.exp(z, out=z), target, at

    def log_prob(self, ctx: np.ndarray, ids: np.ndarray, bounded: bool = False) -> np.ndarray:
        """Of ids given the ids around them."""
        _, h = self._front(ctx)
        order, h, cls, within, cut = self._sorted(h, ids)
        found = np.zeros(len(ids))
        for z, _, at in self._exps(h, cls, within, cut, bounded):
            found += at - np.log(z.sum(axis=1))
        out = np.empty(len(ids))
        out[order] = found
        return out

    def train(self, ctx: np.ndarray, ids: np.ndarray, seen: Network, rate: float = RATE, bounded: bool = False) -> None:
        """One step of Adagrad; ``seen`` has the sums of squared gradients."""
        n = len(ids)
        x, hidden = self._front(ctx)
        order, h, cls, within, cut = self._sorted(hidden, ids)
        rows, wrong = np.arange(n), []
        for z, target, _ in self._exps(h, cls, within, cut, bounded):
            z *= 1 / (n * z.sum(axis=1, keepdims=True))
            z[rows, target] -= np.float32(1 / n)
            wrong.append(z)
        of_class, of_id = wrong
        some = np.flatnonzero(np.diff(cut))
        dw, db = np.zeros_like(self.ww), np.zeros_like(self.wb)
        db[some] = np.add.reduceat(of_id, cut[some], axis=0)
        dh, more = np.matmul(of_class, self.cw.T, out=self._held("dh", n, HIDDEN)), self._held("dh2", n, HIDDEN)
        for c in some:
            own = slice(cut[c], cut[c + 1])
            np.matmul(h[own].T, of_id[own], out=dw[c])
            np.matmul(of_id[own], self.ww[c].T, out=more[own])
        dh += more
        steps = [("cw", h.T @ of_class), ("cb", of_class.sum(axis=0)), ("ww", dw), ("wb", db)]
        h *= h
        np.subtract(1, h, out=h)
        dh *= h
        back = more  # in the order of the positions again
        back[order] = dh
        steps += [("w", x.T @ back), ("b", back.sum(axis=0))]
        # Only embeddings that the step has seen change.
        flat = ctx.ravel()
        by = np.argsort(flat, kind="stable")
        sorted_ = flat[by]
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        met = sorted_[first]
        dx = np.matmul(back, self.w.T, out=self._held("dx", n, 2 * REACH * DIM)).reshape(-1, DIM)
        g = np.add.reduceat(np.take(dx, by, axis=0, out=self._held("dx2", len(by), DIM), mode="clip"), first, axis=0)
        past = seen.embed[met] + g * g
        seen.embed[met] = past
        self.embed[met] -= rate * g / (np.sqrt(past) + 1e-6)
        for name, g in steps:
            weight, past = getattr(self, name), getattr(seen, name)
            past += g * g
            weight -= rate * g / (np.sqrt(past) + 1e-6)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Every word of every text counts; a row for each bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, groups in word_hashes(batch.column("text").to_pylist()):
                for h in groups:
                    np.add.at(own, _bucket(h), 1)
        at = np.flatnonzero(own)
        for i in range(0, len(at), 1 << 17):
            some = at[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(own[some])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return Vocabulary.of(counts)


def encoded(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """doc_id, shard, n_tokens, share (sum of the words' log shares) and ids (16 bits
    each) of every document, written to the shared folder."""
    spark = docs.sparkSession
    shards = max(1, voc.words // SHARD_WORDS)
    shared = spark.sparkContext.broadcast(voc)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, log_share = shared.value.ids, shared.value.log_share
        for batch in batches:
            names, n = batch.column("doc_id").to_pylist(), batch.num_rows
            shard, size, share, data = [0] * n, [0] * n, [0.0] * n, [b""] * n
            for which, groups in word_hashes(batch.column("text").to_pylist()):
                for i, h in zip(which, groups):
                    at = _bucket(h)
                    size[i], share[i], data[i] = len(at), float(log_share[at].sum(dtype=np.float64)), ids[at].astype("<u2").tobytes()
                    shard[i] = zlib.crc32(data[i], zlib.crc32(str(names[i]).encode())) % shards
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shard, pa.int32()), pa.array(size, pa.int64()), pa.array(share, pa.float64()), pa.array(data, pa.binary())], ["doc_id", "shard", "n_tokens", "share", "ids"])

    kinds = [("shard", IntegerType()), ("n_tokens", LongType()), ("share", DoubleType()), ("ids", BinaryType())]
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *[StructField(*x) for x in kinds]])
    return materialize(docs.select("doc_id", "text").mapInArrow(encode, schema), "word-ids")


def _stream(texts: list[np.ndarray], beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with ``REACH`` marks around each, and the positions
    of their words."""
    mark = np.full(REACH, beyond, np.uint16)
    stream = np.concatenate([mark, *[x for t in texts for x in (t, mark)]])
    return stream, np.flatnonzero(stream != beyond)


def _contexts(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([stream[at + d] for d in (*range(-REACH, 0), *range(1, REACH + 1))], axis=1)


class Learner:
    """Trains on the texts of one shard, in their order: of all words one in
    ``rounds``, those with the number ``turn`` among as many."""

    def __init__(self, start: Network, turn: int, rounds: int):
        self.net, self.seen = Network(start.per_class, start.flat.copy()), Network.unseen(start.per_class)
        self.turn, self.rounds, self.batch = turn, rounds, FIRST_BATCH
        self.texts, self.held, self.words, self.trained, self.steps = [], 0, 0, 0, 0

    def add(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), CHUNK):  # a longer text counts as several
            part = ids[i : i + CHUNK]
            self.texts.append(part)
            self.held += len(part)
            if self.held >= CHUNK:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        stream, at = _stream(self.texts, CLASSES * self.net.per_class)
        skip = (self.turn - self.words) % self.rounds
        self.words += len(at)
        at = at[skip :: self.rounds]
        i = 0
        while i < len(at):
            some = at[i : i + self.batch]
            if self.steps % 16 == 0:
                # A step moves a weight by RATE at most, so 16 move a sum by 53.
                self.bounded = self.net._bounded()
            self.steps += 1
            self.net.train(_contexts(stream, some), stream[some], self.seen, bounded=self.bounded)
            self.batch = min(BATCH, self.batch + BATCH_GROWTH)
            i += len(some)
        self.trained += len(at)
        self.texts, self.held = [], 0


_SUMS = "slice int, fan int, n bigint, data binary"


def _summed(batches: Iterator[pa.RecordBatch], fans: int) -> Iterator[pa.RecordBatch]:
    """One sum for each slice and fan, of rows in that order; a fan then counts as
    itself modulo ``fans``."""
    held: list | None = None

    def out() -> pa.RecordBatch:
        cols = zip([held[0]], [held[1] % fans], [held[2]], [held[3].tobytes()])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cols), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["slice", "fan", "n", "data"])

    for batch in batches:
        for s, f, n, data in zip(*(batch.column(c).to_pylist() for c in ("slice", "fan", "n", "data"))):
            more = np.frombuffer(data, "<f8")
            if held and (held[0], held[1]) == (s, f):
                held[2:] = [held[2] + n, held[3] + more]
            else:
                if held:
                    yield out()
                held = [s, f, n, more]
    if held:
        yield out()


def train(rows: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Weights trained on the ``encoded`` documents."""
    spark = rows.sparkSession
    net = Network.fresh(voc.per_class)
    shards = max(1, voc.words // SHARD_WORDS)
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(net.flat)

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, start=start, per_class=voc.per_class) -> Iterator[pa.RecordBatch]:
            at, own = None, None

            def told() -> pa.RecordBatch:
                own.flush()
                flat = own.net.flat.astype(np.float64) * own.trained
                data = [flat[i : i + SLICE].astype("<f8").tobytes() for i in range(0, len(flat), SLICE)]
                same = lambda x, t: pa.array([x] * len(data), t)
                return pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), same(at, pa.int32()), same(own.trained, pa.int64()), pa.array(data, pa.binary())], ["slice", "fan", "n", "data"])

            for batch in batches:
                for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
                    if shard != at:
                        if own:
                            yield told()
                        at, own = shard, Learner(Network(per_class, start.value), turn, rounds)
                    own.add(np.frombuffer(ids, "<u2"))
            if own:
                yield told()

        dealt = rows.where("n_tokens > 0").select("shard", "ids", "doc_id").repartitionByRange(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
        parts = dealt.select("shard", "ids").mapInArrow(learn, _SUMS)
        # Of each slice, the shards' sums by groups of shards, then the groups' sum.
        group = F.col("fan") % FAN
        parts = parts.withColumn("grp", group).repartition("slice", "grp").sortWithinPartitions("slice", "grp", "fan").select("slice", F.col("grp").alias("fan"), "n", "data").mapInArrow(lambda x: _summed(x, FAN), _SUMS)
        parts = parts.repartition("slice").sortWithinPartitions("slice", "fan").withColumn("fan", F.lit(0)).select("slice", "fan", "n", "data").mapInArrow(lambda x: _summed(x, 1), _SUMS)
        found = sorted((r["slice"], r["n"], bytes(r["data"])) for r in parts.collect())
        if not found:
            break
        net = Network(voc.per_class, np.concatenate([np.frombuffer(d, "<f8") / max(1, n) for _, n, d in found]))
    return net


def score(docs: DataFrame, voc: Vocabulary | None = None, net: Network | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_prob and pseudo_perplexity."""
    spark = docs.sparkSession
    short_batches(spark)
    voc = voc or vocabulary(docs)
    rows = encoded(docs, voc)
    net = net or train(rows, voc)
    shared = spark.sparkContext.broadcast((voc.per_class, net.flat))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(*shared.value)
        bounded = model._bounded()
        beyond = CLASSES * model.per_class
        for batch in batches:
            texts = [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]
            total = np.array(batch.column("share").to_pylist())
            i = 0
            while i < len(texts):
                j, held = i, 0
                while j < len(texts) and (j == i or held + len(texts[j]) <= SCORED):
                    held += len(texts[j])
                    j += 1
                stream, at = _stream(texts[i:j], beyond)
                found = np.empty(len(at))
                for a in range(0, len(at), SCORED):
                    some = at[a : a + SCORED]
                    found[a : a + SCORED] = model.log_prob(_contexts(stream, some), stream[some], bounded)
                total[i:j] += np.bincount(np.repeat(np.arange(j - i), [len(t) for t in texts[i:j]]), found, minlength=j - i)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(total)], ["doc_id", "n_tokens", "log_likelihood"])

    schema = StructType([rows.schema["doc_id"], StructField("n_tokens", LongType()), StructField("log_likelihood", DoubleType())])
    scored = rows.select("doc_id", "n_tokens", "share", "ids").mapInArrow(likelihood, schema)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1)))
    return scored.withColumn("mean_log_prob", mean).withColumn("pseudo_perplexity", F.exp(-F.col("mean_log_prob")))
