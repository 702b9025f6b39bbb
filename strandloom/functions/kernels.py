"""Per-base work in numpy over the buffers of Arrow strings.

A task adds up what its reads give and passes on one row for each position, word
or cell, so what is shuffled doesn't depend on the number of bases.  Sequences
and qualities are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 84]] = range(4)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, and where each begins (and the last ends)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def positions(at: np.ndarray) -> np.ndarray:
    lengths = np.diff(at)
    return np.arange(at[-1]) - np.repeat(at[:-1], lengths)


def _added(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    if len(total) < len(more):
        total, more = more.astype(np.int64), total
    total[: len(more)] += more.astype(np.int64)
    return total


class Positions:
    """Counts, quality sums and letters by position, over many batches."""

    NAMES = ("pos", "n", "qsum", "a", "c", "g", "t", "n_n")

    def __init__(self):
        self.sums = [np.zeros(0, np.int64) for _ in range(7)]

    def add(self, bases: np.ndarray, at: np.ndarray, quals: np.ndarray, q_at: np.ndarray) -> None:
        pos, q_pos = positions(at), positions(q_at)
        size = int(pos.max()) + 1 if len(pos) else 0
        # A quality beyond the end of its sequence belongs to no base.
        q_keep = q_pos < np.repeat(np.diff(at), np.diff(q_at))
        new = [np.bincount(pos, minlength=size), np.bincount(q_pos[q_keep], quals[q_keep], minlength=size)]
        new += [np.bincount(pos[bases == ord(b)], minlength=size) for b in "ACGTN"]
        self.sums = [_added(s, x) for s, x in zip(self.sums, new)]

    def columns(self) -> list[np.ndarray]:
        n = len(self.sums[0])
        return [np.arange(n, dtype=np.int32), *[np.pad(s, (0, n - len(s))) for s in self.sums]]


def by_position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos, n, qsum, and counts of A, C, G, T, N at each position."""
    sums = Positions()
    for batch in batches:
        sums.add(*flat(batch.column("sequence")), *flat(batch.column("quality")))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in sums.columns()], list(Positions.NAMES))


def _words(bases: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each k-word of A, C, G, T within a read, and its code."""
    n = len(bases) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = _CODE[bases].astype(np.int64)
    bad = np.concatenate(([0], np.cumsum(codes == 4)))
    ends = np.repeat(at[1:], np.diff(at))[:n]
    first = np.flatnonzero((bad[k : n + k] == bad[:n]) & (np.arange(n) + k <= ends))
    code = np.zeros(len(first), np.int64)
    for i in range(k):
        code = code * 4 + codes[first + i]
    return first, code


def word_of(code: int, k: int) -> str:
    return "".join("ACGT"[code >> 2 * (k - 1 - i) & 3] for i in range(k))


class Words:
    """Counts of k-words, in all or by position, over many batches."""

    def __init__(self, k: int, by_pos: bool):
        self.k, self.by_pos = k, by_pos
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, bases: np.ndarray, at: np.ndarray) -> None:
        first, code = _words(bases, at, self.k)
        found, n = np.unique(code + (positions(at)[first] << 2 * self.k if self.by_pos else 0), return_counts=True)
        self.keys, back = np.unique(np.concatenate((self.keys, found)), return_inverse=True)
        self.sums = np.bincount(back, np.concatenate((self.sums, n)), minlength=len(self.keys)).astype(np.int64)


def kmers(k: int, by_pos: bool) -> Callable:
    """word, pos (or -1) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(k, by_pos)
        for batch in batches:
            words.add(*flat(batch.column("sequence")))
        names = [word_of(int(c), k) for c in words.keys & (1 << 2 * k) - 1]
        pos = (words.keys >> 2 * k).astype(np.int32) if by_pos else np.full(len(words.keys), -1, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pos), pa.array(words.sums)], ["kmer", "pos", "n"])

    return run


#: What one pass gives: ``key`` is a bucket, a position, or a position and a word.
REPORT = "kind string, key bigint, n bigint, qsum bigint, a bigint, c bigint, g bigint, t bigint, n_n bigint, mean double"


def _per_read(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(raw, dtype=np.int64)))
    return sums[at[1:]] - sums[at[:-1]]


def report(k: int | None) -> Callable:
    """All sums of a statistics report in one pass.  Kinds: ``read`` (n reads with a
    quality, qsum reads in all, mean the sum of their mean qualities), ``length``,
    ``quality`` (raw), ``gc``, ``pos`` and, with ``k``, ``kmer``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_pos, words = Positions(), Words(k or 1, True)
        reads = measured = 0
        means = 0.0
        counts: dict[str, dict[int, int]] = {"length": {}, "quality": {}, "gc": {}}
        for batch in batches:
            sequence, quality = batch.column("sequence"), batch.column("quality")
            (bases, at), (quals, q_at) = flat(sequence), flat(quality)
            by_pos.add(bases, at, quals, q_at)
            if k:
                words.add(bases, at)
            here = sequence.is_valid().to_numpy(zero_copy_only=False)
            both = here & quality.is_valid().to_numpy(zero_copy_only=False) & (np.diff(at) > 0)
            length, qsum = np.diff(at), _per_read(quals, q_at)
            gc = _per_read((bases == ord("G")) | (bases == ord("C")), at)
            full = here & (length > 0)
            reads += batch.num_rows
            measured += int(both.sum())
            means += float((qsum[both] / length[both]).sum())
            for kind, values in (("length", length[here]), ("quality", (2 * qsum + length)[both] // (2 * length[both])), ("gc", 100 * gc[full] // length[full])):
                for value, n in zip(*(x.tolist() for x in np.unique(values, return_counts=True))):
                    counts[kind][value] = counts[kind].get(value, 0) + n
        cols = [c.astype(np.int64) for c in by_pos.columns()]
        yield _report("pos", cols[0], cols[1:])
        for kind, found in counts.items():
            yield _report(kind, list(found), [list(found.values())])
        yield _report("read", [0], [[measured], [reads]], [means])
        if k:
            yield _report("kmer", words.keys, [words.sums])

    return run


def _report(kind: str, keys, sums: list, mean: list[float] | None = None) -> pa.RecordBatch:
    cols = [pa.array([kind] * len(keys), pa.string()), pa.array(keys, pa.int64())]
    cols += [pa.array(sums[i], pa.int64()) if i < len(sums) else pa.nulls(len(keys), pa.int64()) for i in range(7)]
    cols.append(pa.array(mean, pa.float64()) if mean else pa.nulls(len(keys), pa.float64()))
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in REPORT.split(", ")])


def signature(k: int, base: int) -> Callable:
    """x, y, n and qsum of the cells of a genomic signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, q = np.zeros(4**k, np.int64), np.zeros(4**k, np.int64)
        for batch in batches:
            bases, at = flat(batch.column("sequence"))
            quals, q_at = flat(batch.column("quality"))
            first, code = _words(bases, at, k)
            if not np.array_equal(at, q_at):
                raise ValueError("sequence and quality differ in length")
            sums = np.concatenate(([0], np.cumsum(quals, dtype=np.int64)))
            n += np.bincount(code, minlength=4**k)
            q += np.bincount(code, sums[first + k] - sums[first] - k * base, minlength=4**k).astype(np.int64)
        codes = np.flatnonzero(n)
        x = y = np.zeros(len(codes), np.int64)
        for i in range(k):
            letter = codes >> 2 * (k - 1 - i) & 3
            x = x + (np.isin(letter, (0, 3)).astype(np.int64) << i)
            y = y + ((letter >= 2).astype(np.int64) << i)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(n[codes]), pa.array(q[codes])], ["x", "y", "n", "qsum"])

    return run
