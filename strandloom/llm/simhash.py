"""SimHash near-duplicates with pigeonring filtering.

Fingerprints have 64 bits and are linked at ``DISTANCE`` (4) differing bits or
fewer.  They are cut into a ring of five segments.  By the pigeonring principle,
some segment begins a chain of consecutive segments whose cumulative differences
stay within proportional budgets: for lengths 1 to 5 at most 0, 1, 2, 3 and 4
bits.  So two linked fingerprints agree in one segment and differ in at most one
bit of the next.  Each fingerprint is listed under its own two segments from
each of five starts (its homes), and under those with one zero bit of the second
segment set (its probes).  Fingerprints that meet under a key, one of them at
home, are candidates; the longer chains prune them before the full check.

Copies are one fingerprint with its smallest doc_id, so a group of copies never
meets itself.  Candidates are compared in numpy over sorted keys, and of the
links found under a key only a spanning forest is passed on: what a task emits
grows with its rows, not with the square of a group.  A key with more than
``HOT`` rows is passed on to a second stage and compared there in pairs of
blocks over many tasks.  Groups of links become components by repeated
contraction to a neighbour, with a table written in each round.

``keep_one`` follows the rule for near-duplicates in general: sets of shingles of
five words with a similarity (Jaccard index) of 0.8 or more, as 128 bits tell it.
Similar sets of sizes a and b, of which one is a quarter larger at most, differ in
a share of arccos(2J / (1 + J)) / pi of the bits, 19.4 of 128 at J = 0.8.  So
fingerprints are linked that differ in ``WIDE_TOTAL`` (20) of 128 bits at most and
in half as many of the first 64, and whose numbers of shingles are in the same
band or in neighbouring ones, each a quarter wider than the one before.  The first
64 bits are a ring of four segments with budgets of 2, 5, 7 and 10 bits; two values
of a segment that differ in two bits meet where each has one of them turned.

Defined results: null and empty texts have fingerprint 0 and are linked like any
other; texts of fewer words than a shingle are one shingle; a very long text is
read whole, its shingles added up some at a time; a bit that is set in just half
of the shingles (a tie) is 0; repeated rows give a row each, and of rows with one
doc_id each keeps its own fingerprint and component; a null doc_id counts as
larger than any other; an empty table gives no rows; columns besides doc_id and
text are neither read nor returned, but by ``keep_one``, which returns all of them
as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandloom.llm._shared import give_back, labelled, materialize, short_batches, word_hashes

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Bits of the five segments of the ring.
RING = (13, 13, 13, 13, 12)
HOT = 4096
#: Ids of 8 bytes that ``keep_one`` broadcasts.
BROADCAST_IDS = 500_000
#: The rule of keep_one, rows of a key that one task compares, and rows of a key
#: from which on it looks for whole groups.
WIDE_SHINGLE, WIDE_DISTANCE, WIDE_TOTAL, WIDE_HOT, LONG_RUN = 5, 10, 20, 1 << 14, 256
_SEGMENTS, _SEGMENT_BITS = 4, 16
#: Pairs that are compared together.
AT_ONCE = 1 << 15
#: Shingles whose bits are added up together.
PIECE = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[i : i + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        found = np.array([fingerprint_of(t if isinstance(t, str) else None) for t in texts], np.uint64)
        yield pd.Series(found.view(np.int64))


def fingerprint(text: Column) -> Column:
    """SimHash of a text, its 64 bits as a signed integer."""
    return F.pandas_udf(_fingerprints, "bigint")(text)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _starts() -> list[int]:
    return [sum(RING[:i]) for i in range(len(RING))]


def _segment(fps: np.ndarray, i: int) -> np.ndarray:
    i %= len(RING)
    return fps >> np.uint64(_starts()[i]) & np.uint64((1 << RING[i]) - 1)


def _listings(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, is a probe) under all starts of the ring."""
    keys, owners, probes = [], [], []
    for i in range(len(RING)):
        here, after = _segment(fps, i), _segment(fps, i + 1)
        base = np.uint64(i) << np.uint64(32) | here << np.uint64(16)
        keys.append(base | after)
        owners.append(fps)
        probes.append(np.zeros(len(fps), bool))
        for b in range(RING[(i + 1) % len(RING)]):
            unset = (after >> np.uint64(b) & np.uint64(1)) == 0
            keys.append((base | after | np.uint64(1 << b))[unset])
            owners.append(fps[unset])
            probes.append(np.ones(int(unset.sum()), bool))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(probes)


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Whether two fingerprints that agree in their segments from ``start`` on
    pass the chain of budgets and differ in ``distance`` bits at most."""
    differ = a ^ b
    ok, sums = np.ones(len(a), bool), np.zeros(len(a), np.int64)
    segments = np.stack([np.bitwise_count(_segment(differ, i)) for i in range(len(RING))], axis=1).astype(np.int64)
    rows = np.arange(len(a))
    for length in range(1, len(RING) + 1):
        sums += segments[rows, (start + length - 1) % len(RING)]
        ok &= sums <= length * distance // len(RING)
    return ok & (sums <= distance)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) that connect what a-b connect."""
    if not len(a):
        return a, b
    nodes, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new[label], label):
            break
        label = new[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(keys: np.ndarray, fps: np.ndarray, probes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links among rows with equal keys, which are adjacent."""
    n = len(keys)
    change = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if n else np.zeros(1, int)
    end = np.repeat(change[1:], np.diff(change)) if n else np.zeros(0, int)
    left, right, by, rows = [], [], 1, np.arange(n)
    kept = 0
    while True:
        rows = rows[rows + by < end[rows]]
        if not len(rows):
            break
        r = rows[~(probes[rows] & probes[rows + by])]
        ok = _linked(fps[r], fps[r + by], start[r])
        if ok.any():
            left.append(fps[r][ok])
            right.append(fps[r + by][ok])
            kept += int(ok.sum())
            if kept > 1 << 20:
                x, y = _forest(np.concatenate(left), np.concatenate(right))
                left, right, kept = [x], [y], len(x)
        by += 1
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate(left), np.concatenate(right))


def _stream(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole keys of a partition sorted by key: ("runs", columns).  Of a
    key with more than ``hot`` rows, parts are given as they come, with the number
    of rows before: ("hot", columns, before)."""
    held, before = None, 0
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        cols = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if before:
            # The hot key goes on, up to ``first``.
            first = int(np.searchsorted(cols[0], cols[0][0], "right")) if cols[0][0] == key else 0
            yield "hot", [c[:first] for c in cols], before
            before = before + first if first == len(cols[0]) else 0
            cols = [c[first:] for c in cols]
            last -= first
            if not len(cols[0]):
                held = None
                continue
        if last:
            yield "runs", [c[:last] for c in cols], 0
        held = [c[last:] for c in cols]
        if len(held[0]) > hot:
            key = held[0][0]
            yield "hot", held, 0
            before, held = len(held[0]), None
    if held is not None and len(held[0]):
        yield "runs", held, 0


_LINK = "a bigint, b bigint, key bigint, probe boolean, rank bigint"


def _emit(a, b, key=None, probe=None, rank=None) -> pa.RecordBatch:
    n = len(a)
    cols = [pa.array(np.asarray(a).view(np.int64)), pa.array(np.asarray(b).view(np.int64)) if b is not None else pa.nulls(n, pa.int64())]
    cols.append(pa.array(key) if key is not None else pa.nulls(n, pa.int64()))
    cols.append(pa.array(probe) if probe is not None else pa.nulls(n, pa.bool_()))
    cols.append(pa.array(rank) if rank is not None else pa.nulls(n, pa.int64()))
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "key", "probe", "rank"])


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) of fingerprints: a forest that connects all linked fingerprints of
    the distinct ones in column ``fp``."""

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(whole), 10_000):
                key, fp, probe = _listings(whole[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(probe)], ["key", "fp", "probe"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, (key, fp, probe), before in _stream(batches, hot):
            if kind == "hot":
                yield _emit(fp, None, key, probe.astype(bool), np.arange(before, before + len(key)))
                continue
            # Runs longer than ``hot`` within one batch are hot as well.
            change = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            length = np.repeat(np.diff(change), np.diff(change))
            much = length > hot
            if much.any():
                rank = np.arange(len(key)) - np.repeat(change[:-1], np.diff(change))
                yield _emit(fp[much], None, key[much], probe[much].astype(bool), rank[much])
            key, fp, probe = key[~much], fp[~much], probe[~much]
            a, b = _compare(key, fp.view(np.uint64), probe.astype(bool), key >> 32)
            if len(a):
                yield _emit(a, b)

    listed = fps.select("fp").mapInArrow(list_keys, "key bigint, fp bigint, probe boolean")
    dealt = listed.repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(dealt.mapInArrow(compare, _LINK), "links")
    return found.where("b is not null").select("a", "b").unionByName(_hot_links(found.where("b is null"), hot))


def _hot_links(rows: DataFrame, hot: int) -> DataFrame:
    """Links under hot keys: all pairs of blocks of ``hot`` rows, one group each."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (group, key, fp, probe), _ in _stream(batches, 1 << 40):
            a, b = _compare(group, fp.view(np.uint64), probe.astype(bool), key >> 32)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    sizes = rows.groupBy("key").agg(((F.max("rank") / hot).cast("int")).alias("most"))
    own = rows.join(sizes, "key").withColumn("block", (F.col("rank") / hot).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("most"))))
    group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("grp")
    return paired.select(group, "key", F.col("a").alias("fp"), "probe").repartition("grp").sortWithinPartitions("grp", "fp").mapInArrow(compare, "a bigint, b bigint")


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of an edge (a, b) but the root itself, one
    node of its group, the same for the whole group.

    In each round a node moves to its first neighbour, if that comes before
    itself; edges follow, and those within one node go.  What comes first is
    drawn anew in each round (nodes are ordered by their bits, some of them
    flipped), so a round leaves a share of the nodes whatever their values, and
    a long path in ascending order takes no more rounds than another.  What a
    node's move leads to is found by going back through the rounds.  A node that
    others moved to while it moved itself is in the edges still and may move again,
    or become the root: all its rows then lead to one root, and one of them is kept.
    """
    moves = []
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        flips = int(np.random.default_rng(len(moves)).integers(0, 1 << 64, dtype=np.uint64).view(np.int64))
        place = lambda c: F.col(c).bitwiseXOR(F.lit(flips))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("first")).where(F.col("first") < place("node"))
        move = materialize(first.select("node", place("first").alias("root")), "moves")
        moves.append(move)
        at = lambda side: move.select(F.col("node").alias(f"n_{side}"), F.col("root").alias(f"r_{side}"))
        moved = edges.join(at("a"), F.col("a") == F.col("n_a"), "left").join(at("b"), F.col("b") == F.col("n_b"), "left")
        ends = moved.select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))
        ends = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialize(ends.where("a <> b").distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # In the last round no node moves to one that moves, so its roots are final.
    found = moves[-1]
    for move in reversed(moves[:-1]):
        later = found.select(F.col("node").alias("via"), F.col("root").alias("top"))
        here = move.join(later, F.col("root") == F.col("via"), "left").select("node", F.coalesce("top", "root").alias("root"))
        found = materialize(here.unionByName(found).where("node <> root").distinct(), "roots")
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that is reachable, for each node of an
    edge (a, b) that isn't itself the smallest."""
    found = _contracted(edges)
    names = found.groupBy("root").agg(F.min("node").alias("low")).select(F.col("root").alias("top"), F.least("low", "root").alias("low"))
    every = found.join(names, F.col("root") == F.col("top")).select("node", "low").unionByName(names.select(F.col("top").alias("node"), "low"))
    return every.where("node <> low").select("node", F.col("low").alias("root"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of x."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def wide_fingerprint_of(words: np.ndarray, shingle: int = WIDE_SHINGLE) -> tuple[int, int, int]:
    """Both halves of the fingerprint of a text's set of shingles, and their number.
    ``words`` are the hashes of its words; fewer than a shingle are one."""
    if not len(words):
        return 0, 0, 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    made = np.full(n, k, np.uint64)
    for j in range(k):
        made = _mixed(made) + words[j : j + n]
    made = np.unique(made)
    halves = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(made), PIECE // 8):
            bits = _mixed(made[i : i + PIECE // 8] + np.uint64(salt)).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        halves.append(int(((2 * ones > len(made)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()))
    return halves[0], halves[1], len(made)


def _node(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A name of 64 bits for 128."""
    return _mixed(_mixed(low) + high)


def band(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / np.log(1.25) + 1e-9).astype(np.int64)


def _wide_listings(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, low, high): each fingerprint under its four segments, and under those
    with one bit turned, in its own band and the next."""
    keys = []
    for i in range(_SEGMENTS):
        own = low >> np.uint64(_SEGMENT_BITS * i) & np.uint64((1 << _SEGMENT_BITS) - 1)
        for turned in (0, *(1 << b for b in range(_SEGMENT_BITS))):
            for step in (0, 1):
                place = (band(size) + step << 2 | i) << _SEGMENT_BITS
                keys.append(place | (own ^ np.uint64(turned)).astype(np.int64))
    return np.concatenate(keys), np.tile(low, len(keys)), np.tile(high, len(keys))


def _wide_linked(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether rows a and b, which are listed by their segments ``start``, are linked:
    the chain of segments from there on keeps to its budgets, then all bits to theirs."""
    ok = np.zeros(len(a), bool)
    left, differ, total = np.arange(len(a)), low[a] ^ low[b], np.zeros(len(a), np.int64)
    for length in range(1, _SEGMENTS + 1):
        at = ((start[left] + length - 1) % _SEGMENTS * _SEGMENT_BITS).astype(np.uint64)
        total = total + np.bitwise_count(differ >> at & np.uint64((1 << _SEGMENT_BITS) - 1))
        keep = total <= length * WIDE_DISTANCE // _SEGMENTS
        left, differ, total = left[keep], differ[keep], total[keep]
    ok[left] = total + np.bitwise_count(high[a[left]] ^ high[b[left]]) <= WIDE_TOTAL
    return ok


def _spread(begin: int, end: int, linked) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected among rows of one key: from row to row,
    each looks for those that aren't reached yet.  A dense group takes time in
    proportion to its rows."""
    u, v, rest = [], [], np.arange(begin, end)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            many = max(1, AT_ONCE // len(rest))
            some, front = front[:many], front[many:]
            a, b = np.repeat(some, len(rest)), np.tile(rest, len(some))
            met = linked(a, b).reshape(len(some), len(rest))
            hit = met.any(axis=0)
            if hit.any():
                u.append(some[met.argmax(axis=0)[hit]])
                v.append(rest[hit])
                front, rest = np.concatenate((front, rest[hit])), rest[~hit]
    return u, v


def _wide_compare(keys: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links among rows with equal keys, which are adjacent."""
    nodes = _node(low, high)
    change = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, int)
    length = np.diff(change)
    linked = lambda a, b: _wide_linked(low, high, a, b, start[a])
    left, right, kept = [], [], 0

    def take(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal left, right, kept
        left.append(nodes[a])
        right.append(nodes[b])
        kept += len(a)
        if kept > 1 << 20:
            x, y = _forest(np.concatenate(left), np.concatenate(right))
            left, right, kept = [x], [y], len(x)

    for i in np.flatnonzero(length > LONG_RUN):
        for a, b in zip(*_spread(change[i], change[i + 1], linked)):
            take(a, b)
    end = np.repeat(np.where(length > LONG_RUN, 0, change[1:]), length)
    rows, by = np.arange(len(keys)), 1
    while len(rows := rows[rows + by < end[rows]]):
        for i in range(0, len(rows), AT_ONCE):
            a = rows[i : i + AT_ONCE]
            a = a[linked(a, a + by)]
            if len(a):
                take(a, a + by)
        by += 1
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate(left), np.concatenate(right))


_WIDE_LINK = "a bigint, b bigint, key bigint, low bigint, high bigint, near bigint, rank bigint"


def _wide_emit(n: int, **given: np.ndarray) -> pa.RecordBatch:
    names = [x.split()[0] for x in _WIDE_LINK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(given[x].view(np.int64)) if x in given else pa.nulls(n, pa.int64()) for x in names], names)


class _Hot:
    """Rows of a hot key, as they come: links of those near its first row to that
    row, and all rows with what they are (``near`` or not) and their rank among such."""

    def __init__(self):
        self.key, self.counts = None, [0, 0]

    def told(self, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.key != key[0]:
            self.key, self.counts, self.first = key[0], [0, 0], (low[:1], high[:1])
        x, y = np.concatenate((self.first[0], low)).view(np.uint64), np.concatenate((self.first[1], high)).view(np.uint64)
        start = np.full(len(x), int(key[0]) >> _SEGMENT_BITS & 3)
        near = _wide_linked(x, y, np.zeros(len(low), np.int64), np.arange(1, len(x)), start)
        rank = np.empty(len(low), np.int64)
        for kind in (0, 1):
            rows = near == bool(kind)
            rank[rows] = self.counts[kind] + np.arange(rows.sum())
            self.counts[kind] += int(rows.sum())
        nodes = _node(x, y)
        if near.any():
            yield _wide_emit(int(near.sum()), a=nodes[1:][near], b=np.repeat(nodes[:1], near.sum()))
        yield _wide_emit(len(low), key=key, low=low, high=high, near=near.astype(np.int64), rank=rank)


def _wide_block_pairs(rows: DataFrame, hot: int) -> DataFrame:
    """Rows of hot keys in blocks of ``hot``, each dealt to a group (``grp``) for each
    pair of blocks that it is in.  Rows near the key's first row are connected, so
    their blocks are met with those of other rows alone: a dense group, however
    large, is dealt as often as there are blocks of rows beside it."""
    block = (F.col("rank") / hot).cast("int")
    last = lambda near: F.coalesce(F.max(F.when(F.col("near") == near, block)), F.lit(-1)).alias(f"last_{near}")
    own = rows.join(rows.groupBy("key").agg(last(0), last(1)), "key").where("last_0 >= 0").withColumn("block", block)
    upto = lambda near: F.when(F.col(f"last_{near}") >= 0, F.sequence(F.lit(0), F.col(f"last_{near}"))).otherwise(F.array().cast("array<int>"))
    pair = lambda kind, x, y: F.xxhash64("key", F.lit(kind), x, y)
    mine = F.col("block")
    far = F.concat(F.transform(upto(0), lambda o: pair(0, F.least(mine, o), F.greatest(mine, o))), F.transform(upto(1), lambda o: pair(1, mine, o)))
    near = F.transform(upto(0), lambda o: pair(1, o, mine))
    return own.withColumn("grp", F.explode(F.when(F.col("near") == 1, near).otherwise(far)))


def wide_links(fps: DataFrame, hot: int = WIDE_HOT) -> DataFrame:
    """(a, b): a forest that connects all linked fingerprints of the distinct ones in
    low, high and size, by their nodes."""

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i in range(0, len(low), 500):
                cut = slice(i, i + 500)
                key, x, y = _wide_listings(low[cut].view(np.uint64), high[cut].view(np.uint64), size[cut])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["key", "low", "high"])
        give_back()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _Hot()
        for kind, (key, low, high), _ in _stream(batches, hot):
            change = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            length = np.repeat(np.diff(change), np.diff(change))
            much = np.ones(len(key), bool) if kind == "hot" else length > hot
            for i, j in zip(change, change[1:]):
                if much[i]:
                    yield from told.told(key[i:j], low[i:j], high[i:j])
            key, low, high = key[~much], low[~much].view(np.uint64), high[~much].view(np.uint64)
            a, b = _wide_compare(key, low, high, key >> _SEGMENT_BITS & 3)
            if len(a):
                yield _wide_emit(len(a), a=a, b=b)
        give_back()

    def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (group, key, low, high), _ in _stream(batches, 1 << 40):
            a, b = _wide_compare(group, low.view(np.uint64), high.view(np.uint64), key >> _SEGMENT_BITS & 3)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    listed = fps.select("low", "high", "size").mapInArrow(list_keys, "key bigint, low bigint, high bigint")
    found = materialize(listed.repartition("key").sortWithinPartitions("key", "low", "high").mapInArrow(compare, _WIDE_LINK), "links")
    paired = _wide_block_pairs(found.where("b is null"), hot).select("grp", "key", "low", "high")
    more = paired.repartition("grp").sortWithinPartitions("grp", "low", "high").mapInArrow(compare_blocks, "a bigint, b bigint")
    return found.where("b is not null").select("a", "b").unionByName(more)


def _wide_rows(docs: DataFrame) -> DataFrame:
    """doc_id, fp (its node), low, high and size of every document."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = np.zeros((3, batch.num_rows), np.uint64)
            for which, groups in word_hashes(batch.column("text").to_pylist()):
                for i, words in zip(which, groups):
                    cols[:, i] = wide_fingerprint_of(words)
            parts = [_node(cols[0], cols[1]), *cols]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x.view(np.int64)) for x in parts]], ["doc_id", "fp", "low", "high", "size"])
        give_back()

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *[StructField(x, LongType()) for x in ("fp", "low", "high", "size")]])
    return materialize(docs.select("doc_id", "text").mapInArrow(made, schema), "fingerprints")


def _named(rows: DataFrame, least: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id of the fingerprints that
    ``roots`` connects.  ``least`` has rep and n, its own and its documents' number,
    of each fingerprint."""
    member = materialize(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("top")), "members")
    names = materialize(member.groupBy("top").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "names")
    of_fp = materialize(labelled(member, "top", names, "component_id").select("fp", "n", "component_id"), "components")
    return labelled(rows, "fp", of_fp, "component_id").select("doc_id", "fp", "component_id")


def wide_grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document, by the rule of ``keep_one``."""
    short_batches(docs.sparkSession)
    rows = _wide_rows(docs)
    least = materialize(rows.groupBy("fp", "low", "high").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("size").alias("size")), "distinct")
    return _named(rows.select("doc_id", "fp"), least.select("fp", "rep", "n"), _contracted(wide_links(least)))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    short_batches(docs.sparkSession)
    rows = materialize(docs.select("doc_id", fingerprint(F.coalesce("text", F.lit(""))).alias("fp")), "fingerprints")
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct")
    return _named(rows, least, _contracted(links(least)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One document of each component of near-duplicates (five words, similarity
    0.8), that with the smallest id, with its columns as they are.  Rows of one doc_id count as one document; rows without
    one can't be told apart and stay.  Up to ``broadcast_ids`` ids to drop are
    broadcast, so the texts aren't shuffled."""
    spare = materialize(wide_grouped(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_sl_id")).distinct(), "spare")
    few = spare.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(spare) if few else spare, docs["doc_id"] == F.col("_sl_id"), "left_anti")
