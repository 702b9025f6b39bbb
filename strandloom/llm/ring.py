"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is a circle of ``CELLS`` equal cells.  A document lies in the cell of
the hash of its id; each shard owns ``VNODES`` points of the circle.  A document
goes to the shard of the first point at or after its cell; if that shard is full
it continues clockwise to the next shard that has room.  Shards fill in the
order of cells and, within a cell, of the rows' hashes, so the same documents
always give the same shards.

Only the number of documents in each cell (at most CELLS numbers) comes to the
driver, which lets whole cells flow round the ring; a cell is split where a
shard becomes full.  The resulting spans, at most CELLS plus one for each shard,
are joined to the rows by cell and rank.

With ``slack`` 0 shards differ by one row at most (law ``rows``).  With more
slack a shard takes up to (1 + slack) times its share and fewer rows leave the
shard of their own point.

Defined results: rows of one id share a cell and are told apart by size and
checksum (repeated rows and ties are interchangeable); rows without an id lie in
the cells of their checksums and sizes, so that they fill no cell however many
they are; a null or empty text has size 1 and checksum 0; a very long text counts
as one row; groups of equal texts aren't kept together; an empty table gives no
rows; columns besides doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._shared import materialize

CELLS = 1 << 14
VNODES = 128


def cell_of(key: Column, size: Column, crc: Column, cells: int = CELLS) -> Column:
    h = F.when(key.isNull(), F.xxhash64(crc, size)).otherwise(F.xxhash64(key))
    return F.pmod(h, F.lit(cells)).cast("int")


def points(shards: int, cells: int = CELLS, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise.  A shard's points don't
    depend on how many other shards there are."""
    made = []
    for s in range(shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big")
            made.append((h, s))
    return [(h * cells >> 64, s) for h, s in sorted(made)]


def flow(counts: dict[int, int], shards: int, slack: float = 0.0, cells: int = CELLS, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """Spans (cell, from rank, to rank, shard, slot of the first) that take in
    all rows of all cells."""
    total = sum(counts.values())
    if slack:
        room = [ceil((1 + slack) * total / shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    ring = points(shards, cells, vnodes)
    at, used, spans = [c for c, _ in ring], [0] * shards, []
    for cell in sorted(counts):
        done, n, i = 0, counts[cell], bisect_left(at, cell)
        while done < n:
            shard = ring[i % len(ring)][1]
            take = min(n - done, room[shard] - used[shard])
            if take > 0:
                spans.append((cell, done, done + take, shard, used[shard]))
                used[shard] += take
                done += take
            i += 1
    return spans


def shard(docs: DataFrame, shards: int = 16, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    spark = docs.sparkSession
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = materialize(rows.withColumn("cell", cell_of(F.col("doc_id"), F.col("size"), F.col("text_crc32"))), "cells")
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    spans = spark.createDataFrame(flow(counts, shards, slack), "span_cell int, lo long, hi long, shard int, base long")
    order = Window.partitionBy("cell").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    within = (F.col("cell") == F.col("span_cell")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(spans), within).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def sharded(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
