"""FASTQ as a Spark data source: splittable, with a streaming reader, and sinks.

A file is cut into byte ranges.  A range owns the records whose header begins in
it.  Where a range begins is found by frames of four lines: only a header has
``@`` in front and a line with ``+`` in front two lines below, since the line two
below a quality line is a sequence.  Compressed files and ``multiline`` ones are
read whole.

``splitBytes`` is the size of a range.  Each range is a task, which costs far more
than the reading of a small one, so beyond ``RANGES`` of them neighbours become one
range, up to a block: two ranges that meet own the same records as one over both.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandloom.functions.kernels import flat

SCHEMA = "read_id string, sequence string, quality string"
SUFFIXES = (".fq", ".fastq", ".fq.gz", ".fastq.gz")
#: Bytes that are parsed together.
BLOCK = 8 << 20
#: Ranges of ``splitBytes`` that are read singly; of more, neighbours are joined.
RANGES = 256
_OWN_NAME = re.compile(r"part-\d{5}-[0-9a-f]{32}\.fq")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else f"file:///{uri}") if not uri.startswith("file:/") or uri.startswith("file://") else fs.FileSystem.from_uri("file://" + uri[5:])


def list_files(uri: str) -> list[tuple[str, int]]:
    """(path, size) of the FASTQ files at a file or folder, by name."""
    store, path = _opened(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(path) :].split("/") if part)
    plain = [f for f in found if f.type == fs.FileType.File and not hidden(f.path)]
    named = [f for f in plain if f.path.endswith(SUFFIXES)] or plain
    return sorted((f.path, f.size) for f in named)


def _lines(stream, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from a byte that begins a line."""
    at = start
    for line in stream:
        yield at, line.rstrip(b"\r\n")
        at += len(line)


def _cut_lines(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each whole line begins and ends, without its line end."""
    stop = np.flatnonzero(raw == 10)
    first = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
    # A line that is empty ends where it begins.
    return first, np.maximum(first, stop - (raw[stop - 1] == 13))


def _front(raw: np.ndarray, first: np.ndarray, last: np.ndarray, sign: bytes) -> np.ndarray:
    """Whether lines begin with a sign."""
    return (last > first) & (raw[np.minimum(first, len(raw) - 1)] == sign[0])


def _taken(data: bytes, cuts: np.ndarray, part: int) -> pa.Array:
    """One piece of each record as an Arrow string; ``cuts`` has a row of pairs
    (begin, end) for each record, in ascending order."""
    bounds = np.append(cuts.ravel(), len(data)).astype(np.int32)
    every = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    found = every.take(pa.array(np.arange(2 * part, len(bounds) - 1, cuts.shape[1])))
    found.validate(full=True)
    return found


def blocks(stream, start: int = 0, end: int | None = None, size: int = BLOCK) -> Iterator[list[pa.Array]]:
    """[ids, sequences, qualities] of the records whose header begins in
    [start, end), some MB at a time.

    Lines and frames are found by numpy for a whole block.  A frame that isn't a
    record, and the first one beyond ``end``, are looked at in any case: a record
    that is cut off is an error of the range that owns the one before it.
    """
    at, data, synced, final = start, b"", not start, False
    if start:
        stream.seek(start - 1)
        at = start - 1
    while not final:
        want = size if end is None else min(size, max(0, end - at - len(data)) + (1 << 16))
        more = stream.read(want)
        final = not more
        data = data + more if data else more
        if final and data and data[-1:] != b"\n":
            data += b"\n"
        raw = np.frombuffer(data, np.uint8)
        first, last = _cut_lines(raw)
        i = 0
        if not synced:
            # The line that holds the byte before the range belongs to another.
            head = _front(raw, first[1:-2], last[1:-2], b"@") & _front(raw, first[3:], last[3:], b"+")
            found = np.flatnonzero(head)
            if len(found):
                i, synced = 1 + int(found[0]), True
            elif end is not None and len(first) > 1 and at + int(first[1]) >= end:
                return
            else:
                continue
        while i < len(first):
            if last[i] == first[i]:  # blank lines between records
                full = np.flatnonzero(last[i:] > first[i:])
                i = i + int(full[0]) if len(full) else len(first)
                continue
            if final and len(first) - i == 3 and last[i + 1] == first[i + 1]:  # an empty read at the end of a file
                first, last = np.append(first, len(data)), np.append(last, len(data))
            n = (len(first) - i) // 4
            x, y = first[i : i + 4 * n].reshape(n, 4), last[i : i + 4 * n].reshape(n, 4)
            good = _front(raw, x[:, 0], y[:, 0], b"@") & _front(raw, x[:, 2], y[:, 2], b"+") & (y[:, 1] - x[:, 1] == y[:, 3] - x[:, 3])
            k = n if good.all() else int(good.argmin())
            own = k if end is None else int(np.searchsorted(x[:k, 0], end - at))
            if own:
                cuts = np.stack((x[:own, 0] + 1, y[:own, 0], x[:own, 1], y[:own, 1], x[:own, 3], y[:own, 3]), axis=1)
                try:
                    yield [_taken(data, cuts, part) for part in range(3)]
                except pa.ArrowInvalid as e:
                    raise ValueError(f"not UTF-8 in the records from byte {at + int(x[0, 0])}") from e
            if own < k:
                return
            i += 4 * k
            if k < n and last[i] > first[i] or k == n and final and i < len(first) and last[i:].max(initial=0) > first[i]:
                begin = int(first[i])
                raise ValueError(f"not a FASTQ record at byte {at + begin}: {data[begin : begin + 60]!r}")
            if k == n:
                break
        # What is left is the beginning of the next frame.
        rest = int(first[i]) if i < len(first) else data.rfind(b"\n") + 1
        at, data = at + rest, data[rest:]


def records(stream, start: int = 0, end: int | None = None, multiline: bool = False, size: int = BLOCK) -> Iterator[tuple[str, str, str]]:
    """Records whose header begins in [start, end)."""
    if multiline:
        yield from _multiline(_lines(stream, start))
        return
    for columns in blocks(stream, start, end, size):
        yield from zip(*(c.to_pylist() for c in columns))


def _multiline(lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[str, str, str]]:
    for at, header in lines:
        if not header:
            continue
        if header[:1] != b"@":
            raise ValueError(f"not a FASTQ record at byte {at}: {header[:60]!r}")
        sequence, quality = [], []
        for _, line in lines:
            if line[:1] == b"+":
                break
            sequence.append(line)
        whole, n = b"".join(sequence), 0
        while n < len(whole):
            found = next(lines, None)
            if found is None:
                raise ValueError(f"the record at byte {at} is incomplete")
            quality.append(found[1])
            n += len(found[1])
        if n != len(whole):
            raise ValueError(f"the record at byte {at} has {n} qualities for {len(whole)} bases")
        yield header[1:].decode(), whole.decode(), b"".join(quality).decode()


NAMES = ["read_id", "sequence", "quality"]


def _batches(path: str, start: int, end: int | None, store: fs.FileSystem, size: int, multiline: bool) -> Iterator[pa.RecordBatch]:
    with store.open_input_file(path) as raw:
        stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        if not multiline:
            for columns in blocks(stream, start, end):
                whole = pa.RecordBatch.from_arrays(columns, NAMES)
                for i in range(0, whole.num_rows, size):
                    yield whole.slice(i, size)
            return
        found = _multiline(_lines(io.BufferedReader(stream), start))
        while some := list(islice(found, size)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*some)], NAMES)


class _Reading:
    def _setup(self, options: dict) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 64 << 20))
        self.size = int(options.get("batchsize", 10_000))
        self.multiline = str(options.get("multiline", "false")).lower() == "true"

    def _ranges(self, files: list[tuple[str, int]]) -> list[ByteRange]:
        whole = lambda path: path.endswith(".gz") or self.multiline
        n = sum(-(-size // self.split) for path, size in files if not whole(path))
        step = self.split * max(1, min(BLOCK // self.split, -(-n // RANGES)))
        out = []
        for path, size in files:
            if whole(path):
                out.append(ByteRange(path, 0, None))
            else:
                out += [ByteRange(path, a, min(size, a + step)) for a in range(0, size, step)]
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        return _batches(partition.path, partition.start, partition.end, store, self.size, self.multiline)


class FastqReader(_Reading, DataSourceReader):
    def __init__(self, options: dict):
        self._setup(options)

    def partitions(self) -> list[ByteRange]:
        return self._ranges(list_files(self.path)) or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter(())


class FastqStreamReader(_Reading, DataSourceStreamReader):
    """New files of a folder, whatever their names.  An offset lists the files that
    the folder holds, so it grows with them and not with those that have gone."""

    def __init__(self, options: dict):
        self._setup(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": dict(list_files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return self._ranges(sorted((p, n) for p, n in end["files"].items() if p not in start["files"]))

    def commit(self, end: dict) -> None:
        pass


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


class FastqWriter(DataSourceArrowWriter):
    """A file for each task, under its final name only when all tasks are done.
    Overwriting removes the files that this writer has named, and no others."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import uuid

        from pyspark import TaskContext

        store, root = _opened(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.fq"
        store.create_dir(f"{root}/_pending", recursive=True)
        with store.open_output_stream(f"{root}/_pending/{name}") as out:
            for batch in batches:
                i, s, q = (batch.column(c).cast(pa.large_string()).fill_null("") for c in NAMES)
                parts = ["@", i, "\n", s, "\n+\n", q, "\n", ""]
                text = pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in parts])
                out.write(flat(text)[0])
        return _Written([(f"{root}/_pending/{name}", f"{root}/{name}")])

    def commit(self, messages) -> None:
        store, root = _opened(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File and _OWN_NAME.fullmatch(f.base_name):
                    store.delete_file(f.path)
        for m in messages:
            for a, b in m.paths if m else ():
                store.move(a, b)
        store.delete_dir(f"{root}/_pending")

    def abort(self, messages) -> None:
        store, root = _opened(self.path)
        if store.get_file_info(f"{root}/_pending").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_pending")


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FastqStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FastqWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("fastq").options(**options).load(path)


def read_paired(spark: SparkSession, first: str, second: str, **options) -> DataFrame:
    """Both files' reads with ``mate`` 1 or 2."""
    one = read_fastq(spark, first, **options).withColumn("mate", F.lit(1))
    return one.unionByName(read_fastq(spark, second, **options).withColumn("mate", F.lit(2)))


def mates(paired: DataFrame) -> DataFrame:
    """Pairs of mates by their ids, without ``/1``, ``/2`` and what follows a blank."""
    key = F.regexp_replace(F.regexp_replace("read_id", r"\s.*$", ""), r"/[12]$", "").alias("pair_id")
    side = lambda n: paired.where(F.col("mate") == n).select(key, F.struct("read_id", "sequence", "quality").alias(f"mate{n}"))
    return side(1).join(side(2), "pair_id")


def lines(reads: DataFrame, *keep: str) -> DataFrame:
    return reads.select(*keep, F.format_string("@%s\n%s\n+\n%s", "read_id", "sequence", "quality").alias("value"))


def write_split(reads: DataFrame, path: str, keys: list[str] | tuple[str, ...] = ("status",)) -> None:
    """Folders status=passed and status=failed (or of other ``keys``) of FASTQ text,
    in one write."""
    lines(reads, *keys).write.mode("overwrite").partitionBy(*keys).text(path)


def remove(folder: str) -> None:
    store, root = _opened(folder)
    store.delete_dir(root)


def merge(folder: str, target: str) -> int:
    """One file out of a folder's parts, by name; streamed through the driver.
    Returns the number of lines."""
    store, root = _opened(folder)
    out_store, out_path = _opened(target)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    ends = 0
    with out_store.open_output_stream(out_path) as out:
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name.startswith("part-")), key=lambda f: f.path):
            with store.open_input_stream(f.path) as part:
                while chunk := part.read(1 << 20):
                    ends += chunk.count(b"\n")
                    out.write(chunk)
    return ends
