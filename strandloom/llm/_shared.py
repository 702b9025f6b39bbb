"""What the operators of this subpackage share: work tables and ordered buckets."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach.

    It is ``spark.checkpoint.dir`` of the session.  Only a session in local
    mode may go without: it gets a temporary folder of this process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL_ROOT:
        _LOCAL_ROOT["dir"] = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return _LOCAL_ROOT["dir"]


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send texts to Python workers in smaller batches than Spark's default of
    10000 rows, which for texts takes hundreds of MB.  A session that sets its own
    number keeps it; Spark's bound in bytes holds as well."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(rows))


_MADE: list[str] = []
_AT_EXIT: set[str] = set()


def give_back() -> None:
    """Hand memory that is free back to the system.  Python workers live on from one
    stage to the next, and what each of them once needed would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)  # glibc alone has it


def work_path(spark: SparkSession, label: str) -> str:
    """A new path for work files.  What is left below the application's folder is
    removed when the driver's process ends; ``work_files`` removes it before."""
    root = f"{shared_dir(spark)}/strandloom/{spark.sparkContext.applicationId}"
    if root not in _AT_EXIT:
        _AT_EXIT.add(root)
        atexit.register(discard, spark, [root])
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove work files, through the file system that Spark wrote them to."""
    for path in paths:
        # The session may have ended; what can't be removed stays.
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._gateway.jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


@contextlib.contextmanager
def work_files(spark: SparkSession) -> Iterator[list[str]]:
    """The paths that are made within; those that are still listed at the end are removed."""
    begin, own = len(_MADE), []
    try:
        yield own
    finally:
        own += [p for p in _MADE[begin:] if p not in own]
        del _MADE[begin:]
        discard(spark, [p for p in own if p not in _KEPT])


_KEPT: set[str] = set()


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there,
    so a lost executor costs no more than the tasks that it ran.  With ``keep``
    the table outlives ``work_files``."""
    spark, path = df.sparkSession, work_path(df.sparkSession, label)
    if keep:
        _KEPT.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more rows than this is common; so many keys may be, and beyond that
#: only those with more than their share of all rows.
COMMON, COMMON_KEYS = 1000, 50_000


def labelled(rows: DataFrame, key: str, labels: DataFrame, value: str) -> DataFrame:
    """``rows`` with the ``value`` that ``labels`` has for their key.  ``labels``
    has one row for each key, with ``n``, the number of rows that have it.  Rows
    of common keys stay where they are: there are ``COMMON_KEYS`` such keys at
    most, so they are broadcast.  The rest is joined by a shuffle."""
    total = labels.agg(F.sum("n")).first()[0] or 0
    common = labels.where(F.col("n") > max(COMMON, total // COMMON_KEYS)).select(F.col(key).alias("_common"), F.col(value).alias("_value"))
    marked = rows.join(F.broadcast(common), F.col(key) == F.col("_common"), "left")
    own = marked.where("_common is not null").select(*rows.columns, F.col("_value").alias(value))
    rest = marked.where("_common is null").select(*rows.columns)
    return own.unionByName(rest.join(labels.select(F.col(key).alias("_key"), value), F.col(key) == F.col("_key")).select(*rows.columns, value))


@dataclass(frozen=True)
class RangeBuckets:
    """Ascending ranges of an integer key, each beginning at a key that occurs.

    There are up to ``FEW`` ranges of ``rows_each`` rows; a table that would have
    more than ``ROWS_MOST`` rows in each of so few gets more ranges, ``MOST`` at
    most.  So the bounds, 8 bytes each, may travel in the plan.
    """

    FEW, MOST, ROWS_MOST = 1 << 10, 1 << 16, 100_000

    bounds: tuple[int, ...]

    @classmethod
    def count(cls, rows: int, rows_each: int) -> int:
        return max(1, min(cls.FEW, rows // rows_each), min(cls.MOST, rows // cls.ROWS_MOST))

    @classmethod
    def of(cls, df: DataFrame, key: str, rows_each: int) -> RangeBuckets:
        """Two passes over ``key`` alone."""
        n = df.agg(F.count(key)).first()[0]
        if not n:
            return cls(())
        count = cls.count(n, rows_each)
        # As text, the plan has one literal whatever the number.
        shares = F.expr("cast(split('" + ",".join(str(i / count) for i in range(count)) + "', ',') as array<double>)")
        found = df.agg(F.percentile_approx(key, shares, 10 * max(cls.FEW, count)).alias("q"), F.min(key).alias("m")).first()
        return cls(tuple(sorted({found["m"], *found["q"]})))

    def _listed(self, bounds: tuple[int, ...]) -> Column:
        return F.expr("cast(split('" + ",".join(map(str, bounds)) + "', ',') as array<bigint>)")

    def index(self, key: Column) -> Column:
        """The bucket of a key, from 0; a null key is in the first.  Two short
        scans of about the square root of the number of bounds each."""
        if len(self.bounds) < 2:
            return F.lit(0)
        width = max(1, int(len(self.bounds) ** 0.5))
        k = key.cast("bigint")
        at = F.greatest(F.size(F.filter(self._listed(self.bounds[::width]), lambda x: x <= k)), F.lit(1))
        near = F.slice(self._listed(self.bounds), (at - 1) * width + 1, F.lit(width))
        within = F.size(F.filter(near, lambda x: x <= k))
        return F.coalesce(F.greatest((at - 1) * width + within - 1, F.lit(0)), F.lit(0))

    def begins(self, key: Column, index: Column) -> Column:
        """Whether a key is the one that its bucket begins at."""
        if not self.bounds:
            return F.lit(False)
        return F.coalesce(F.get(self._listed(self.bounds), index) == key, F.lit(False))


_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            made = np.full(n, base, np.uint64)
            made[0] = 1
            _POWERS[name] = np.multiply.accumulate(made)
    return _POWERS["up"], _POWERS["down"]


def slice_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of an array of uint64, in a few vector operations:
    differences of prefix sums of a polynomial, brought to the same power."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


#: Bytes of text that are cut into words together.
PIECE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash, and first byte, of each word; A-Z count as lower case."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate(([True], _SPACE[raw], [True]))
    start = np.flatnonzero(space[:-1] & ~space[1:])
    end = np.flatnonzero(~space[:-1] & space[1:])
    return slice_hashes(_LOWER[raw], start, end), start


def word_hashes(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Hashes of the words of whole texts, for some texts at a time."""
    which, held, size = [], [], 0
    for i, text in enumerate([*texts, None]):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and (size + len(data) > PIECE or i == len(texts)):
            begin = np.cumsum([0, *[len(x) + 1 for x in held]])
            h, at = _hashes(b"\n".join(held))
            cut = np.searchsorted(at, begin)
            yield which, [h[a:b] for a, b in zip(cut, cut[1:])]
            which, held, size = [], [], 0
        if i == len(texts):
            break
        if len(data) > PIECE:
            parts, a = [], 0
            while a < len(data):
                b = min(len(data), a + PIECE)
                # Back to white space, so that no word is cut but one as long as a piece.
                back = max(data.rfind(b" ", a, b), data.rfind(b"\n", a, b))
                b = back + 1 if b < len(data) and back > a else b
                parts.append(_hashes(data[a:b])[0])
                a = b
            yield [i], [np.concatenate(parts)]
        else:
            which.append(i)
            held.append(data)
            size += len(data) + 1
