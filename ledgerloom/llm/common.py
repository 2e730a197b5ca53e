"""Shared helpers: tables in the shared folder, and vectorised word hashing for Arrow kernels."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# ----------------------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named on one machine (tests), a temporary folder is set as the checkpoint folder once; on a cluster that is an error,
    as its executors couldn't read what the driver writes there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if (own := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ledgerloom-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


class Scratch:
    """Tables of one job in the shared folder.  ``save`` cuts lineage; ``drop`` frees a table no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def save_in_buckets(self, df: DataFrame, column: str) -> DataFrame:
        """A table whose rows with the same value lie in one bucket, as many as a shuffle has partitions: grouping or joining by the column doesn't shuffle it.

        The catalogue gets a table over the folder.
        """
        self.n += 1
        name = f"scratch_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(n, column).option("path", f"{self.root}/{self.n}").option("compression", "zstd").format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# ----------------------------------------------------------------------------- memory

#: Rows of an Arrow batch of whole texts: two tasks' batches, on both sides of the pipe, must fit beside an executor's heap.
TEXT_ROWS = 1_000


def text_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to Python in batches of ``TEXT_ROWS`` rows, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def freed() -> None:
    """Gives memory that nothing uses back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def released(kernel: Callable) -> Callable:
    """A kernel that gives its memory back to the system when its task ends: workers live on between tasks."""

    @functools.wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            freed()

    return run


# ----------------------------------------------------------------------------- words

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For words of letters and digits alone: every other ASCII character parts them.
NOT_WORD = np.ones(256, bool)
NOT_WORD[128:] = NOT_WORD[0x30:0x3A] = NOT_WORD[0x41:0x5B] = NOT_WORD[0x61:0x7B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_PIECE = 1 << 19
_pow: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64); works on a copy."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, _PIECE + 4096)
        inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        _pow[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, f, np.uint64)))) for f in (_FACTOR, inverse)]
    return _pow[0], _pow[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the rows' offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def bounds(buf: np.ndarray, cuts: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses a cut."""
    inside = ~space[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words_of(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, pointer): 64-bit hashes of the lower-cased words with their bytes' places.

    ``pointer[i]:pointer[i + 1]`` are the words of text i.  Long inputs are hashed piece by piece, so that what is
    held beside the words themselves stays bounded.
    """
    hashes, starts, ends = [], [], []
    at, n = 0, len(buf)
    while at < n:
        to = min(at + _PIECE, n)
        if to < n:  # end the piece behind a space or at a text's end, so that no word is cut
            near = to - np.flatnonzero(space[buf[at:to]][::-1])[:1]
            text = offsets[np.searchsorted(offsets, to, "right") - 1]
            best = max([x for x in (*near.tolist(), int(text)) if at < x <= to], default=0)
            if not best:
                later = np.flatnonzero(space[buf[to:]])[:1]
                nxt = offsets[np.searchsorted(offsets, to, "left")]
                best = int(min([nxt, *(later + to + 1).tolist()]))
            to = best
        piece = buf[at:to]
        s, e = bounds(piece, offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at, space)
        up, down = _powers(len(piece))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((LOWER[piece].astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    s = join(starts, np.int64)
    return join(hashes, np.uint64), s, join(ends, np.int64), np.searchsorted(s, offsets)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part of its own."""
    buf, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
