"""A memory stream as a source for streaming reads: Parquet files of entries, read behind an offset of time and id.

    spark.dataSource.register(MemoryStream)
    entries = spark.readStream.format("memory_stream").option("path", folder).load()
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.ingest import MEMORY

#: Rows of row groups that one task reads; a larger group is a task of its own.
TASK_ROWS = 200_000

_KEY = ["updated_at", "memory_id"]
Key = tuple[str, str]


@dataclass(frozen=True)
class Group:
    """A row group: where it is, its rows, and the first and last time in it (None where the file doesn't say)."""

    path: str
    at: int
    rows: int
    first: str | None
    last: str | None


class Part(InputPartition):
    """Row groups to read, and the offsets between which their entries lie."""

    def __init__(self, groups: list[Group], start: Key, end: Key):
        self.groups, self.start, self.end = groups, start, end


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _behind(batch: pa.RecordBatch, key: Key) -> pa.Array:
    """Which entries come after a key; those without a time or an id never do."""
    at, name = batch.column("updated_at"), batch.column("memory_id")
    later = pc.or_(pc.greater(at, key[0]), pc.and_(pc.equal(at, key[0]), pc.greater(name, key[1])))
    return pc.fill_null(later, False)


class Reader(DataSourceStreamReader):
    """Offsets are (updated_at, memory_id) of the last entry read.

    The driver reads footers only, each file's once, and of the groups that may hold the newest entry the two columns of the key; tasks read the groups whose times meet the batch's.
    """

    def __init__(self, path: str):
        self.path, self.seen, self.known = path, {}, ("", "")

    def initialOffset(self) -> dict:
        return {"at": "", "id": ""}

    def groups(self) -> list[Group]:
        system, root = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        hidden = lambda f: any(x.startswith(("_", ".")) for x in f.path[len(root) :].split("/"))
        files = {(f.path, f.size, f.mtime_ns): f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not hidden(f)}
        self.seen = {k: self.seen[k] if k in self.seen else self._footer(system, p) for k, p in files.items()}
        return [g for own in self.seen.values() for g in own]

    def _footer(self, system: fs.FileSystem, path: str) -> list[Group]:
        out = []
        with system.open_input_file(path) as f:
            meta = pq.read_metadata(f)
        for k in range(meta.num_row_groups):
            group = meta.row_group(k)
            times = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "updated_at")
            said = times.statistics if times.is_stats_set and times.statistics.has_min_max else None
            out.append(Group(path, k, group.num_rows, said and said.min, said and said.max))
        return out

    def latestOffset(self) -> dict:
        """The last key there is; the times in the footers say in which groups to look for it."""
        system = _filesystem(self.path)[0]
        for g in sorted(self.groups(), key=lambda g: (g.last is None, g.last or ""), reverse=True):
            if g.rows and (g.last is None or g.last >= self.known[0]):  # the newest entries may lack an id
                with system.open_input_file(g.path) as f:
                    for b in pq.ParquetFile(f).iter_batches(row_groups=[g.at], columns=_KEY):
                        b = b.filter(_behind(b, self.known))
                        if b.num_rows:
                            at = pc.max(b.column("updated_at")).as_py()
                            self.known = (at, pc.max(b.filter(pc.equal(b.column("updated_at"), at)).column("memory_id")).as_py())
        return {"at": self.known[0], "id": self.known[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, z = (start["at"], start["id"]), (end["at"], end["id"])
        self.known = max(self.known, z)
        if a >= z:
            return []
        parts, rows = [[]], 0
        for g in sorted(self.groups(), key=lambda g: (g.path, g.at)):
            if g.rows and (g.last is None or g.last >= a[0] and g.first <= z[0]):
                if parts[-1] and rows + g.rows > TASK_ROWS:
                    parts.append([])
                    rows = 0
                parts[-1].append(g)
                rows += g.rows
        return [Part(p, a, z) for p in parts if p]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(c.split()[0], pa.list_(pa.string()) if c.split()[1].startswith("array") else pa.string()) for c in MEMORY.split(", ")])
        system = _filesystem(self.path)[0]
        for g in partition.groups:
            with system.open_input_file(g.path) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=10_000, row_groups=[g.at], columns=kinds.names):
                    b = b.filter(pc.and_(_behind(b, partition.start), pc.invert(_behind(b, partition.end))))
                    if b.num_rows:
                        yield pa.RecordBatch.from_arrays([b.column(c).cast(kinds.field(c).type) for c in kinds.names], schema=kinds)


class MemoryStream(DataSource):
    """Entries by the nine-field contract in a folder of Parquet files (option path: a local path, or a URI that pyarrow opens), which a sender adds to.

    Times are UTC texts of one format and compared as such, then ids by code point.  An entry is read once, when it lies behind the offset of the last batch: a
    sender adds files in the order of time, as a later file's entries at or before the offset aren't read.  Equal times across a batch's end are told apart by their ids.
    Entries without a time or an id aren't read; repeated entries of one batch are all read; columns beside the contract's are left; an empty or
    missing folder gives nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "memory_stream"

    def schema(self) -> str:
        return MEMORY

    def streamReader(self, schema) -> Reader:
        if "path" not in self.options:
            raise ValueError("the option path names the folder of the stream")
        return Reader(self.options["path"])
