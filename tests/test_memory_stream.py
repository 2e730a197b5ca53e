"""The memory stream as a source with offsets, and its way into the ledger."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.ingest import memory_entries, memory_rows
from ledgerloom.sources.memory_stream import Reader
from ledgerloom.streaming import memories, tables

NAMES = ["memory_id", "kind", "content", "project", "scope", "created_at", "updated_at", "tags", "origin"]
TYPES = [pa.string()] * 7 + [pa.list_(pa.string()), pa.string()]


def entry(k, at, name=None, origin="human", scope="global", content="text"):
    return (name or f"m{k}", "note", content, None, scope, at, at, ["a"], origin)


def put(folder, name, rows, extra=False, group=2):
    folder.mkdir(exist_ok=True)
    t = pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), TYPES)], NAMES)
    pq.write_table(t.append_column("tenant", pa.array([1] * len(t))) if extra else t, folder / f"{name}.parquet", row_group_size=group)


FIRST = [entry(1, "2024-01-01"), entry(2, "2024-01-03"), entry("5", "2024-01-03"), entry(3, "2024-01-02", scope="nowhere"), entry(4, "2024-01-02", origin="ledger"), entry(1, "2024-01-02", content="newer")]
SECOND = [entry("6", "2024-01-03"), entry("5x", "2024-01-03"), entry(7, "2024-02-01", origin="agent"), entry(1, "2024-02-01", content="too late"), entry(8, None), (None, *entry(9, "2024-03-01")[1:])]


def run(spark, tmp_path, written=lambda name: None):
    memories.pull(memories.memories(spark, str(tmp_path / "in")), str(tmp_path / "ledger"), str(tmp_path / "progress"), written=written).awaitTermination()


def ids(spark, tmp_path, name="observations"):
    return sorted(r.source_uri.split("/")[-1] for r in tables.table(spark, str(tmp_path / "ledger"), name).collect())


def test_each_entry_once_with_equal_times_across_a_batch_end(spark, tmp_path):
    put(tmp_path / "in", "a", FIRST)
    run(spark, tmp_path)
    assert ids(spark, tmp_path) == ["m1", "m2", "m5"]
    run(spark, tmp_path)  # nothing new
    assert len(tables.committed(spark, str(tmp_path / "ledger"))) == 1
    put(tmp_path / "in", "b", SECOND, extra=True)
    run(spark, tmp_path)
    assert ids(spark, tmp_path) == ["m1", "m2", "m5", "m5x", "m6", "m7"]
    ledger = str(tmp_path / "ledger")
    assert {r.object for r in tables.table(spark, ledger, "facts").collect()} == {"text", "newer"}
    assert all(tables.table(spark, ledger, t).count() == 6 for t in memories.TABLES)
    (tmp_path / "progress").rename(tmp_path / "lost")  # without its checkpoint it starts over and finds nothing new
    run(spark, tmp_path)
    assert len(ids(spark, tmp_path)) == 6


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", memories.TABLES)
def test_a_batch_that_ends_half_way_is_taken_again(spark, tmp_path, at):
    put(tmp_path / "in", "a", FIRST)

    def kill(name):
        if name == at:
            raise Killed

    with pytest.raises(Exception):
        run(spark, tmp_path, kill)
    assert tables.committed(spark, str(tmp_path / "ledger")) == []
    put(tmp_path / "in", "b", SECOND)
    run(spark, tmp_path)
    run(spark, tmp_path)
    assert ids(spark, tmp_path) == ["m1", "m2", "m5", "m5x", "m6", "m7"]


def test_offsets_and_groups(tmp_path):
    r = Reader(str(tmp_path / "none"))
    assert r.latestOffset() == r.initialOffset() == {"at": "", "id": ""} and r.partitions(r.initialOffset(), r.latestOffset()) == []
    put(tmp_path / "in", "a", FIRST)
    put(tmp_path / "in", "_hidden", SECOND)
    r = Reader(str(tmp_path / "in"))
    end = r.latestOffset()
    assert end == {"at": "2024-01-03", "id": "m5"}
    part = r.partitions(r.initialOffset(), end)
    assert sum(b.num_rows for p in part for b in r.read(p)) == 6
    put(tmp_path / "in", "b", SECOND)
    assert r.latestOffset() == {"at": "2024-02-01", "id": "m7"}
    part = r.partitions(end, r.latestOffset())
    assert {g.path.split("/")[-1] for p in part for g in p.groups} == {"a.parquet", "b.parquet"} and len([g for p in part for g in p.groups]) == 4  # of six: groups of earlier or later times aren't read
    assert sorted(x for p in part for b in r.read(p) for x in b.column("memory_id").to_pylist()) == ["m1", "m5x", "m6", "m7"]


def test_the_stream_equals_the_batch_form(spark, tmp_path):
    rows = [entry(k, f"2024-01-{k % 28 + 1:02d}", origin=("human", "agent", "ledger")[k % 3], scope=("global", "meta", "other", "project")[k % 4]) for k in range(300)]
    put(tmp_path / "in", "a", rows, group=50)
    run(spark, tmp_path)
    lines = spark.createDataFrame(rows, ", ".join(f"{n} {'array<string>' if n == 'tags' else 'string'}" for n in NAMES)).select(F.to_json(F.struct("*")).alias("value"))
    for name, want in zip(memories.TABLES, memory_rows(memory_entries(lines))):
        got = tables.table(spark, str(tmp_path / "ledger"), name).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count()
