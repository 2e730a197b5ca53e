"""The drain into several tables: batches that end half-way, reruns, bad rows."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import tables

OUTBOX = "seq long, adapter string, source_id string, source_kind string, source_uri string, idempotency_key string, trust_tier string, transform_policy string, payload string, appended_at string"


def row(seq, payload, key=None, uri="file:///n/a.md", source="n"):
    return (seq, "local-file", source, "local-file", uri, key or f"k{seq}", "user", "tp", payload, "2024-01-01")


FIRST = [
    row(1, '{"content":"Some text.","mime_type":"text/markdown","contexts":["c1",7],"occurred_at":"2023-05-05"}'), row(2, "no json at all"), row(3, ""), row(4, None), row(5, '"bare text"'), row(6, "x", uri="file:///h/.ledger/wiki/p.md"),
    row(7, "Actually, I was wrong about that fact of the ledger", key="k7"), row(8, '{"content":5,"metadata":{"a":"b"}}'),
]
SECOND = [row(9, "again", key="k7"), row(10, '{"content":"  "}', source="m"), row(11, '{"content":"new","contexts":["c1"]}'), row(12, "new too", key="k12"), row(13, "twin", key="k12")]


@pytest.fixture
def folders(spark, tmp_path):
    for name, rows in (("1", FIRST), ("2", SECOND)):
        spark.createDataFrame(rows, OUTBOX).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    return str(tmp_path / "in" / "*"), str(tmp_path / "ledger"), str(tmp_path / "progress")


def run(spark, folders, written=lambda name: None):
    source, ledger, progress = folders
    stream = spark.readStream.schema(OUTBOX).option("maxFilesPerTrigger", 1).parquet(source)
    tables.drain_tables(stream, ledger, progress, written=written).awaitTermination()


def contents(spark, ledger):
    return {name: sorted(map(str, tables.table(spark, ledger, name).collect())) for name in tables.TABLES}


class Killed(Exception):
    pass


@pytest.mark.parametrize("last", ["observations", "actions", "dead_letters"])
def test_a_batch_that_ends_half_way_is_completed(spark, folders, last):
    ended = []

    def die(name):
        if name == last and not ended:
            ended.append(name)
            raise Killed(name)

    with pytest.raises(Exception):
        run(spark, folders, die)
    assert tables.committed(spark, folders[1]) == [] and tables.table(spark, folders[1], "observations") is None  # what is half-way isn't there
    run(spark, folders)
    assert len(tables.committed(spark, folders[1])) == 2
    got = contents(spark, folders[1])
    batch = tables.drained(spark.read.schema(OUTBOX).parquet(folders[0]))
    for name, rows in batch.items():
        want = rows.collect()
        assert len(got[name]) == len(want), name
    assert len(got["observations"]) == 8 and len(got["dead_letters"]) == 3 and len(got["corrections"]) == len(got["signals"]) == 1
    run(spark, folders)  # nothing is left
    assert contents(spark, folders[1]) == got


def test_a_lost_checkpoint_does_not_write_twice(spark, folders, tmp_path):
    run(spark, folders)
    got = contents(spark, folders[1])
    got.pop("dead_letters")  # bad rows are bad again
    run(spark, (*folders[:2], str(tmp_path / "other")))
    assert {k: v for k, v in contents(spark, folders[1]).items() if k in got} == got


def test_drafts(spark):
    d = {r.seq: r for r in tables.drafts(spark.createDataFrame(FIRST, OUTBOX)).collect()}
    assert (d[1].content, d[1].mime_type, d[1].occurred_at, d[1].contexts, d[1].metadata, d[1].error) == ("Some text.", "text/markdown", "2023-05-05", ["c1"], None, None)
    assert (d[2].content, d[2].mime_type, d[2].occurred_at, d[2].metadata) == ("no json at all", "text/plain", "2024-01-01", '{"auto_wrapped":"true"}')
    assert d[3].error == d[4].error == "empty payload" and d[6].error.startswith("self-consumption") and d[5].content == "bare text"
    assert d[8].content == '{"content":5,"metadata":{"a":"b"}}' and '"a":"b"' in d[8].metadata and "auto_wrapped" in d[8].metadata


def test_signals_name_the_facts(spark):
    facts = spark.createDataFrame([(5, "ledger", "the fact was wrong", None, 1, False), (6, "other", "nothing", None, 1, False)], "fact_id long, subject string, object string, session_id string, age_days long, archived boolean")
    out = tables.drained(spark.createDataFrame(FIRST, OUTBOX), facts=facts)
    assert "1 related fact(s): 5. Context: Actually" in out["signals"].first().message
    c = out["corrections"].first()
    assert c.related == ["5"] and c.processed and c.pattern.startswith("en.")


def test_empty_outbox(spark):
    assert all(t.count() == 0 for t in tables.drained(spark.createDataFrame([], OUTBOX)).values())
    assert tables.drafts(spark.createDataFrame([], OUTBOX).withColumn("_j", F.lit(1)).drop("_j")).count() == 0
