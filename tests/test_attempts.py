"""Attempts and quarantine as keyed state: the sixth failure, own pages, release, a restart from the checkpoint, expiry."""

import datetime as dt

import pytest

from ledgerloom.streaming.attempts import attempts

KIND = "key string, at timestamp, kind string, error string"


@pytest.fixture
def feed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    n = [0]

    def run(*rows, **options):
        """Adds a file, runs the stream to its end from the checkpoint, and gives what is new."""
        n[0] += 1
        if rows:
            spark.createDataFrame([(k, dt.datetime(2024, 1, n[0], 0, j), kind, f"e{n[0]}") for j, (k, kind) in enumerate(rows)], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = []
        stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        write = attempts(stream, **options).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: got.extend(map(tuple, b.collect())))
        write.trigger(availableNow=True).start().awaitTermination()
        return {r[0]: r[1:] for r in got}

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_the_sixth_failure_is_quarantined_and_a_release_starts_anew(feed):
    assert feed(*[("a", "failed")] * 5, ("b", "own page"), ("c", "failed")) == {"a": (5, False, None, "failed"), "b": (6, True, "e1", "quarantined"), "c": (1, False, None, "failed")}
    # each run is a restart from the checkpoint
    assert feed(("a", "failed"), ("b", "done"), ("c", "done")) == {"a": (6, True, "e2", "quarantined"), "b": (6, True, "e1", "quarantined"), "c": (0, False, None, "done")}
    assert feed(("a", "failed"), ("b", "release"), ("c", "failed")) == {"a": (6, True, "e2", "quarantined"), "b": (0, False, None, "released"), "c": (1, False, None, "failed")}
    assert feed(("a", "release"), ("a", "failed"), ("b", "failed")) == {"a": (1, False, None, "failed"), "b": (1, False, None, "failed")}


def test_a_key_without_news_is_forgotten(feed):
    hour = dict(forget_ms=3_600_000)
    feed(("a", "failed"), ("b", "own page"), **hour)
    got = feed(("c", "failed"), **hour)
    assert got["a"] == (0, False, None, "forgotten") and "b" not in got
    got = feed(("a", "failed"), ("b", "failed"), **hour)
    assert got["a"] == (1, False, None, "failed") and got["b"][1]
