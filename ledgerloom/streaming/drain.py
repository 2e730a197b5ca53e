"""Streaming forms: draining the outbox exactly once, counting failures until quarantine, windows with late data, a circuit breaker."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger_ops import append_new

QUARANTINE_AFTER = 5


#: Parts of a ledger by the hash of the key: a micro-batch reads those that its own keys fall into.
PARTS = 256


def there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drain(stream: DataFrame, ledger: str, checkpoint: str, once: bool = True):
    """Appends a stream of outbox events (seq, adapter, idempotency_key, ...) to the ledger at ``ledger``, each key once.

    Every micro-batch keeps the earliest event of each key and leaves out keys that the ledger has; of the ledger it reads the keys' own parts, and
    of those the two key columns.  A batch writes a folder of its own number, so a batch that runs again after a failure replaces what it had
    written: its own folder isn't read when it is judged.
    """
    part = F.pmod(F.xxhash64("adapter", "idempotency_key"), F.lit(PARTS)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        spark, before = batch.sparkSession, None
        batch = batch.withColumn("part", part)
        if there(spark, ledger):  # the first batch finds none
            parts = [r.part for r in batch.select("part").distinct().collect()]  # PARTS at most
            before = spark.read.parquet(ledger).where((F.col("batch") != number) & F.col("part").isin(parts)).select("adapter", "idempotency_key")
        append_new(batch, before).write.mode("overwrite").partitionBy("part").parquet(f"{ledger}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def failures(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Failed attempts a key within an hour, with a watermark: (window, key, attempts, quarantined)."""
    n = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "key").agg(F.count(F.lit(1)).alias("attempts"))
    return n.withColumn("quarantined", F.col("attempts") > QUARANTINE_AFTER)


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions a user: (session, user_id, n)."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n"))


class Breaker:
    """Closed until more than half of the last minute's calls failed, three at least; then open for half a minute; then one probe decides."""

    def __init__(self, window: float = 60, cool: float = 30, least: int = 3):
        self.window, self.cool, self.least = window, cool, least
        self.calls: deque[tuple[float, bool]] = deque()
        self.failed, self.opened, self.probing = 0, None, False

    def call(self, at: float, ok: bool) -> str:
        """The state in which the call at this second meets the breaker; an open one refuses it, and its outcome doesn't count."""
        if self.opened is not None:
            if at < self.opened + self.cool:
                return "open"
            if ok:
                self.__init__(self.window, self.cool, self.least)
            else:
                self.opened = at
            return "half-open"
        self.calls.append((at, ok))
        self.failed += not ok
        while self.calls[0][0] <= at - self.window:
            self.failed -= not self.calls.popleft()[1]
        if self.failed >= self.least and self.failed > len(self.calls) / 2:
            self.opened = at
        return "closed"


def breaker_states(calls: DataFrame, window: float = 60, cool: float = 30, least: int = 3) -> DataFrame:
    """(site, id, state) of calls (site, id, at, ok), each site's in the order of at and id.

    A site's calls stream through one task, as each state depends on the one before; only the window is held.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, breaker = object(), None
        for p in parts:
            states = []
            for s, at, ok in zip(p["site"], p["at"], p["ok"]):
                if s != site:
                    site, breaker = s, Breaker(window, cool, least)
                states.append(breaker.call(at, ok))
            yield pd.DataFrame({"site": p["site"], "id": p["id"], "state": states})

    return calls.select("site", "id", "at", "ok").repartition("site").sortWithinPartitions("site", "at", "id").mapInPandas(run, "site string, id long, state string")
