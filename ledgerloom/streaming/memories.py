"""A memory stream into the ledger's tables: each entry once, the cursor moves when its batch is there as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import memory_rows, valid_entries
from ..sources.memory_stream import MemoryStream
from ..sources.scratch import job, saved
from .tables import batch_name, commit, committed, table

TABLES = ("observations", "facts", "chunks", "fact_contexts")


def memories(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a folder as a stream."""
    spark.dataSource.register(MemoryStream)
    return spark.readStream.format("memory_stream").option("path", path).load()


def pull(stream: DataFrame, ledger: str, checkpoint: str, mapper=None, written: Callable[[str], None] = lambda name: None):
    """Takes what a stream of entries has now into observations, facts, chunks and contexts at ``ledger``.

    The stream's offset, which the checkpoint holds, is the cursor: it moves when a batch has been committed.  An entry whose id the ledger has is no news, also if the
    stream starts over without its checkpoint; of repeated ids in a batch the latest counts; entries that break the contract, or that the ledger has sent, are left out.
    """

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        batch, done = batch_name(spark, checkpoint, number), committed(spark, ledger)
        if batch in done:
            return
        entries = valid_entries(rows)
        known = table(spark, ledger, "observations", done)
        with job(spark, "memories"):
            if known is not None:
                key = F.concat(F.lit("memory:"), "memory_id")
                entries = entries.join(known.select("idempotency_key"), key == F.col("idempotency_key"), "left_anti")
            commit(spark, dict(zip(TABLES, memory_rows(saved(entries, "entries"), mapper))), batch, ledger, written)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
