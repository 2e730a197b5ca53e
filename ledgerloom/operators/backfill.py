"""Filling in a column of a table that exists, batch by batch, so that whoever stops it loses a batch at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.catalog import query
from ..sources.ledger import Tables
from ..sources.scratch import new_folder
from ..streaming.drain import there


def origin_hash() -> Column:
    """Where an observation came from: a digest of its adapter, address and key."""
    return F.sha2(F.concat_ws("|", "adapter", "source_uri", "idempotency_key"), 256)


class OriginBackfill:
    """The origin hashes of observations (observe_id, adapter, source_uri, idempotency_key, origin_hash, method) that have none, in a folder of their own.

    ``run`` goes through the open observations in the order of their ids, ``size`` at a time.  A batch is written to a folder of its number, then its row of the progress table: how far it
    came.  A batch without that row is written again, into the same folder; a run after all is done does nothing.  Ids are text, and those that repeat are one observation.
    """

    PROGRESS = "number int, last string, n long"

    def __init__(self, spark: SparkSession, folder: str, size: int = 500):
        self.spark, self.folder, self.size = spark, folder, size

    def progress(self) -> DataFrame:
        path = f"{self.folder}/progress"
        return self.spark.read.schema(self.PROGRESS).parquet(path) if there(self.spark, path) else self.spark.createDataFrame([], self.PROGRESS)

    def pending(self, observations: DataFrame) -> DataFrame:
        """Observations without a hash that no finished batch has."""
        last = self.progress().agg(F.max("last")).first()[0]
        o = observations.where("origin_hash is null and observe_id is not null")
        return o if last is None else o.where(F.col("observe_id") > last)

    def run(self, observations: DataFrame, dry_run: bool = False, batches: int | None = None) -> dict[str, int]:
        """How many observations were open (scanned) and got their hash (updated); a dry run counts them and writes nothing.  ``batches`` at most are done."""
        if dry_run:
            return {"scanned": self.pending(observations).select("observe_id").distinct().count(), "updated": 0}
        number = self.progress().count()
        updated, left = 0, batches
        while left is None or left > 0:
            # the smallest open ids: a task keeps so many of its own
            batch = self.pending(observations).groupBy("observe_id").agg(F.min(F.struct("adapter", "source_uri", "idempotency_key", "method")).alias("_x")).select("observe_id", "_x.*").orderBy("observe_id").limit(self.size)
            path = f"{self.folder}/hashes/batch={number}"
            batch.select("observe_id", origin_hash().alias("origin_hash"), F.coalesce("method", "adapter").alias("method")).write.mode("overwrite").parquet(path)
            n, last = self.spark.read.parquet(path).agg(F.count(F.lit(1)), F.max("observe_id")).first()
            if not n:
                break
            self.spark.createDataFrame([(number, last, n)], self.PROGRESS).coalesce(1).write.mode("append").parquet(f"{self.folder}/progress")
            number, updated, left = number + 1, updated + n, None if left is None else left - 1
            if n < self.size:
                break
        return {"scanned": updated, "updated": updated}

    def filled(self, observations: DataFrame) -> DataFrame:
        """The observations with the hashes of finished batches; what had a hash keeps it."""
        done = [r.number for r in self.progress().select("number").collect()]
        if not done:
            return observations
        new = self.spark.read.parquet(*(f"{self.folder}/hashes/batch={k}" for k in done)).select("observe_id", F.col("origin_hash").alias("_hash"), F.col("method").alias("_method"))
        o = observations.join(new, "observe_id", "left")
        return o.withColumn("origin_hash", F.coalesce("origin_hash", "_hash")).withColumn("method", F.coalesce("method", "_method")).drop("_hash", "_method")


@query("select lpad(doc_id::varchar, 12, '0') as observe_id, case when doc_id % 3 = 0 then 'known' else sha256('a' || (doc_id % 2) || '|file:///' || source || '|' || md5(text)) end as origin_hash, case when doc_id % 4 = 0 then 'own' when doc_id % 3 != 0 then 'a' || (doc_id % 2) end as method from documents")
def origin_backfill(t: Tables) -> DataFrame:
    """DOM-21: a third of the observations has a hash; the others get theirs in four batches, of which the second run finds two."""
    k = F.col("doc_id")
    o = t("documents").select(
        F.lpad(k.cast("string"), 12, "0").alias("observe_id"), F.concat(F.lit("a"), k % 2).alias("adapter"), F.concat(F.lit("file:///"), "source").alias("source_uri"), F.md5("text").alias("idempotency_key"),
        F.when(k % 3 == 0, "known").alias("origin_hash"), F.when(k % 4 == 0, "own").alias("method"),
    )
    fill = OriginBackfill(t.spark, new_folder(t.spark, "backfill"))
    fill.size = max(1, -(-fill.run(o, dry_run=True)["scanned"] // 4))
    fill.run(o, batches=2)
    fill.run(o)
    return fill.filled(o).select("observe_id", "origin_hash", "method")
