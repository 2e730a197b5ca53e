"""Draining the outbox into several tables under one commit record: a batch that ended half-way is completed or ignored as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.actions import derived_actions, once
from ..operators.ledger_ops import own_pages
from ..operators.lifecycle import correction_signals, related_facts
from ..operators.text_ops import corrections_in
from ..sources.scratch import job, saved
from .drain import there

#: What a drain writes, in this order, before the commit record.
TABLES = ("observations", "sources", "source_contexts", "queue", "actions", "corrections", "signals", "dead_letters")
#: Columns by which a row of a table is the same as another.
KEYS = {"observations": ["adapter", "source_id", "idempotency_key"], "sources": ["source_id"], "source_contexts": ["source_id", "context_id"]}
_IS = ["adapter", "source_id", "idempotency_key"]


def drafts(outbox: DataFrame) -> DataFrame:
    """Outbox rows (seq, adapter, source_id, source_kind, source_uri, idempotency_key, trust_tier, transform_policy, payload, appended_at) as observations, with ``error`` where they are none.

    A payload with a text under ``content`` is what it says: its mime type, time and metadata; any other is its own content, as plain text, marked so in the
    metadata; a JSON text is that text.  Contexts that aren't texts are left out.  Errors: an empty or null payload, and the ledger's own pages.
    """
    c = F.col
    d = outbox.select("*", once(F.try_parse_json("payload").alias("any")).alias("_a"))
    d = d.select("*", once(c("_a.any").alias("any"), F.schema_of_variant("_a.any").alias("kind"), F.when(F.schema_of_variant("_a.any").startswith("OBJECT"), c("_a.any")).alias("v")).alias("_j"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("_j.v", path, "variant")) == "STRING", F.try_variant_get("_j.v", path, "string"))
    bare = F.when(c("_j.kind") == "STRING", F.try_variant_get("_j.any", "$", "string"))
    d = d.select("*", once(text("$.content").alias("content"), F.try_variant_get("_j.v", "$.metadata", "variant").alias("metadata")).alias("_t"))
    content, metadata = c("_t.content"), c("_t.metadata")
    wrapped = F.to_json(F.map_concat(F.coalesce(F.try_variant_get(F.when(F.schema_of_variant(metadata).startswith("OBJECT"), metadata), "$", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("auto_wrapped"), F.lit("true"))))
    contexts = F.transform(F.coalesce(F.try_variant_get("_j.v", "$.contexts", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    identity = F.concat_ws("|", *_IS)
    error = F.when(F.coalesce("payload", F.lit("")) == "", "empty payload").when(F.coalesce(own_pages(c("source_uri"), ".ledger"), F.lit(False)), "self-consumption: the ledger's own page")
    return d.select(
        "seq", "adapter", "source_id", "source_kind", "source_uri", "idempotency_key", "trust_tier", "transform_policy", "payload", F.left(F.sha2(identity, 256), F.lit(32)).alias("observe_id"),
        F.coalesce(content, bare, "payload").alias("content"), F.when(content.isNull(), "text/plain").otherwise(F.coalesce(text("$.mime_type"), text("$.mime"), F.lit("application/json"))).alias("mime_type"),
        F.when(content.isNull(), c("appended_at")).otherwise(F.coalesce(text("$.occurred_at"), "appended_at")).alias("occurred_at"), F.when(content.isNull(), wrapped).otherwise(F.when(metadata.isNotNull(), F.to_json(metadata))).alias("metadata"),
        F.filter(contexts, lambda x: x.isNotNull()).alias("contexts"), "appended_at", error.alias("error"),
    )


def drained(outbox: DataFrame, before: dict[str, DataFrame] | None = None, facts: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables' new rows for one batch of the outbox, given what the tables have (``before``).

    Of rows with one (adapter, source_id, idempotency_key) the first by seq counts.  Every observation waits in the queue, and gives an action; a text that takes something back
    gives a correction and a signal, which names ``facts`` (fact_id, subject, object, session_id, age_days, archived) that it may be about.
    """
    before = before or {}
    new = lambda name, rows: rows.join(before[name].select(*KEYS[name]).distinct(), KEYS[name], "left_anti") if name in before else rows
    d = saved(drafts(outbox), "drafts")
    good = d.where("error is null").groupBy(*_IS).agg(F.min_by(F.struct(*[x for x in d.columns if x not in _IS]), "seq").alias("_x")).select(*_IS, "_x.*")
    good = saved(new("observations", good), "drained")
    sha = lambda x: F.sha2(x, 256)
    observations = good.select(
        "observe_id", "adapter", "source_id", "source_kind", "source_uri", "idempotency_key", "trust_tier", "transform_policy", "seq", "content", "mime_type", "occurred_at", "metadata",
        sha("content").alias("content_hash"), sha("payload").alias("raw_hash"), sha(F.concat_ws("|", "adapter", "source_uri", "idempotency_key")).alias("origin_hash"), F.col("adapter").alias("method"),
    )
    sources = good.groupBy("source_id").agg(F.min_by(F.struct("source_uri", "source_kind", "trust_tier"), "seq").alias("_x")).select("source_id", "_x.*")
    contexts = good.select("source_id", F.explode("contexts").alias("context_id")).distinct()
    queue = good.select("observe_id", "source_kind", F.lit(1).alias("priority"))
    actions = derived_actions(good.select("observe_id", "source_id", "source_uri", "source_kind", "occurred_at", F.col("appended_at").alias("captured_at"), F.col("content").alias("raw"), "adapter", F.col("seq").alias("adapter_sequence"), "metadata"), before.get("actions"))
    actions = actions.where("status = 'inserted'").select("action_id", "source_system", F.col("action_source_id").alias("source_id"), F.col("observe_id").alias("source_observe_id"), "who", "what_text", "when_ts", "project", "artifact_locations", "next_query_hint")
    session = F.coalesce(F.get_json_object("content", "$.session_id"), F.get_json_object("metadata", "$.session_id"))
    taken = saved(corrections_in(good.select(F.col("observe_id").alias("event_id"), session.alias("session_id"), F.col("content").alias("text")), "text"), "taken")  # few, and read for corrections and signals
    if facts is None:
        taken = taken.withColumn("related", F.array().cast("array<string>"))
        related = taken.select("event_id", F.lit("").alias("fact_id"), F.lit(0).alias("rank")).where("false")
    else:
        related = saved(related_facts(taken.select("event_id", "session_id", "text"), facts), "related")
        ids = related.groupBy("event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("fact_id").cast("string").alias("id")))), lambda x: x["id"]).alias("related"))  # five at most
        taken = taken.join(ids, "event_id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    corrections = taken.select("event_id", "session_id", "pattern", "retracted", "related", F.lit(True).alias("processed"))
    return {
        "observations": observations, "sources": new("sources", sources), "source_contexts": new("source_contexts", contexts), "queue": queue, "actions": actions, "corrections": corrections,
        "signals": correction_signals(taken.select("event_id", "retracted"), related), "dead_letters": d.where("error is not null").select("seq", "adapter", "source_id", "idempotency_key", "payload", "error"),
    }


# ----------------------------------------------------------------------------- the tables in a folder


def committed(spark: SparkSession, ledger: str) -> list[str]:
    """Names of the batches that were written as a whole."""
    return sorted(r.batch for r in spark.read.schema("batch string, name string, n long").parquet(f"{ledger}/commits").select("batch").distinct().collect()) if there(spark, f"{ledger}/commits") else []


def table(spark: SparkSession, ledger: str, name: str, batches: list[str] | None = None) -> DataFrame | None:
    """The rows of a table that committed batches wrote; folders of other batches aren't opened."""
    batches = committed(spark, ledger) if batches is None else batches
    return spark.read.parquet(*(f"{ledger}/{name}/batch={b}" for b in batches)) if batches else None


def write_batch(rows: DataFrame, batch: str, ledger: str, facts: DataFrame | None = None, written: Callable[[str], None] = lambda name: None) -> None:
    """Writes one batch: each table into a folder of the batch's name, then the commit record.

    A batch that runs again replaces its folders, which nobody has read: rows count as known by the committed batches alone.  ``written`` is told of each table when it is there.
    """
    spark = rows.sparkSession
    done = committed(spark, ledger)
    if batch in done:  # the stream's own record of the batch was lost after ours was written
        return
    known = {name: t for name in (*KEYS, "actions") if (t := table(spark, ledger, name, done)) is not None}
    with job(spark, "drain"):
        commit(spark, drained(rows, known, facts), batch, ledger, written)


def commit(spark: SparkSession, new: dict[str, DataFrame], batch: str, ledger: str, written: Callable[[str], None] = lambda name: None) -> None:
    """Writes the tables of a batch, one after the other, then its record."""
    counts = []
    for name, rows in new.items():
        path = f"{ledger}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        counts.append((batch, name, spark.read.schema(rows.schema).parquet(path).count()))
        written(name)
    record = spark.createDataFrame(counts, "batch string, name string, n long")
    record.coalesce(1).write.mode("append").parquet(f"{ledger}/commits")  # one file, so that it is there or not


def batch_name(spark: SparkSession, checkpoint: str, number: int) -> str:
    return f"{spark.read.text(f'{checkpoint}/metadata').select(F.get_json_object('value', '$.id')).first()[0]}-{number}"


def drain_tables(stream: DataFrame, ledger: str, checkpoint: str, facts: DataFrame | None = None, written: Callable[[str], None] = lambda name: None):
    """Drains a stream of the outbox into the tables of a ledger, until what is there is drained.

    A batch is named by the stream's id, which its checkpoint holds, and its number, so that a stream that starts over without its checkpoint writes batches of its own,
    in which what the ledger has isn't new.
    """

    def write(rows: DataFrame, number: int) -> None:
        write_batch(rows, batch_name(rows.sparkSession, checkpoint, number), ledger, facts, written)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
