"""Streaming queries over the given tables, run to the end of what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.catalog import query
from ..sources.ledger import Tables
from ..sources.scratch import new_folder
from ..streaming.drain import breaker_states, drain, sessions
from ..streaming.tables import drain_tables, table
from .text_ops import _CORRECTED


@query("select adapter, idempotency_key, min(seq) as seq from outbox group by all", "outbox")
def stream_outbox_drain(t: Tables) -> DataFrame:
    """STR-1/4: the outbox drained as a stream into a ledger that has each key once."""
    schema = t("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")), 256)
    out = stream.select(F.col("event_id").alias("seq"), F.col("event_type").alias("adapter"), key.alias("idempotency_key"))
    to = new_folder(t.spark, "ledger")
    drain(out, f"{to}/rows", f"{to}/progress").awaitTermination()
    return t.spark.read.parquet(f"{to}/rows").select("adapter", "idempotency_key", "seq")


@query()
def circuit_breaker(t: Tables) -> DataFrame:
    """STR-9: calls by event type; those of small value fail; an hour's window as the calls are sparse."""
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("double")
    calls = t("events").select(F.col("event_type").alias("site"), F.col("event_id").alias("id"), at.alias("at"), (F.col("value") > 40).alias("ok"))
    return breaker_states(calls, 3600, 1800)


@query("select user_id, strftime(time_bucket(interval '6 hours', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, sum(value)::double as value from (select user_id, ts, round(value)::bigint as value from events) group by all")
def tumbling_windows(t: Tables) -> DataFrame:
    """STR-13: six-hour windows a user."""
    e = t("events").select("user_id", "ts", F.round("value").cast("long").alias("value"))
    w = e.groupBy("user_id", F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("value"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "value")


@query(
    "with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as first from events), "
    "s as (select user_id, ts, sum(first) over (partition by user_id order by ts rows unbounded preceding) as k from o) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k"
)
def activity_sessions(t: Tables) -> DataFrame:
    """STR-13: sessions a user, with pauses of less than six hours; the same function takes a stream."""
    e = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = sessions(e, "6 hours")
    return s.select("user_id", F.date_format("session.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def ledger_outbox(docs: DataFrame) -> DataFrame:
    """Documents as outbox rows: two in five payloads are no JSON, some come from the ledger's own pages, copies share a key within their source."""
    k, c = F.col("doc_id"), F.col
    payload = F.when(k % 5 < 2, c("text")).otherwise(F.to_json(F.struct(c("text").alias("content"), F.lit("text/markdown").alias("mime_type"), F.array("lang").alias("contexts"), F.struct(c("source").alias("session_id")).alias("metadata"))))
    uri = F.when(k % 17 == 0, F.concat(F.lit("file:///h/.ledger/wiki/"), k, F.lit(".md"))).otherwise(F.concat(F.lit("file:///d/"), c("source"), F.lit(".txt")))
    return docs.select(
        k.alias("seq"), F.concat(F.lit("a"), k % 2).alias("adapter"), c("source").alias("source_id"), F.lit("local-file").alias("source_kind"), uri.alias("source_uri"), F.md5("text").alias("idempotency_key"), F.lit("user").alias("trust_tier"),
        F.lit("tp-1").alias("transform_policy"), payload.alias("payload"), F.lit("2024-02-01 00:00:00").alias("appended_at"),
    )


_LEDGER = (
    "with d as (select *, 'a' || (doc_id % 2) as adapter, md5(text) as key, case when doc_id % 17 = 0 then 'file:///h/.ledger/wiki/' || doc_id || '.md' else 'file:///d/' || source || '.txt' end as uri from documents), "
    "e as (select *, case when coalesce(text, '') = '' and doc_id % 5 < 2 then 'empty payload' when doc_id % 17 = 0 then 'self-consumption: the ledger''s own page' end as error from d), "
    "g as (select *, left(sha256(adapter || '|' || source || '|' || key), 32) as observe_id from e where error is null qualify row_number() over (partition by adapter, source, key order by doc_id) = 1), "
    "l as (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as line from g), "
    f"c as (select observe_id, {_CORRECTED} as pattern from g) "
    "select 'observations' as name, observe_id as key, sha256(text) as what from g union all select 'sources', source, min_by(uri, doc_id) from g group by source "
    "union all select distinct 'source_contexts', source, lang from g where doc_id % 5 >= 2 union all select 'queue', observe_id, 'local-file' from g "
    "union all select 'actions', observe_id, sha256(case when line = '' then adapter || ' observation from ' || uri when length(line) <= 1200 then line else left(line, 1197) || '...' end) from l "
    "union all select 'corrections', observe_id, pattern from c where pattern is not null union all select 'signals', 'correction_event:' || observe_id, 'info' from c where pattern is not null union all select 'dead_letters', doc_id::varchar, error from e where error is not null"
)


@query(_LEDGER)
def stream_ledger_tables(t: Tables) -> DataFrame:
    """STR-1, STR-7, COR-2, DOM-11: the outbox drained as a stream into the ledger's tables, each batch under one commit record."""
    docs = t.spark.readStream.schema(t("documents").schema).parquet(f"{t.dir}/documents.parque[t]")  # a pattern, as the table may be a file or a folder
    to = new_folder(t.spark, "ledger")
    drain_tables(ledger_outbox(docs), to, f"{to}/progress").awaitTermination()
    c, sha = F.col, lambda x: F.sha2(x, 256)
    shown = {
        "observations": (c("observe_id"), c("content_hash")), "sources": (c("source_id"), c("source_uri")), "source_contexts": (c("source_id"), c("context_id")), "queue": (c("observe_id"), c("source_kind")),
        "actions": (c("source_observe_id"), sha("what_text")), "corrections": (c("event_id"), c("pattern")), "signals": (c("target_ref"), c("severity")), "dead_letters": (c("seq").cast("string"), c("error")),
    }
    return reduce(DataFrame.unionByName, (table(t.spark, to, n).select(F.lit(n).alias("name"), k.alias("key"), w.alias("what")) for n, (k, w) in shown.items()))
