"""The ledger's write side in batch form: appends, queues, leases, cursors, expiry, coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.catalog import query
from ..sources.ledger import Tables

QUARANTINE_AFTER = 5


def append_new(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Events whose (adapter, idempotency_key) is new to the ledger, the earliest of each; nothing that is there is touched."""
    key = ["adapter", "idempotency_key"]
    first = events.groupBy(*key).agg(F.min(F.struct("seq", *[c for c in events.columns if c not in (*key, "seq")])).alias("x")).select(*key, "x.*")
    return first if ledger is None else first.join(ledger.select(*key).distinct(), key, "left_anti")


@query("select adapter, idempotency_key, min(seq) as seq from outbox group by all", "outbox")
def outbox_dedupe(t: Tables) -> DataFrame:
    """SNK-1, STR-4."""
    return append_new(t.outbox().select("adapter", "idempotency_key", "seq"))


@query("select adapter, idempotency_key, min(seq) as seq from outbox o where not drained and not exists (select 1 from outbox d where d.drained and d.adapter = o.adapter and d.idempotency_key = o.idempotency_key) group by all", "outbox")
def outbox_drain_batch(t: Tables) -> DataFrame:
    """STR-1: what a drain would write now."""
    o = t.outbox().select("adapter", "idempotency_key", "seq", "drained")
    return append_new(o.where("not drained").drop("drained"), o.where("drained"))


@query("select seq, attempts + 1 as attempts, attempts + 1 > 5 as quarantined from outbox where not drained", "outbox")
def outbox_quarantine(t: Tables) -> DataFrame:
    """STR-2: after one more failure."""
    return t.outbox().where("not drained").select("seq", (F.col("attempts") + 1).alias("attempts"), (F.col("attempts") + 1 > 5).alias("quarantined"))


@query("select o_orderkey as id, row_number() over (order by o_orderpriority, o_orderkey) as place from orders where o_orderstatus = 'O' and o_orderkey % 5 != 0 qualify place <= 50")
def lease_claimable(t: Tables) -> DataFrame:
    """STR-3, SORT-8: the head of the queue: free of leases, by priority, then first in, first out."""
    o = t("orders").where("o_orderstatus = 'O' and o_orderkey % 5 != 0").orderBy("o_orderpriority", "o_orderkey").limit(50)
    return o.select(F.col("o_orderkey").alias("id"), F.row_number().over(Window.orderBy("o_orderpriority", "o_orderkey")).cast("long").alias("place"))  # 50 rows


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as updated_at from events where ts > timestamp '2024-01-15 12:00:00' order by ts, event_id limit 1000")
def cursor_batch(t: Tables) -> DataFrame:
    """STR-5, SRC-8: a batch of 1000 behind the cursor."""
    e = t("events").where("ts > timestamp_ntz'2024-01-15 12:00:00'").orderBy("ts", "event_id").limit(1000)
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("select seq, 30 - age_days as days_left from outbox where 30 - age_days < 3", "outbox")
def ttl_prune(t: Tables) -> DataFrame:
    """STR-10."""
    return t.outbox().select("seq", (30 - F.col("age_days")).alias("days_left")).where("days_left < 3")


@query("select seq, case when attempts = 0 then 0 else (least(1440, pow(2, attempts - 1)) * 60)::bigint end as wait_sec from outbox", "outbox")
def backoff_schedule(t: Tables) -> DataFrame:
    """STR-12: no wait before the first failure, then doubling minutes up to a day."""
    wait = (F.least(F.lit(1440.0), F.pow(F.lit(2.0), F.col("attempts") - 1)) * 60).cast("long")
    return t.outbox().select("seq", F.when(F.col("attempts") == 0, F.lit(0).cast("long")).otherwise(wait).alias("wait_sec"))


@query("with p as (select user_id as pair_id, count(*) filter (event_type = 'purchase') as committed, count(*) filter (event_type = 'view') as pending from events group by 1) select pair_id, committed, pending from p where committed > 0 and pending > 0")
def queue_pair_fragments(t: Tables) -> DataFrame:
    """AGG-11, DOM-24, STR-11: pairs of which only one half is written."""
    return fragments(t("events").select(F.col("user_id").alias("pair_id"), (F.col("event_type") == "purchase").alias("done"), F.col("event_type").isin("purchase", "view").alias("counts")).where("counts"))


def fragments(writes: DataFrame) -> DataFrame:
    """(pair_id, committed, pending) of pairs (pair_id, done) of which some writes are done and others aren't."""
    p = writes.where("pair_id is not null").groupBy("pair_id").agg(F.count_if("done").alias("committed"), F.count_if(~F.col("done")).alias("pending"))
    return p.where("committed > 0 and pending > 0")


def paired(invalidations: DataFrame, memories: DataFrame) -> DataFrame:
    """Writes in two phases (pair_id, kind, place): of every pair the invalidation comes before what replaces it; a pair without either half is left out."""
    both = invalidations.select("pair_id").distinct().join(memories.select("pair_id").distinct(), "pair_id")
    return both.select("pair_id", F.posexplode(F.array(F.lit("invalidate"), F.lit("remember"))).alias("place", "kind"))


@query("select o_orderkey as pair_id, unnest(['invalidate', 'remember']) as kind, unnest([0, 1]) as place from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') and o_orderstatus = 'F'")
def paired_writes(t: Tables) -> DataFrame:
    """STR-11: what was returned is invalidated before it is written again."""
    gone = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("pair_id"))
    return paired(gone, t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pair_id")))


def released(outbox: DataFrame, ids: DataFrame) -> DataFrame:
    """Quarantined rows that ``ids`` (seq) names start anew, without attempts; others stay."""
    hit = ids.select("seq").distinct().withColumn("_hit", F.lit(True))
    return outbox.join(hit, "seq", "left").withColumn("attempts", F.when(F.col("_hit") & (F.col("attempts") > QUARANTINE_AFTER), 0).otherwise(F.col("attempts"))).drop("_hit")


@query("select seq, case when attempts > 5 and seq % 2 = 0 then 0 else attempts end as attempts from outbox where not drained", "outbox")
def outbox_release(t: Tables) -> DataFrame:
    """STR-2: some of the quarantined rows are released by hand."""
    o = t.outbox().where("not drained").select("seq", "attempts")
    return released(o, o.where("seq % 2 = 0"))


def leased(jobs: DataFrame, now: int, worker: str, most: int = 1, seconds: int = 60) -> DataFrame:
    """Jobs (id, priority, token, lease_until, done) after a worker has taken ``most`` of them: not done, without a lease or with one that ran out, by priority, then first in, first out."""
    free = jobs.where(~F.col("done") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now))).orderBy("priority", "id").limit(most)
    mine = free.select("id", F.concat_ws(":", F.lit(worker), "id").alias("_token"))
    j = jobs.join(mine, "id", "left")
    return j.withColumn("token", F.coalesce("_token", "token")).withColumn("lease_until", F.when(F.col("_token").isNotNull(), F.lit(now + seconds)).otherwise(F.col("lease_until"))).drop("_token")


def finished(jobs: DataFrame, tokens: DataFrame, now: int, done: bool = True, seconds: int = 60) -> DataFrame:
    """Jobs whose token is among ``tokens`` are done, or keep their lease for longer (``done`` false: a heartbeat); a token that has run out or is another's changes nothing."""
    hit = tokens.select("token").distinct().withColumn("_hit", F.lit(True))
    j = jobs.join(hit, "token", "left").withColumn("_now", F.coalesce(F.col("_hit") & (F.col("lease_until") > now) & ~F.col("done"), F.lit(False)))
    j = j.withColumn("done", F.col("done") | F.col("_now")) if done else j.withColumn("lease_until", F.when(F.col("_now"), F.lit(now + seconds)).otherwise(F.col("lease_until")))
    return j.drop("_hit", "_now").select(jobs.columns)


@query("with j as (select o_orderkey as id, o_orderpriority as priority, o_orderstatus = 'F' as done, case when o_orderkey % 5 = 0 then 100 when o_orderkey % 5 = 1 then 200 end as lease_until from orders), m as (select id from j where not done and (lease_until is null or lease_until <= 150) order by priority, id limit 40) select id, case when id in (select id from m) then 'w:' || id end as token, case when id in (select id from m) then 210 else lease_until end as lease_until from j where not done")
def lease_claims(t: Tables) -> DataFrame:
    """STR-3: forty jobs are taken; leases that ran out are free again."""
    k = F.col("o_orderkey")
    j = t("orders").select(k.alias("id"), F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("token"), F.when(k % 5 == 0, 100).when(k % 5 == 1, 200).alias("lease_until"), (F.col("o_orderstatus") == "F").alias("done"))
    return leased(j, 150, "w", 40).where("not done").select("id", "token", "lease_until")


def covered(expected: DataFrame, captured: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, expected, captured, coverage, target, met) of items (source, item) that a source should have, and that were captured; a source without items has no coverage and meets its target."""
    got = captured.select("source", "item").distinct().withColumn("_got", F.lit(1))
    c = expected.select("source", "item").distinct().join(got, ["source", "item"], "left").groupBy("source").agg(F.count(F.lit(1)).alias("expected"), F.count("_got").alias("captured"))
    c = targets.join(c, "source", "left").select("source", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("captured", F.lit(0)).alias("captured"), "target")
    ratio = F.try_divide("captured", "expected")
    return c.select("source", "expected", "captured", F.round(ratio, 6).alias("coverage"), "target", F.coalesce(ratio >= F.col("target"), F.lit(True)).alias("met"))


@query("with e as (select distinct event_type as source, user_id as item from events), g as (select distinct event_type as source, user_id as item from events where event_id % 4 = 0 and event_type != 'error'), c as (select source, count(*) as expected, count(g.item) as captured from e left join g using (source, item) group by 1) select source, expected, captured, round(captured / expected::double, 6) as coverage, case when source = 'view' then 0.99 else 0.2 end::double as target, captured / expected::double >= case when source = 'view' then 0.99 else 0.2 end as met from c")
def coverage_ratio(t: Tables) -> DataFrame:
    """AGG-17: captured over expected, per source, against its target."""
    e = t("events").select("event_id", F.col("event_type").alias("source"), F.col("user_id").alias("item"))
    targets = e.select("source").distinct().withColumn("target", F.when(F.col("source") == "view", 0.99).otherwise(0.2))
    return covered(e, e.where("event_id % 4 = 0 and source != 'error'"), targets)


def nearest_rank(df: DataFrame, group: str, value: str, points: tuple[float, ...]) -> DataFrame:
    """The smallest value whose rank is at least p times the count: counts of distinct values, then a running sum, no interpolation."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(group)
    c = counts.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    return c.groupBy(group).agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("n")), F.col(value))).alias(f"p{int(p * 100)}") for p in points))


@query("with r as (select l_returnflag as flag, l_quantity as v, row_number() over (partition by l_returnflag order by l_quantity) as k, count(*) over (partition by l_returnflag) as n from lineitem) select flag, min(v) filter (k >= ceil(0.5 * n)) as p50, min(v) filter (k >= ceil(0.9 * n)) as p90, min(v) filter (k >= ceil(0.99 * n)) as p99 from r group by flag")
def nearest_rank_percentiles(t: Tables) -> DataFrame:
    """AGG-15."""
    return nearest_rank(t("lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity"), "flag", "l_quantity", (0.5, 0.9, 0.99))


@query("with d as (select strftime(ts, '%Y-%m-%d') as day, avg(value) as mean from events group by 1) select day, round(mean, 6) as mean, mean / (select min(mean) from d) > 1.5 as regressed from d")
def regression_ratio(t: Tables) -> DataFrame:
    """AGG-16: against the baseline, more than half as much again fails."""
    d = t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("mean"))
    base = d.agg(F.min("mean").alias("base"))
    return d.crossJoin(F.broadcast(base)).select("day", F.round("mean", 6).alias("mean"), (F.col("mean") / F.col("base") > 1.5).alias("regressed"))


def trimmed(df: DataFrame, group: str, value: str, share: float = 0.02) -> DataFrame:
    """Rows without the lowest and the highest ``share`` of each group's values, rounded down; places come from counts of values, not from a sort of a whole group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(group)
    c = counts.withColumn("_upto", F.sum("_k").over(w.orderBy(value))).withColumn("_n", F.sum("_k").over(w))
    cut = F.floor(F.col("_n") * share)
    kept = F.least("_upto", F.col("_n") - cut) - F.greatest(F.col("_upto") - F.col("_k"), cut)
    return c.withColumn("_left", kept).where("_left > 0").select(group, value, F.explode(F.sequence(F.lit(1), F.col("_left"))).alias("_i")).drop("_i")


@query("with r as (select event_type, value as v, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events where value is not null), t as (select event_type, v, row_number() over (partition by event_type order by v) as k, count(*) over (partition by event_type) as n from r where k > floor(n * 0.02) and k <= n - floor(n * 0.02)) select event_type, min(v) filter (k >= ceil(0.5 * n)) as p50, min(v) filter (k >= ceil(0.9 * n)) as p90, min(v) filter (k >= ceil(0.95 * n)) as p95, min(v) filter (k >= ceil(0.99 * n)) as p99 from t group by 1")
def trimmed_percentiles(t: Tables) -> DataFrame:
    """AGG-15: nearest ranks without the lowest and the highest 2 %."""
    return nearest_rank(trimmed(t("events").select("event_type", "value"), "event_type", "value"), "event_type", "value", (0.5, 0.9, 0.95, 0.99))


def active(registry: DataFrame) -> DataFrame:
    """(family, policy_id) of a registry (family, policy_id, effective, supersedes): of every family the latest policy that no other supersedes."""
    gone = registry.where("supersedes is not null").select(F.col("supersedes").alias("policy_id")).distinct()
    return registry.join(gone, "policy_id", "left_anti").groupBy("family").agg(F.max_by("policy_id", F.struct("effective", "policy_id")).alias("policy_id"))


@query("select p_brand as family, max_by(p_partkey, (p_size, p_partkey)) as policy_id from part where p_partkey not in (select p_partkey - 1 from part where p_size = 50) group by 1")
def active_policies(t: Tables) -> DataFrame:
    """DOM-23: parts as policies; those of size 50 supersede the one before."""
    p = t("part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("policy_id"), F.col("p_size").alias("effective"), F.when(F.col("p_size") == 50, F.col("p_partkey") - 1).alias("supersedes"))
    return active(p)


def own_pages(uri: Column, folder: str) -> Column:
    """Whether a source is a page that the ledger has written itself, under ``folder``."""
    return uri.rlike(rf"^file://.*/{re.escape(folder)}/wiki/.*\.md$")


@query("select seq, adapter, case when regexp_matches(uri, '^file://.*/\\.ledger/wiki/.*\\.md$') then 6 else attempts end as attempts from (select event_id as seq, event_type as adapter, event_id % 9 as attempts, case event_id % 4 when 0 then 'file:///h/.ledger/wiki/a' || event_id || '.md' when 1 then 'file:///h/.ledger/wiki/a.txt' when 2 then 'file:///h/notes/wiki/a.md' else 'https://h/.ledger/wiki/a.md' end as uri from events) where true")
def self_consumption_guard(t: Tables) -> DataFrame:
    """FIL-6/7: the ledger doesn't read what it has written: such rows are quarantined at once."""
    k = F.col("event_id")
    uri = F.when(k % 4 == 0, F.concat(F.lit("file:///h/.ledger/wiki/a"), k, F.lit(".md"))).when(k % 4 == 1, "file:///h/.ledger/wiki/a.txt").when(k % 4 == 2, "file:///h/notes/wiki/a.md").otherwise("https://h/.ledger/wiki/a.md")
    return t("events").select(k.alias("seq"), F.col("event_type").alias("adapter"), F.when(own_pages(uri, ".ledger"), F.lit(QUARANTINE_AFTER + 1)).otherwise(k % 9).alias("attempts"))


def chunk_facts(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(chunk_id, fact): the first fact of the observation that names the chunk, else the observation's first fact, else ``orphan:`` and the observation.

    chunks (chunk_id, observe_id), facts (fact_id, observe_id, source_chunk_ids).
    """
    named = facts.select("observe_id", "fact_id", F.explode("source_chunk_ids").alias("chunk_id")).groupBy("observe_id", "chunk_id").agg(F.min("fact_id").alias("_named"))
    first = facts.groupBy("observe_id").agg(F.min("fact_id").alias("_first"))
    c = chunks.join(named, ["observe_id", "chunk_id"], "left").join(first, "observe_id", "left")
    return c.select("chunk_id", F.coalesce(F.col("_named").cast("string"), F.col("_first").cast("string"), F.concat(F.lit("orphan:"), "observe_id")).alias("fact"))


@query("with c as (select doc_id as chunk_id, doc_id // 4 as observe_id from documents), f as (select doc_id as fact_id, doc_id // 4 as observe_id, [doc_id - 1, doc_id + 1] as ids from documents where doc_id % 3 = 0 and doc_id // 4 % 5 != 0), n as (select observe_id, chunk_id, min(fact_id) as named from (select observe_id, fact_id, unnest(ids) as chunk_id from f) group by all), s as (select observe_id, min(fact_id) as first from f group by 1) select chunk_id, coalesce(named::varchar, first::varchar, 'orphan:' || observe_id) as fact from c left join n using (observe_id, chunk_id) left join s using (observe_id)")
def chunk_first_fact(t: Tables) -> DataFrame:
    """JOIN-18/11: each chunk's fact, one row each."""
    d = t("documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("observe_id"))
    facts = d.where("doc_id % 3 = 0 and observe_id % 5 != 0").select(F.col("doc_id").alias("fact_id"), "observe_id", F.array(F.col("doc_id") - 1, F.col("doc_id") + 1).alias("source_chunk_ids"))
    return chunk_facts(d.select(F.col("doc_id").alias("chunk_id"), "observe_id"), facts)
