"""Reflect and triage: garbage collection, decay, contradictions, health signals, audits, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.catalog import query
from ..sources.ledger import Tables
from .retrieval import decay

TOMBSTONE = 0.001
CAP = 100


@query("select kind, count(*) as observations, count(*) filter (kind = 'sensory' and age_days > 7) as to_delete from observations group by kind", "observations")
def sensory_gc_counts(t: Tables) -> DataFrame:
    """DOM-1: counted before anything goes."""
    return t.observations().groupBy("kind").agg(F.count(F.lit(1)).alias("observations"), F.count_if((F.col("kind") == "sensory") & (F.col("age_days") > 7)).alias("to_delete"))


def collected(observations: DataFrame, facts: DataFrame, links: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, facts, links) without sensory observations older than so many days, their facts, and links at either end of these."""
    gone = observations.where((F.col("kind") == "sensory") & (F.col("age_days") > days)).select("observe_id")
    dead = facts.join(gone, "observe_id", "left_semi").select("fact_id")
    l = links.join(dead.withColumnRenamed("fact_id", "a"), "a", "left_anti").join(dead.withColumnRenamed("fact_id", "b"), "b", "left_anti")
    return observations.join(gone, "observe_id", "left_anti"), facts.join(dead, "fact_id", "left_anti"), l


@query("with gone as (select observe_id from observations where kind = 'sensory' and age_days > 7) select (select count(*) from observations where observe_id not in (from gone)) as observations, (select count(*) from ranked_facts where observe_id not in (from gone)) as facts, (select count(*) from (select fact_id as a, fact_id + 1 as b from ranked_facts) where a not in (from gone) and b not in (from gone)) as links", "observations", "ranked_facts")
def cascade_survivors(t: Tables) -> DataFrame:
    """DOM-1: facts and links of deleted observations go with them."""
    f = t.ranked_facts().select("fact_id", "observe_id")
    o, f, l = collected(t.observations(), f, f.select(F.col("fact_id").alias("a"), (F.col("fact_id") + 1).alias("b")))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(o, "observations").crossJoin(n(f, "facts")).crossJoin(n(l, "links"))  # a row each


@query("select fact_id, 'stale' as archive_reason from decaying where not archived and not pinned and importance * case when half_life_sec > 0 then pow(0.5, idle_sec / half_life_sec::double) else 1.0 end < 0.001", "decaying")
def decay_tombstones(t: Tables) -> DataFrame:
    """DOM-2: facts that have decayed away."""
    d = t.decaying().where("not archived and not pinned")
    return d.where(F.col("importance") * decay(F.col("idle_sec"), F.col("half_life_sec")) < TOMBSTONE).select("fact_id", F.lit("stale").alias("archive_reason"))


@query("select adapter, count(*) as pruned from outbox where drained and age_days > 7 and attempts < 6 group by adapter", "outbox")
def outbox_prune(t: Tables) -> DataFrame:
    """DOM-4: drained long ago and never quarantined."""
    return t.outbox().where("drained and age_days > 7 and attempts < 6").groupBy("adapter").agg(F.count(F.lit(1)).alias("pruned"))


_LOSERS = "with w as (select *, first(fact_id) over (partition by subject, predicate order by confidence desc, age_days, fact_id desc) as winner from claims) "


@query(_LOSERS + "select fact_id, winner as replaced_by, 'contradicted' as archive_reason from w x where exists (select 1 from claims y where y.subject = x.subject and y.predicate = x.predicate and y.object != x.object and (y.confidence > x.confidence or (y.confidence = x.confidence and (y.age_days < x.age_days or (y.age_days = x.age_days and y.fact_id > x.fact_id)))))", "claims")
def contradiction_winners(t: Tables) -> DataFrame:
    """DOM-3, WIN-1: what loses, and to what."""
    from .lifecycle import arbitration

    return arbitration(t.claims())[0].where("replaced_by is not null").select("fact_id", "replaced_by", "archive_reason")


@query("select subject, predicate, count(distinct object) as objects, min(fact_id) as first_fact, max(confidence) as best from claims group by all having count(distinct object) > 1", "claims")
def contradiction_clusters(t: Tables) -> DataFrame:
    """DOM-3, AGG-3: one audit row per cluster."""
    c = t.claims().groupBy("subject", "predicate").agg(F.countDistinct("object").alias("objects"), F.min("fact_id").alias("first_fact"), F.max("confidence").alias("best"))
    return c.where("objects > 1")


@query("select x.subject, x.fact_id as a, y.fact_id as b from claims x join claims y on x.subject = y.subject and x.predicate = y.predicate and x.object != y.object and (x.confidence > y.confidence or (x.confidence = y.confidence and x.fact_id > y.fact_id))", "claims")
def contradiction_pairs(t: Tables) -> DataFrame:
    """JOIN-4, the literal form: rivals with the stronger first.  ``contradiction_winners`` gives the same verdicts without pairs."""
    c = t.claims()
    x, y = (c.select("subject", "predicate", *(F.col(n).alias(f"{n}_{k}") for n in ("object", "fact_id", "confidence"))) for k in "xy")
    stronger = (F.col("confidence_x") > F.col("confidence_y")) | ((F.col("confidence_x") == F.col("confidence_y")) & (F.col("fact_id_x") > F.col("fact_id_y")))
    return x.join(y, ["subject", "predicate"]).where((F.col("object_x") != F.col("object_y")) & stronger).select("subject", F.col("fact_id_x").alias("a"), F.col("fact_id_y").alias("b"))


def _found(df: DataFrame, kind: str, severity: str, ref: Column, message: Column, *order: Column) -> DataFrame:
    """The first ``CAP`` targets as signals (kind, severity, message, target_ref); the cap is the scanner's own."""
    return df.orderBy(*order).limit(CAP).select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), message.alias("message"), ref.alias("target_ref"))


def stuck_outbox(outbox: DataFrame, days: int = 1) -> DataFrame:
    """Rows (seq, adapter, age_days, drained, attempts) that wait longer and aren't quarantined."""
    o = outbox.where(~F.col("drained") & (F.col("attempts") <= 5) & (F.col("age_days") > days))
    return _found(o, "stuck_outbox", "warn", F.concat(F.lit("outbox:"), "seq"), F.format_string("outbox row seq=%d (adapter=%s) has been un-drained for %d days", F.col("seq").cast("long"), "adapter", F.col("age_days").cast("long")), F.desc("age_days"), F.col("seq"))


def stale_facts(facts: DataFrame, days: int = 90) -> DataFrame:
    """Facts (fact_id, subject, idle_sec, archived, pinned) that nothing has reinforced for so long."""
    f = facts.where(~F.col("archived") & ~F.col("pinned") & (F.col("idle_sec") > days * 86_400))
    return _found(f, "stale_fact", "info", F.concat(F.lit("fact:"), "fact_id"), F.format_string("fact (%s) has not been reinforced for %d seconds (> %dd)", "subject", F.col("idle_sec").cast("long"), F.lit(days)), F.desc("idle_sec"), F.col("fact_id"))


def unresolved(facts: DataFrame, days: int = 7) -> DataFrame:
    """Subjects with several objects of a predicate that can have one only, older than so many days."""
    from .lifecycle import contradictable

    c = facts.where((F.col("age_days") > days) & contradictable(F.col("subject"), F.col("predicate"))).groupBy("subject", "predicate").agg(F.countDistinct("object").alias("n"), F.max("age_days").alias("age")).where("n >= 2")
    return _found(c, "unresolved_contradiction", "warn", F.concat(F.lit("contradiction:"), "subject", F.lit("/"), "predicate"), F.format_string("%d active objects for (%s, %s)", "n", "subject", "predicate"), F.desc("age"), F.col("subject"), F.col("predicate"))


def orphan_facts(facts: DataFrame, links: DataFrame, accesses: DataFrame, since: Column, days: int = 30) -> DataFrame:
    """Facts older than so many days that no link (a, b) touches and that nobody looked at since then: one anti join on the union of all ids in use."""
    used = links.select(F.col("a").alias("fact_id")).unionByName(links.select(F.col("b").alias("fact_id"))).unionByName(accesses.where(F.col("ts") >= since).select("fact_id")).distinct()
    f = facts.where(~F.col("archived") & (F.col("age_days") > days)).join(used, "fact_id", "left_anti")
    return _found(f, "orphan_delta", "info", F.concat(F.lit("fact:"), "fact_id"), F.format_string("orphan fact (%s, %s): no links, no access in %dd", "subject", "predicate", F.lit(days)), F.desc("age_days"), F.col("fact_id"))


def stale_pages(pages: DataFrame, days: int = 30) -> DataFrame:
    """Pages (path, title, synthesis_days, failed) whose last attempt failed, that were never written, or too long ago."""
    p = pages.where(F.col("failed") | F.col("synthesis_days").isNull() | (F.col("synthesis_days") > days))
    reason = F.when(F.col("failed"), "last rebuild failed").when(F.col("synthesis_days").isNotNull(), F.format_string("last synthesis is older than %dd", F.lit(days))).otherwise("never synthesized")
    return _found(p, "stale_wiki", "info", F.concat(F.lit("wiki:"), "path"), F.concat(F.lit('wiki page "'), "title", F.lit('" is stale: '), reason), F.desc(F.coalesce("synthesis_days", F.lit(1 << 30))), F.col("path"))


_SINCE = "2024-01-02 00:00:00"


def _stuck(t: Tables) -> DataFrame:
    return stuck_outbox(t.outbox())


def _orphans(t: Tables) -> DataFrame:
    return orphan_facts(t.facts(), t.links(), t.accesses(), F.lit(_SINCE).cast("timestamp_ntz"))


_STUCK = "(select 'stuck_outbox' as kind, 'warn' as severity, 'outbox row seq=' || seq || ' (adapter=' || adapter || ') has been un-drained for ' || age_days || ' days' as message, 'outbox:' || seq as target_ref from outbox where not drained and attempts <= 5 and age_days > 1 order by age_days desc, seq limit 100)"
_STALE = "(select 'stale_fact' as kind, 'info' as severity, 'fact (' || subject || ') has not been reinforced for ' || idle_sec || ' seconds (> 90d)' as message, 'fact:' || fact_id as target_ref from decaying where not archived and not pinned and idle_sec > 90 * 86400 order by idle_sec desc, fact_id limit 100)"
_UNRES = "(select 'unresolved_contradiction' as kind, 'warn' as severity, n || ' active objects for (' || subject || ', ' || predicate || ')' as message, 'contradiction:' || subject || '/' || predicate as target_ref from (select subject, predicate, count(distinct object) as n, max(age_days) as age from claims where age_days > 7 and predicate = 'capital-of' group by all) where n >= 2 order by age desc, subject limit 100)"
_ORPH = f"(select 'orphan_delta' as kind, 'info' as severity, 'orphan fact (' || subject || ', ' || predicate || '): no links, no access in 30d' as message, 'fact:' || fact_id as target_ref from facts f where not archived and age_days > 30 and not exists (select 1 from links l where l.a = f.fact_id or l.b = f.fact_id) and not exists (select 1 from accesses a where a.fact_id = f.fact_id and a.ts >= timestamp '{_SINCE}') order by age_days desc, fact_id limit 100)"
_WIKI = "(select 'stale_wiki' as kind, 'info' as severity, 'wiki page \"' || title || '\" is stale: ' || case when failed then 'last rebuild failed' when synthesis_days is not null then 'last synthesis is older than 30d' else 'never synthesized' end as message, 'wiki:' || path as target_ref from wiki where failed or synthesis_days is null or synthesis_days > 30 order by coalesce(synthesis_days, 1 << 30) desc, path limit 100)"


@query(f"select * from {_STUCK}", "outbox")
def triage_stuck_outbox(t: Tables) -> DataFrame:
    """DOM-5, FIL-4."""
    return _stuck(t)


@query(f"select * from {_STALE}", "decaying")
def triage_stale_fact(t: Tables) -> DataFrame:
    """DOM-5."""
    return stale_facts(t.decaying())


@query(f"select * from {_UNRES}", "claims")
def triage_unresolved_contradiction(t: Tables) -> DataFrame:
    """DOM-5, FIL-10."""
    return unresolved(t.claims())


@query(f"select * from {_ORPH}", "facts", "accesses", "links")
def triage_orphan(t: Tables) -> DataFrame:
    """DOM-5, JOIN-6: no link and no late access."""
    return _orphans(t)


@query(f"select * from {_WIKI}", "wiki")
def triage_stale_wiki(t: Tables) -> DataFrame:
    """DOM-5, SORT-4: never written ones come first."""
    return stale_pages(t.wiki())


@query(f"select kind, severity, count(*) as n from (from {_STUCK} union all from {_STALE} union all from {_UNRES} union all from {_ORPH} union all from {_WIKI}) group by all", "outbox", "decaying", "claims", "facts", "accesses", "links", "wiki")
def triage_by_kind(t: Tables) -> DataFrame:
    """DOM-5/6: all scanners together."""
    u = _stuck(t).unionByName(stale_facts(t.decaying())).unionByName(unresolved(t.claims())).unionByName(_orphans(t)).unionByName(stale_pages(t.wiki()))
    return u.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


_VERDICT = "case when toxic = 1 then 'rejected' when quality = 1 then 'confirmed' when doc_id % 2 = 0 then 'refined' end"


def _verdicts(t: Tables) -> DataFrame:
    v = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "confirmed").when(F.col("doc_id") % 2 == 0, "refined")
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", v.alias("verdict"), F.least(F.lit(1.0), F.col("n_chars") / F.lit(10000.0)).alias("confidence"))


_VERDICTS = f"with v as (select l.doc_id, {_VERDICT} as verdict, least(1.0, n_chars / 10000.0::double) as confidence from labels l join (select doc_id as d, n_chars from documents) on d = l.doc_id) "


@query(_VERDICTS + "select count(*) as chains, count(verdict) as judged, count(*) filter (verdict = 'confirmed') as confirmed, count(*) filter (verdict = 'refined') as refined, count(*) filter (verdict = 'rejected') as rejected, round(count(*) filter (verdict in ('confirmed', 'refined')) / count(verdict)::double, 6) as positive_rate, round(avg(confidence) filter (verdict = 'confirmed'), 6) as confidence_confirmed from v")
def verdict_stats(t: Tables) -> DataFrame:
    """AGG-4/5, DOM-18."""
    v = F.col("verdict")
    s = _verdicts(t).agg(
        F.count(F.lit(1)).alias("chains"), F.count("verdict").alias("judged"), *(F.count_if(v == x).alias(x) for x in ("confirmed", "refined", "rejected")), F.round(F.avg(F.when(v == "confirmed", F.col("confidence"))), 6).alias("confidence_confirmed")
    )
    return s.withColumn("positive_rate", F.round(F.try_divide(F.col("confirmed") + F.col("refined"), F.col("judged")), 6))


#: What the scheduler's gate decides.
DECISIONS = ("skipped_below_entry", "skipped_hard_paused", "skipped_soft", "ran")


def gate(chains: DataFrame, paused: bool = False, paused_days: float | None = None, skips: int = 0) -> DataFrame:
    """One row: may another chain run?  chains (verdict, verdict_at), and the state that the last call left: a hard pause, the days since, and the soft skips in a row.

    Less than ten chains, judged or not: below entry, whatever the state.  A pause of less than seven days, or one without a date, holds; a longer one ends and
    the count of skips with it.  Of the ten chains judged last, by the time of the verdict, at least five, and half of them rejected: a soft skip; the fourth in a row is
    a hard pause.  ``paused`` and ``skips`` are the state to keep.  Verdicts of equal times go by verdict; other words than the three aren't judgements.
    """
    n = chains.agg(F.count(F.lit(1)).alias("chains"))
    v = F.col("verdict")
    last = chains.where(v.isNotNull()).orderBy(F.desc("verdict_at"), "verdict").limit(10).agg(*(F.count_if(v == x).alias(x) for x in ("confirmed", "refined", "rejected")))
    s = n.crossJoin(last).withColumn("judged", F.col("confirmed") + F.col("refined") + F.col("rejected"))  # a row each
    holds = paused and (paused_days is None or paused_days < 7)
    before = 0 if paused and not holds else skips
    bad = (F.col("judged") >= 5) & (F.col("rejected") >= 0.5 * F.col("judged"))
    entry = F.col("chains") < 10
    turned = ~entry & ~F.lit(holds) & bad
    decision = F.when(entry, DECISIONS[0]).when(F.lit(holds), DECISIONS[1]).when(bad & F.lit(before + 1 >= 4), DECISIONS[1]).when(bad, DECISIONS[2]).otherwise(DECISIONS[3])
    s = s.withColumn("decision", decision).withColumn("paused", F.when(entry, F.lit(paused)).otherwise(F.lit(holds) | (turned & F.lit(before + 1 >= 4))))
    return s.withColumn("skips", F.when(entry, F.lit(skips)).otherwise(F.when(turned, F.lit(before + 1)).otherwise(F.lit(before)))).select("chains", "judged", "rejected", "decision", "paused", "skips")


# written from the rule: the last ten judgements by the time they were given, then five of them and half
_GATE = (
    ", j as (select verdict from v where verdict is not null order by (doc_id * 7919) % 10007 desc, verdict limit 10), "
    "s as (select (select count(*) from v) as chains, count(*) as judged, count(*) filter (verdict = 'rejected') as rejected from j) "
)


@query(_VERDICTS + _GATE + "select *, case when chains < 10 then 'skipped_below_entry' when judged >= 5 and rejected * 2 >= judged then 'skipped_soft' else 'ran' end as decision, false as paused, case when chains >= 10 and judged >= 5 and rejected * 2 >= judged then 1 else 0 end as skips from s")
def recent_verdicts(t: Tables) -> DataFrame:
    """WIN-7, DOM-19: the scheduler's gate looks at the last ten judgements."""
    return gate(_verdicts(t).withColumn("verdict_at", F.col("doc_id") * 7919 % 10007))


def parsed_chains(replies: DataFrame) -> DataFrame:
    """Adds chain and confidence to a model's replies (reply): a JSON object, in fences or not, whose chain is text; confidence between 0 and 1; anything else is no chain."""
    bare = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    x = F.from_json(bare, "chain string, confidence double")
    r = replies.withColumn("_x", x).withColumn("chain", F.nullif(F.trim(F.col("_x.chain")), F.lit("")))
    return r.withColumn("confidence", F.when(F.col("chain").isNotNull(), F.least(F.greatest(F.coalesce("_x.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))).drop("_x")


@query("select doc_id, case when doc_id % 4 in (0, 1) then 'because of ' || source end as chain, case when doc_id % 4 in (0, 1) then least((doc_id % 15) / 10.0::double, 1.0) end as confidence from documents")
def chain_replies(t: Tables) -> DataFrame:
    """DOM-18: replies as they come: bare, in fences, cut off, without a chain."""
    k = F.col("doc_id")
    body = F.to_json(F.struct(F.concat(F.lit(" because of "), "source").alias("chain"), (k % 15 / F.lit(10.0)).alias("confidence")))
    reply = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 4 == 2, F.left(body, F.length(body) - 3)).otherwise('{"confidence":1}')
    return parsed_chains(t("documents").select("doc_id", reply.alias("reply"))).select("doc_id", "chain", "confidence")


def chain_list(chains: DataFrame, prefix: str) -> DataFrame:
    """The chain whose id (chain_id) starts with a prefix, with ``error`` where several do: a prefix must name one."""
    found = chains.where(F.col("chain_id").startswith(prefix))
    n = found.agg(F.count(F.lit(1)).alias("_n"))
    return found.crossJoin(n).withColumn("error", F.when(F.col("_n") > 1, "ambiguous")).drop("_n")


def seeds(facts: DataFrame, observations: DataFrame, budget: int = 3, days: int = 7, importing: str = "memory") -> DataFrame:
    """(subject, newest): the newest fact of each of the subjects that had facts last, ``budget`` or three at most.

    facts (fact_id, subject, observe_id, age_days, archived) of less than ``days`` days that aren't archived and whose observation (observe_id, adapter)
    didn't come by the adapter that imports in bulk.  Facts of one age go by the larger id, subjects by name.
    """
    f = facts.where(~F.col("archived") & (F.col("age_days") < days)).join(observations.where(F.col("adapter") != importing).select("observe_id"), "observe_id")
    s = f.groupBy("subject").agg(F.max_by("fact_id", F.struct(-F.col("age_days"), "fact_id")).alias("newest"), F.min("age_days").alias("_age"))
    return s.orderBy("_age", "subject").limit(min(budget, 3)).select("subject", "newest")


@query("select subject, max_by(fact_id, (-age_days, fact_id)) as newest from facts where not archived and age_days < 7 and fact_id % 5 != 0 group by subject order by min(age_days), subject limit 3", "facts")
def seed_subjects(t: Tables) -> DataFrame:
    """AGG-7, DOM-19: a fifth of the facts is imported."""
    o = t.observations().select("observe_id", F.when(F.col("observe_id") % 5 == 0, "memory").otherwise("local-file").alias("adapter"))
    return seeds(t.facts().withColumn("observe_id", F.col("fact_id")), o)


def digest(facts: DataFrame, gaps: DataFrame, pages: DataFrame, audits: DataFrame, days: int = 7, floor: float = 0.75, most: int = 25) -> DataFrame:
    """(section, id, headline, fact_ids): new sure facts by importance, gaps resolved, and pages written in the last days, ``most`` of each.

    facts (fact_id, subject, predicate, object, confidence, importance, age_days, archived); gaps (problem_id, question, ask_count, status, resolved_days,
    fact_id); pages (path, title, synthesis_days); audits (target_id, decided, id, input_fact_ids): of a page's the latest counts.
    """
    ids = lambda x: F.when(x.isNotNull(), F.array(x.cast("long"))).otherwise(F.array().cast("array<long>"))
    f = facts.where(~F.col("archived") & (F.col("confidence") >= floor) & (F.col("age_days") <= days)).orderBy(F.desc("importance"), "age_days", "fact_id").limit(most)
    f = f.select(F.lit("fact").alias("section"), F.col("fact_id").cast("string").alias("id"), F.format_string("%s %s %s (conf=%.2f)", "subject", "predicate", "object", "confidence").alias("headline"), ids(F.col("fact_id")).alias("fact_ids"))
    g = gaps.where((F.col("status") == "resolved") & (F.col("resolved_days") <= days)).orderBy(F.desc("ask_count"), "resolved_days", "problem_id").limit(most)
    g = g.select(F.lit("gap").alias("section"), F.col("problem_id").alias("id"), F.format_string('asked %dx "%s" (resolved)', "ask_count", "question").alias("headline"), ids(F.col("fact_id")).alias("fact_ids"))
    p = pages.where(F.col("synthesis_days") <= days).orderBy("synthesis_days", "path").limit(most)
    latest = audits.groupBy(F.col("target_id").alias("path")).agg(F.max_by("input_fact_ids", F.struct("decided", "id")).alias("_ids"))
    p = p.join(latest, "path", "left").select(F.lit("wiki").alias("section"), F.col("path").alias("id"), F.format_string("%s (%s) rebuilt", "title", "path").alias("headline"), F.coalesce("_ids", F.array().cast("array<long>")).alias("fact_ids"))
    return f.unionByName(g).unionByName(p)


def _digest(t: Tables) -> DataFrame:
    k = F.col("fact_id")
    f = t.ranked_facts().withColumn("age_days", k % 90)
    gaps = t.questions().where("turn = 0").select(F.concat(F.lit("g"), "conv_id").alias("problem_id"), "question", (F.col("conv_id") % 17 + 1).alias("ask_count"), F.when(F.col("conv_id") % 2 == 0, "resolved").otherwise("open").alias("status"), (F.col("conv_id") % 20).alias("resolved_days"), F.when(F.col("conv_id") % 3 == 0, F.col("conv_id")).alias("fact_id"))
    audits = t.ranked_facts().groupBy("subject", (k % 4).alias("decided")).agg(F.sort_array(F.collect_list("fact_id")).alias("input_fact_ids"), F.min("fact_id").alias("id"))
    return digest(f, gaps, t.wiki(), audits.select(F.concat("subject", F.lit(".md")).alias("target_id"), "decided", "id", "input_fact_ids"))


_DIGEST = (
    "with f as (select 'fact' as section, fact_id::varchar as id, subject || ' ' || predicate || ' ' || object || ' (conf=' || printf('%.2f', confidence) || ')' as headline, [fact_id] as ids from ranked_facts where not archived and confidence >= 0.75 and fact_id % 90 <= 7 order by importance desc, fact_id % 90, fact_id limit 25), "
    "g as (select 'gap' as section, 'g' || conv_id as id, 'asked ' || (conv_id % 17 + 1) || 'x \"' || question || '\" (resolved)' as headline, case when conv_id % 3 = 0 then [conv_id] else [] end as ids from questions where turn = 0 and conv_id % 2 = 0 and conv_id % 20 <= 7 order by conv_id % 17 desc, conv_id % 20, 'g' || conv_id limit 25), "
    "a as (select subject || '.md' as path, fact_id % 4 as decided, min(fact_id) as id, list(fact_id order by fact_id) as ids from ranked_facts group by 1, 2), l as (select path, max_by(ids, (decided, id)) as ids from a group by 1), "
    "p as (select 'wiki' as section, w.path as id, title || ' (' || w.path || ') rebuilt' as headline, coalesce(l.ids, []) as ids from (select * from wiki where synthesis_days <= 7 order by synthesis_days, path limit 25) w left join l on l.path = w.path), u as (from f union all from g union all from p) "
)


@query(_DIGEST + "select section, id, sha256(headline) as headline, len(ids)::int as n from u", "ranked_facts", "questions", "wiki")
def digest_sections(t: Tables) -> DataFrame:
    """DOM-10, SET-3: the digest's sections, 25 rows each."""
    return _digest(t).select("section", "id", F.sha2("headline", 256).alias("headline"), F.size("fact_ids").alias("n"))


@query(_DIGEST + "select string_agg(i::varchar, ',' order by i::varchar) as ids, count(*) as n from (select distinct unnest(ids) as i from u)", "ranked_facts", "questions", "wiki")
def digest_fact_ids(t: Tables) -> DataFrame:
    """DOM-10, SET-4: the ids that the digest carries, each once, sorted."""
    i = _digest(t).select(F.explode("fact_ids").alias("i")).select(F.col("i").cast("string").alias("i")).distinct()
    return i.agg(F.array_join(F.sort_array(F.collect_list("i")), ",").alias("ids"), F.count(F.lit(1)).alias("n"))


def recovered(runs: DataFrame, now: int, seconds: int = 3600) -> DataFrame:
    """Derivation runs (status, started, error): those that have run for longer than an hour have failed."""
    stuck = (F.col("status") == "running") & (F.col("started") < now - seconds)
    return runs.withColumn("error", F.when(stuck, "stale: the process ended").otherwise(F.col("error"))).withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


@query("select case when s = 'running' and o_custkey < 1000 then 'failed' else s end as status, count(*) as n from (select o_custkey, case o_orderstatus when 'O' then 'running' when 'F' then 'succeeded' else 'failed' end as s from orders) group by 1")
def stale_runs(t: Tables) -> DataFrame:
    """DOM-22: orders as derivation runs."""
    s = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed")
    r = recovered(t("orders").select(s.alias("status"), F.col("o_custkey").alias("started"), F.lit(None).cast("string").alias("error")), 1000 + 3600)
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select n_name as page, (select max(s_suppkey) from supplier s where s.s_nationkey = n.n_nationkey) as latest, (select arg_max(s_name, s_suppkey) from supplier s where s.s_nationkey = n.n_nationkey) as audit from nation n")
def latest_audit_per_page(t: Tables) -> DataFrame:
    """JOIN-12: the newest audit row of every page."""
    s = t("supplier").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("latest"), F.max_by("s_name", "s_suppkey").alias("audit"))
    return t("nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("page"), "latest", "audit")


@query("select case when confidence >= 0.9 then 'high' when confidence >= 0.85 then 'firm' when confidence >= 0.75 then 'fair' else 'below' end as floor, count(*) as n from facts group by 1", "facts")
def decision_floors(t: Tables) -> DataFrame:
    """DOM-7, FIL-8, PRJ-2: facts by the audit's confidence floors."""
    c = F.col("confidence")
    return t.facts().groupBy(F.when(c >= 0.9, "high").when(c >= 0.85, "firm").when(c >= 0.75, "fair").otherwise("below").alias("floor")).agg(F.count(F.lit(1)).alias("n"))


@query("select (select count(*) from facts where archived) as archived, (select count(*) from facts where object is null or object = '') as empty_facts, (select count(*) from observations o where not exists (select 1 from facts f where f.fact_id = o.observe_id)) as bare_observations, (select count(*) from claims where confidence < 0 or confidence > 1) as bad_confidence, (select count(*) from outbox where attempts > 5) as quarantined", "facts", "observations", "claims", "outbox")
def integrity_counts(t: Tables) -> DataFrame:
    """AGG-1/14, DOM-22: five counts in one row."""
    f = t.facts().agg(F.count_if("archived").alias("archived"), F.count_if(F.col("object").isNull() | (F.col("object") == "")).alias("empty_facts"))
    o = t.observations().join(t.facts().select(F.col("fact_id").alias("observe_id")), "observe_id", "left_anti").agg(F.count(F.lit(1)).alias("bare_observations"))
    c = t.claims().agg(F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("bad_confidence"))
    q = t.outbox().agg(F.count_if(F.col("attempts") > 5).alias("quarantined"))
    return f.crossJoin(o).crossJoin(c).crossJoin(q)
