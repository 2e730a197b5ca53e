"""Ledger tables as views over the given tables, each as a DataFrame and as the SQL that a check runs.

The ledger's clock is an argument everywhere; ``AS_OF`` is the one that the registered queries use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
AS_OF_SEC = 1_706_745_600
DAY = 86_400


class Tables:
    """The given tables of one folder, and the ledger tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        """A given table.  Texts that lie in fewer splits than there are cores are dealt out first, as most of the work is on them; a large table never is."""
        df, cores = self.spark.read.parquet(f"{self.dir}/{name}.parquet"), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df

    def facts(self) -> DataFrame:
        """Text facts: source - language - text, with synthetic confidence and age from the id."""
        d = self("documents")
        return d.select(
            F.col("doc_id").alias("fact_id"), F.col("source").alias("subject"), F.col("lang").alias("predicate"), F.col("text").alias("object"),
            (F.lit(0.5) + (F.col("doc_id") % 50) / F.lit(100.0)).alias("confidence"), ((F.col("doc_id") % 90)).alias("age_days"), (F.col("doc_id") % 11 == 0).alias("archived"),
        )

    def ranked_facts(self) -> DataFrame:
        """Text facts with what the ranking needs; the seconds are those of the clock ``AS_OF``."""
        d, k = self("documents"), F.col("doc_id")
        return d.select(
            k.alias("fact_id"), F.col("source").alias("subject"), F.col("lang").alias("predicate"), F.col("text").alias("object"), (F.lit(0.2) + (k % 80) / F.lit(100.0)).alias("confidence"),
            (k % 37 / F.lit(37.0)).alias("importance"), F.when(k % 10 == 0, F.lit(0)).otherwise(F.lit(30 * DAY)).cast("long").alias("half_life_sec"), (F.lit(AS_OF_SEC) - (k * 7919) % 700 * DAY).alias("reinforced_sec"),
            (k % 11 == 0).alias("archived"), k.alias("observe_id"),
        )

    def fact_contexts(self) -> DataFrame:
        """(fact_id, context_id): a fact belongs to its source and to its language."""
        d = self("documents")
        return d.select(F.col("doc_id").alias("fact_id"), F.col("source").alias("context_id")).unionByName(d.select(F.col("doc_id").alias("fact_id"), F.col("lang").alias("context_id")))

    def profiles(self) -> DataFrame:
        """Ranking profiles; the one of phase 2 is superseded."""
        k = F.col("r_regionkey")
        pick = lambda a, b, c: F.when(k == 0, F.lit(a)).when(k == 1, F.lit(b)).otherwise(F.lit(c))
        name = F.when(k == 0, "rp-phase3-default").when(k == 1, "rp-phase2-default").otherwise(F.concat(F.lit("rp-"), F.lower("r_name")))
        return self("region").select(name.alias("profile_id"), pick(1.2, 1.0, 0.5).alias("w1"), pick(0.15, 0.2, 0.5).alias("w2"), pick(0.1, 0.1, 0.0).alias("w3"), pick(0.1, 0.0, 0.5).alias("w4"), F.lit(100).alias("access_saturation"), F.when(k == 1, "rp-phase3-default").alias("superseded_by"))

    def wiki(self) -> DataFrame:
        """Pages about sources, with the days since they were written; some were never, for some the last attempt failed."""
        d = self("documents").groupBy("source").agg(F.max("doc_id").alias("n"))
        return d.select(F.concat(F.regexp_replace(F.lower("source"), "[^a-z0-9]+", "-"), F.lit(".md")).alias("path"), F.col("source").alias("title"), F.when(F.col("n") % 5 != 0, F.col("n") % 60).alias("synthesis_days"), (F.col("n") % 7 == 0).alias("failed"))

    def decaying(self) -> DataFrame:
        """Facts with importance, half-life and the seconds since they were last reinforced."""
        p = self("part")
        return p.select(
            F.col("p_partkey").alias("fact_id"), F.col("p_brand").alias("subject"), (F.col("p_retailprice") / F.lit(2500.0)).alias("importance"),
            ((F.col("p_partkey") * 7919) % 700 * DAY).alias("idle_sec"), F.when(F.col("p_size") == 1, F.lit(0)).otherwise(F.lit(30 * DAY)).cast("long").alias("half_life_sec"),
            (F.col("p_size") % 10 == 0).alias("pinned"), (F.lit(0.5) + (F.col("p_partkey") % 50) / F.lit(100.0)).alias("confidence"), (F.col("p_partkey") % 13 == 0).alias("archived"),
        )

    def claims(self) -> DataFrame:
        """Rival facts: each supplier claims to be its nation's capital."""
        s, n = self("supplier"), self("nation")
        return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("fact_id"), F.col("n_name").alias("subject"), F.lit("capital-of").alias("predicate"), F.col("s_name").alias("object"),
            F.round(F.floor(F.col("s_acctbal") / 1000) / F.lit(10.0), 1).alias("confidence"), (F.col("s_suppkey") % 40).alias("age_days"),
        )

    def accesses(self) -> DataFrame:
        """(fact_id, ts) of views and clicks."""
        return self("events").where(F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("fact_id"), "ts")

    def links(self) -> DataFrame:
        """Directed links from each turn to the next of its conversation."""
        c = self("conversations").select("conv_id", "turn")
        return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("a"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("b"), F.when(F.col("turn") % 2 == 0, "derived_from").otherwise("elaborates").alias("kind")
        )

    def nodes(self) -> DataFrame:
        return self("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id", "turn", (F.col("conv_id") % 120).alias("age_days"), (F.col("turn") % 5 == 4).alias("archived"))

    def actions(self) -> DataFrame:
        """The activity log."""
        e = self("events")
        return e.select(
            F.col("event_id").alias("action_id"), F.col("event_type").alias("source_system"), F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("p"), F.col("user_id") % 7)).alias("project"),
            "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"), "value", "props",
        )

    def action_log(self) -> DataFrame:
        """The activity log with what was done and JSON pointers to where it is; some of the JSON is broken."""
        e, k = self("events"), F.col("event_id")
        kind = F.col("event_type")
        system = F.when(kind == "view", "git").when(kind == "click", "obsidian").when(kind == "purchase", "memory").when(kind == "signup", "codex").otherwise("local-file")
        project = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("p"), F.col("user_id") % 7))
        pointer = (
            F.when(k % 6 == 1, F.concat(F.lit('{"git_ref":"r'), k % 97, F.lit('"}'))).when(k % 6 == 2, F.concat(F.lit('{"obsidian":{"vault":"v","relative_path":"n'), k % 50, F.lit('.md"}}')))
            .when(k % 6 == 3, F.concat(F.lit('{"memory_uri":"m'), k % 31, F.lit('"}'))).when(k % 6 == 4, F.concat(F.lit('{"file_path":"/f'), k % 13, F.lit('","git_ref":" "}'))).when(k % 6 == 5, "{broken").otherwise("{}")
        )
        what = F.concat(kind, F.lit(" of "), F.coalesce(project, F.lit("nothing")), F.lit(" for user "), "user_id")
        return e.select(k.alias("action_id"), system.alias("source_system"), F.concat(F.lit("s"), "user_id").alias("source_id"), project.alias("project"), what.alias("what_text"), "ts", pointer.alias("artifact_locations"))

    def outbox(self) -> DataFrame:
        """Events queued for the ledger: many share an idempotency key."""
        e = self("events")
        return e.select(
            F.col("event_id").alias("seq"), F.col("event_type").alias("adapter"), F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")), 256).alias("idempotency_key"),
            (F.col("event_id") % 9).alias("attempts"), (F.col("event_id") % 3 != 0).alias("drained"), (F.col("event_id") % 40).alias("age_days"),
        )

    def notes(self) -> DataFrame:
        """Pages as markdown notes: the menu's entries and the title are headings, paragraphs stand between blank lines."""
        text = F.regexp_replace("html", r"<(?:title|style|script)[^>]*>[^<]*(?:</p>[^<]*)?</(?:title|style|script)>|<!--[^>]*>", "")
        text = F.regexp_replace(F.regexp_replace(text, "<h1>", "\n\n# "), "<li>", "\n\n## ")
        text = F.regexp_replace(F.regexp_replace(text, "<br>|</li>|</h1>|</p>|<p>|<div[^>]*>|</div>|<article>|<footer>", "\n\n"), "<[^>]+>", "")
        return self("pages").select("page_id", "url", text.alias("text"))

    def questions(self) -> DataFrame:
        """What users asked, as it was said."""
        c = self("conversations").where(F.col("role") == "user")
        return c.select("conv_id", "turn", F.col("text").alias("question"))

    def observations(self) -> DataFrame:
        d = self("documents")
        return d.select(
            F.col("doc_id").alias("observe_id"), F.when(F.col("doc_id") % 3 == 0, "sensory").otherwise("local-file").alias("kind"), F.concat(F.lit("file://"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("source_uri"),
            F.sha2(F.col("text"), 256).alias("content_hash"), (F.col("doc_id") % 30).alias("age_days"),
        )


#: The same tables as SQL over the registered views.
SQL = {
    "ranked_facts": "select doc_id as fact_id, source as subject, lang as predicate, text as object, 0.2::double + (doc_id % 80) / 100.0::double as confidence, (doc_id % 37) / 37.0::double as importance, case when doc_id % 10 = 0 then 0 else 2592000 end::bigint as half_life_sec, 1706745600 - (doc_id * 7919) % 700 * 86400 as reinforced_sec, doc_id % 11 = 0 as archived, doc_id as observe_id from documents",
    "fact_contexts": "select doc_id as fact_id, source as context_id from documents union all select doc_id, lang from documents",
    "profiles": "select case r_regionkey when 0 then 'rp-phase3-default' when 1 then 'rp-phase2-default' else 'rp-' || lower(r_name) end as profile_id, case r_regionkey when 0 then 1.2 when 1 then 1.0 else 0.5 end::double as w1, case r_regionkey when 0 then 0.15 when 1 then 0.2 else 0.5 end::double as w2, case when r_regionkey <= 1 then 0.1 else 0.0 end::double as w3, case r_regionkey when 0 then 0.1 when 1 then 0.0 else 0.5 end::double as w4, 100 as access_saturation, case when r_regionkey = 1 then 'rp-phase3-default' end as superseded_by from region",
    "wiki": "select regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') || '.md' as path, source as title, case when n % 5 != 0 then n % 60 end as synthesis_days, n % 7 = 0 as failed from (select source, max(doc_id) as n from documents group by source)",
    "facts": "select doc_id as fact_id, source as subject, lang as predicate, text as object, 0.5::double + (doc_id % 50) / 100.0::double as confidence, doc_id % 90 as age_days, doc_id % 11 = 0 as archived from documents",
    "decaying": "select p_partkey as fact_id, p_brand as subject, p_retailprice / 2500.0::double as importance, (p_partkey * 7919) % 700 * 86400 as idle_sec, case when p_size = 1 then 0 else 2592000 end::bigint as half_life_sec, p_size % 10 = 0 as pinned, 0.5::double + (p_partkey % 50) / 100.0::double as confidence, p_partkey % 13 = 0 as archived from part",
    "claims": "select s_suppkey as fact_id, n_name as subject, 'capital-of' as predicate, s_name as object, round(floor(s_acctbal / 1000) / 10.0::double, 1) as confidence, s_suppkey % 40 as age_days from supplier join nation on s_nationkey = n_nationkey",
    "accesses": "select user_id as fact_id, ts from events where event_type in ('view', 'click')",
    "links": "select x.conv_id * 1000 + x.turn as a, x.conv_id * 1000 + x.turn + 1 as b, case when x.turn % 2 = 0 then 'derived_from' else 'elaborates' end as kind from conversations x join conversations y on x.conv_id = y.conv_id and y.turn = x.turn + 1",
    "nodes": "select conv_id * 1000 + turn as node, conv_id, turn, conv_id % 120 as age_days, turn % 5 = 4 as archived from conversations",
    "actions": "select event_id as action_id, event_type as source_system, case when user_id % 7 != 0 then 'p' || (user_id % 7) end as project, ts, strftime(ts, '%Y-%m-%d') as day, hour(ts)::int as hour, value, props from events",
    "action_log": "select event_id as action_id, case event_type when 'view' then 'git' when 'click' then 'obsidian' when 'purchase' then 'memory' when 'signup' then 'codex' else 'local-file' end as source_system, 's' || user_id as source_id, case when user_id % 7 != 0 then 'p' || (user_id % 7) end as project, event_type || ' of ' || case when user_id % 7 != 0 then 'p' || (user_id % 7) else 'nothing' end || ' for user ' || user_id as what_text, ts, case event_id % 6 when 1 then '{\"git_ref\":\"r' || (event_id % 97) || '\"}' when 2 then '{\"obsidian\":{\"vault\":\"v\",\"relative_path\":\"n' || (event_id % 50) || '.md\"}}' when 3 then '{\"memory_uri\":\"m' || (event_id % 31) || '\"}' when 4 then '{\"file_path\":\"/f' || (event_id % 13) || '\",\"git_ref\":\" \"}' when 5 then '{broken' else '{}' end as artifact_locations from events",
    "outbox": "select event_id as seq, event_type as adapter, sha256(user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d')) as idempotency_key, event_id % 9 as attempts, event_id % 3 != 0 as drained, event_id % 40 as age_days from events",
    "notes": r"select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(?:title|style|script)[^>]*>[^<]*(?:</p>[^<]*)?</(?:title|style|script)>|<!--[^>]*>', '', 'g'), '<h1>', chr(10) || chr(10) || '# ', 'g'), '<li>', chr(10) || chr(10) || '## ', 'g'), '<br>|</li>|</h1>|</p>|<p>|<div[^>]*>|</div>|<article>|<footer>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g') as text from pages",
    "questions": "select conv_id, turn, text as question from conversations where role = 'user'",
    "observations": "select doc_id as observe_id, case when doc_id % 3 = 0 then 'sensory' else 'local-file' end as kind, 'file://' || source || '/' || doc_id as source_uri, sha256(text) as content_hash, doc_id % 30 as age_days from documents",
}


def with_tables(body: str, *names: str) -> str:
    """``body`` behind the ledger tables that it names; a body that starts with ``with`` goes on with its own tables."""
    head = ",\n".join(f"{n} as ({SQL[n]})" for n in names)
    recursive = body.lstrip().startswith("recursive")
    body = body.lstrip().removeprefix("recursive").lstrip()
    lead = "with recursive " if recursive else "with "
    if body.startswith("with "):
        return f"{lead}{head}{', ' if head else ''}{body[5:]}"
    return f"{lead}{head} {body}" if head else body
