"""Analytics of the activity log: timelines, work patterns, pointers, coverage, routing."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import question_tokens
from ..jobs.catalog import query
from ..sources.ledger import Tables
from .lifecycle import _FLAT, clamp, flat, substring_score
from .questions import tokens_sql
from .sequences import with_previous


def window_of(expression: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """Half-open window in UTC: today, yesterday, this/last week (from Monday), this/last month, YYYY-MM-DD; last or past N days (1-365) up to now.

    The Chinese names of these are known too.  Anything else raises ValueError.
    """
    e, day = " ".join(expression.lower().split()), dt.datetime(now.year, now.month, now.day)
    one, monday, first = dt.timedelta(days=1), day - dt.timedelta(days=day.weekday()), day.replace(day=1)
    fixed = {
        "today": (day, day + one), "yesterday": (day - one, day), "this week": (monday, monday + 7 * one), "last week": (monday - 7 * one, monday),
        "this month": (first, (first + 32 * one).replace(day=1)), "last month": ((first - one).replace(day=1), first),
    }
    # The same windows in Chinese.
    names = {"今天": "today", "昨天": "yesterday", "本周": "this week", "上周": "last week", "本月": "this month", "上月": "last month"}
    if (e := names.get(e, e)) in fixed:
        return fixed[e]
    if (m := re.fullmatch(r"(?:last|past|最近) (\d{1,3}) (?:days|day|天)", e)) and 1 <= int(m[1]) <= 365:
        return now - int(m[1]) * one, now
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", e):
        d = dt.datetime.strptime(e, "%Y-%m-%d")
        return d, d + one
    raise ValueError(f"no time window: {expression!r}")


def in_window(actions: DataFrame, expression: str, now: dt.datetime) -> DataFrame:
    lo, hi = window_of(expression, now)
    return actions.where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))


_NOW = dt.datetime(2024, 1, 28, 12)
_LAST_WEEK = "ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-22'"


@query(f"select day, count(*) as n, count(distinct source_system) as sources from actions where {_LAST_WEEK} group by day", "actions")
def timeline_by_day(t: Tables) -> DataFrame:
    """DOM-12/13, AGG-2: actions a day in the last week."""
    return in_window(t.actions(), "last week", _NOW).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_system").alias("sources"))


@query(f"select source_system, count(*) as n from actions where {_LAST_WEEK} group by source_system order by n desc, source_system limit 20", "actions")
def timeline_source_counts(t: Tables) -> DataFrame:
    return in_window(t.actions(), "last week", _NOW).groupBy("source_system").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_system").limit(20)


@query(f"select coalesce(project, '(none)') as project, count(*) as n from actions where {_LAST_WEEK} group by 1 order by n desc, 1 limit 20", "actions")
def timeline_project_counts(t: Tables) -> DataFrame:
    return in_window(t.actions(), "last week", _NOW).groupBy(F.coalesce("project", F.lit("(none)")).alias("project")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project").limit(20)


@query(f"select count(*) as action_count, least(50, count(*)) as returned, count(distinct source_system) as sources, count(distinct coalesce(project, '(none)')) as projects from actions where {_LAST_WEEK}", "actions")
def timeline_totals(t: Tables) -> DataFrame:
    """DOM-13: how many actions a window has, and how many of them a listing of 50 returns."""
    n = F.count(F.lit(1))
    return in_window(t.actions(), "last week", _NOW).agg(n.alias("action_count"), F.least(F.lit(clamp(50, 500, 50)), n).alias("returned"), F.countDistinct("source_system").alias("sources"), F.countDistinct(F.coalesce("project", F.lit("(none)"))).alias("projects"))


# ------------------------------------------------------------------------------------------ patterns


def strength(days: Column, total: Column, least: Column | int) -> Column:
    """How sure a pattern is: strong, medium or provisional."""
    return F.when((days >= 14) & (total >= 2 * F.lit(least)), "strong").when((days >= 7) & (total >= F.lit(least)), "medium").otherwise("provisional")


def patterns(actions: DataFrame) -> DataFrame:
    """(kind, key, support_count, support_ratio, confidence) of actions (action_id, source_system, project, ts): five detectors, each a row at most.

    Two systems at least; an hour of the day, and a project, with at least three actions and a fifth, or a quarter, of all; three changes of project;
    two of the same change of system.  Changes count across midnight: rows meet the one before in time, hour by hour.
    """
    a = actions.select("action_id", "source_system", F.coalesce("project", F.lit("(none)")).alias("project"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH").alias("hour"))
    all_ = a.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("day").alias("days"), F.countDistinct("source_system").alias("sources"))

    def most(column: str, kind: str, share: float, least: int) -> DataFrame:
        best = a.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1).crossJoin(all_)  # a row each
        best = best.where((F.col("total") >= 3) & (F.col("n") >= 3) & (F.col("n") / F.col("total") >= share) & (F.col(column) != "(none)"))
        return best.select(F.lit(kind).alias("kind"), F.col(column).alias("key"), F.col("n").alias("support_count"), (F.col("n") / F.col("total")).alias("support_ratio"), strength(F.col("days"), F.col("total"), least).alias("confidence"))

    spread = all_.where("sources >= 2").select(F.lit("capture_spread").alias("kind"), F.col("sources").cast("string").alias("key"), F.col("total").alias("support_count"), F.lit(1.0).alias("support_ratio"), strength(F.col("days"), F.col("total"), F.when(F.col("sources") >= 4, 10).otherwise(20)).alias("confidence"))
    pairs = with_previous(a, [], F.date_trunc("hour", "ts"), ["ts", "action_id"], ["project", "source_system"]).where("before is not null")
    switches = pairs.where("project != before.project").agg(F.count(F.lit(1)).alias("n")).crossJoin(all_).where("n >= 3")
    follows = pairs.where("source_system != before.source_system").groupBy(F.concat_ws(" -> ", "before.source_system", "source_system").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    follows = follows.orderBy(F.desc("n"), "key").limit(1).crossJoin(all_).where("n >= 2")
    ratio = (F.col("n") / F.greatest(F.col("total") - 1, F.lit(1))).alias("support_ratio")
    row = lambda df, kind, key, least: df.select(F.lit(kind).alias("kind"), key.alias("key"), F.col("n").alias("support_count"), ratio, strength(F.col("days"), F.col("total"), least).alias("confidence"))
    found = [most("hour", "work_rhythm", 0.2, 10), most("project", "project_focus", 0.25, 12), row(switches, "project_switching", F.lit(""), 15), row(follows, "source_sequence", F.col("key"), 12)]
    for f in found:
        spread = spread.unionByName(f)
    return spread


_LEVEL = "case when days >= 14 and total >= 2 * {k} then 'strong' when days >= 7 and total >= {k} then 'medium' else 'provisional' end as confidence"


def _patterns_sql(where: str) -> str:
    return (
        f"with a as (select action_id, source_system, coalesce(project, '(none)') as project, ts, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%H') as hour from action_log where {where}), "
        "o as (select count(*) as total, count(distinct day) as days, count(distinct source_system) as sources from a), "
        "l as (select *, lag(project) over (order by ts, action_id) as bp, lag(source_system) over (order by ts, action_id) as bs from a), "
        "h as (select hour as key, count(*) as n from a group by 1 order by n desc, 1 limit 1), p as (select project as key, count(*) as n from a group by 1 order by n desc, 1 limit 1), "
        "w as (select count(*) as n from l where bp != project), q as (select bs || ' -> ' || source_system as key, count(*) as n from l where bs != source_system group by 1 order by n desc, 1 limit 1) "
        f"select 'capture_spread' as kind, sources::varchar as key, total as support_count, 1.0::double as support_ratio, case when sources >= 4 then case when days >= 14 and total >= 20 then 'strong' when days >= 7 and total >= 10 then 'medium' else 'provisional' end else case when days >= 14 and total >= 40 then 'strong' when days >= 7 and total >= 20 then 'medium' else 'provisional' end end as confidence from o where sources >= 2 "
        f"union all select 'work_rhythm', key, n, round(n / total::double, 6), {_LEVEL.format(k=10)} from h, o where total >= 3 and n >= 3 and n / total::double >= 0.2 "
        f"union all select 'project_focus', key, n, round(n / total::double, 6), {_LEVEL.format(k=12)} from p, o where n >= 3 and n / total::double >= 0.25 and key != '(none)' "
        f"union all select 'project_switching', '', n, round(n / (total - 1)::double, 6), {_LEVEL.format(k=15)} from w, o where n >= 3 "
        f"union all select 'source_sequence', key, n, round(n / (total - 1)::double, 6), {_LEVEL.format(k=12)} from q, o where n >= 2"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("support_ratio", F.round("support_ratio", 6))


@query(_patterns_sql("true"), "action_log")
def action_patterns(t: Tables) -> DataFrame:
    """DOM-14, WIN-2/3, AGG-12: the five detectors over the whole log."""
    return _rounded(patterns(t.action_log()))


@query(_patterns_sql("(hour(ts) between 8 and 10 or action_id % 40 = 0) and (project in ('p1', 'p2') or action_id % 9 = 0)"), "action_log")
def action_patterns_of_mornings(t: Tables) -> DataFrame:
    """DOM-14: a part of the log in which hours and projects stand out."""
    return _rounded(patterns(t.action_log().where("(hour(ts) between 8 and 10 or action_id % 40 = 0) and (project in ('p1', 'p2') or action_id % 9 = 0)")))


# ------------------------------------------------------------------------------------------ pointers, coverage, routes

# Systems that evidence comes from, those that a question is expected to be covered by, those whose actions need a durable pointer.
SYSTEMS = ("action_log", "memory", "obsidian", "git", "codex", "claude-code", "zsh", "local-file", "web", "roadmap")
EXPECTED = ("action_log", "memory", "obsidian", "git", "roadmap")
NEED_POINTER = ("codex", "claude-code", "local-file")
# Pointers of an action, the system that each is in, and what a route by it is worth.
POINTERS = [("memory", "memory_uri", 0.23), ("git", "git_ref", 0.2), ("codex", "codex_session_file", 0.12), ("claude-code", "claude_transcript_path", 0.12), ("local-file", "file_path", 0.1)]


def _pointer(name: str) -> Column:
    """A pointer's text; null where it is missing, empty or no text."""
    return F.nullif(F.trim(F.get_json_object("artifact_locations", f"$.{name}")), F.lit(""))


def _note() -> Column:
    return F.coalesce(_pointer("obsidian.vault"), _pointer("obsidian.relative_path"), _pointer("obsidian.path"))


def pointer_issues_of(actions: DataFrame) -> DataFrame:
    """(action_id, source_system, issue, severity, missing_system): pointers that an action (source_system, artifact_locations: JSON) should have; broken JSON has none."""
    system = F.col("source_system")
    durable = F.coalesce(_note(), *(_pointer(name) for _, name, _ in POINTERS))
    issue = lambda when, kind, severity, missing: F.when(when, F.struct(F.lit(kind).alias("issue"), F.lit(severity).alias("severity"), F.lit(missing).alias("missing_system")))
    found = F.array(
        issue((system == "git") & _pointer("git_ref").isNull(), "missing_git_ref", "error", "git"), issue((system == "obsidian") & _note().isNull(), "missing_obsidian_pointer", "error", "obsidian"),
        issue((system == "memory") & _pointer("memory_uri").isNull(), "missing_memory_uri", "error", "memory"), issue(system.isin(*NEED_POINTER) & durable.isNull(), "missing_durable_pointer", "warning", "artifact"),
    )
    return actions.select("action_id", "source_system", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("action_id", "source_system", "x.*")


def _json(name: str) -> str:
    return f"nullif(trim(case when json_valid(artifact_locations) then json_extract_string(artifact_locations, '$.{name}') end), '')"


_ISSUES = (
    f"with a as (select action_id, source_system, {_json('git_ref')} as git, {_json('memory_uri')} as mem, {_json('file_path')} as file, coalesce({_json('obsidian.vault')}, {_json('obsidian.relative_path')}) as note from action_log), "
    "i as (select action_id, source_system, case when source_system = 'git' and git is null then 'missing_git_ref' when source_system = 'obsidian' and note is null then 'missing_obsidian_pointer' when source_system = 'memory' and mem is null then 'missing_memory_uri' "
    "when source_system in ('codex', 'local-file') and coalesce(git, mem, file, note) is null then 'missing_durable_pointer' end as issue from a) "
)


@query(_ISSUES + "select action_id, source_system, issue, case when issue = 'missing_durable_pointer' then 'warning' else 'error' end as severity from i where issue is not null", "action_log")
def pointer_issues(t: Tables) -> DataFrame:
    """DOM-15, FIL-9."""
    return pointer_issues_of(t.action_log()).drop("missing_system")


@query(_ISSUES + "select source_system, issue, count(*) as n from i where issue is not null group by all", "action_log")
def pointer_issue_counts(t: Tables) -> DataFrame:
    return pointer_issues_of(t.action_log()).groupBy("source_system", "issue").agg(F.count(F.lit(1)).alias("n"))


def matched(actions: DataFrame, questions: DataFrame, most: int = 20, timeline: bool = False) -> DataFrame:
    """(question_id, score, rank and the action's columns): the actions that say most about each question (question_id, text), a block that every task can hold; the latest first among equals.

    A question about a time (``timeline``) takes the latest actions as they are, with score 1.
    """
    words = F.concat_ws(" ", "source_system", "source_id", F.coalesce("project", F.lit("")), "what_text", "artifact_locations")
    q = questions.select("question_id", F.col("text").alias("_q"), question_tokens(F.col("text")).alias("_w"))
    s = actions.withColumn("_t", flat(words)).crossJoin(F.broadcast(q))
    s = s.withColumn("score", F.lit(1) if timeline else substring_score(F.col("_t"), F.col("_q"), F.col("_w"))).where("score > 0").drop("_t", "_q", "_w")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("ts"), F.desc("action_id")))
    return s.withColumn("rank", rank).where(F.col("rank") <= clamp(most, 200, 20))


def evidence(found: DataFrame) -> DataFrame:
    """(question_id, action_id, system, ref, bonus, score, rank, project, what_text): where the matched actions point to, themselves among it."""
    place = lambda system, ref, bonus: F.struct(F.lit(system).alias("system") if isinstance(system, str) else system.alias("system"), ref.alias("ref"), F.lit(bonus).alias("bonus"))
    note = F.concat_ws("/", _pointer("obsidian.vault"), _pointer("obsidian.relative_path"))
    note = F.coalesce(F.nullif(note, F.lit("")), _pointer("obsidian.path"))
    all_ = F.array(place("obsidian", note, 0.25), *(place(s, _pointer(n), b) for s, n, b in POINTERS), place(F.when(F.col("source_system").isin(*SYSTEMS[1:-1]), F.col("source_system")), F.col("source_id"), 0.08), place("action_log", F.col("action_id").cast("string"), 0.02))
    e = found.select("question_id", "action_id", "score", "rank", "project", "what_text", F.posexplode(F.filter(all_, lambda x: x["ref"].isNotNull() & x["system"].isNotNull())).alias("k", "x"))
    return e.select("question_id", "action_id", "x.system", "x.ref", "x.bonus", "score", "rank", "k", "project", "what_text")


def coverage(found: DataFrame, questions: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(question_id, system, evidence_count, refs, is_gap): of every system, how much evidence there is and the three best; a gap is an expected one without any.

    ``docs`` (question_id, ref, score) are documents that say something about it.
    """
    e = evidence(found).groupBy("question_id", "action_id", "system", "ref").agg(F.max("score").alias("score"), F.min("rank").alias("rank")).drop("action_id")
    if docs is not None:
        e = e.unionByName(docs.select("question_id", F.lit("roadmap").alias("system"), "ref", "score", F.lit(1 << 30).alias("rank")))
    best = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "rank", "ref"))), 1, 3), lambda x: x["ref"])
    n = e.groupBy("question_id", "system").agg(F.count(F.lit(1)).alias("evidence_count"), F.array_join(best, ",").alias("refs"))
    all_ = questions.select("question_id", F.explode(F.array(*map(F.lit, SYSTEMS))).alias("system"))
    return all_.join(n, ["question_id", "system"], "left").select("question_id", "system", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), F.coalesce("refs", F.lit("")).alias("refs"), (F.col("system").isin(*EXPECTED) & F.col("evidence_count").isNull()).alias("is_gap"))


def confidence_of(score: Column, bonus: Column) -> Column:
    return F.least(F.lit(0.98), F.round(0.4 + F.log1p(score) / 5 + bonus, 2))


def routes(found: DataFrame, docs: DataFrame | None = None, timeline: bool = False, most: int = 10) -> DataFrame:
    """(question_id, system, ref, confidence, evidence_count, label, rank): where to look for an answer: pointers of the matched actions, and documents, which are worth 0.74 at most.

    Equal places are one: their evidence adds up, the surest row says the rest.  A question about a time goes to the activity log itself first.
    """
    e = evidence(found).select("question_id", "system", "ref", confidence_of(F.col("score"), F.col("bonus")).alias("confidence"), F.lit(1).alias("n"), F.col("what_text").alias("label"), "rank", "k")
    if docs is not None:
        e = e.unionByName(docs.select("question_id", F.lit("repo-docs").alias("system"), "ref", F.least(F.lit(0.74), confidence_of(F.col("score"), F.lit(0.02))).alias("confidence"), F.lit(1).alias("n"), F.col("label"), F.lit(1 << 30).alias("rank"), F.lit(0).alias("k")))
    if timeline:
        e = e.unionByName(found.groupBy("question_id").agg(F.count(F.lit(1)).cast("int").alias("n")).select("question_id", F.lit("action_log").alias("system"), F.lit("action_log:window").alias("ref"), F.lit(0.99).alias("confidence"), "n", F.lit("Use matched action_log rows for this time-window question.").alias("label"), F.lit(0).alias("rank"), F.lit(0).alias("k")))
    first = F.max_by("label", F.struct("confidence", -F.col("rank"), -F.col("k")))
    r = e.groupBy("question_id", "system", "ref").agg(F.max("confidence").alias("confidence"), F.sum("n").alias("evidence_count"), first.alias("label"), F.min("rank").alias("_at"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("confidence"), F.desc("evidence_count"), "_at", "system", "ref"))
    return r.withColumn("rank", place).where(F.col("rank") <= clamp(most, 50, 10)).drop("_at")


_QUESTIONS = ["purchase of p3", "signup of p1 for user 7", "nothing that anybody did"]
_MATCHED = (
    "with q as (select unnest([0, 1, 2]) as question_id, unnest(['" + "', '".join(_QUESTIONS) + "']) as text), t as (select question_id, " + _FLAT.format(x="text") + " as phrase, " + tokens_sql("text") + " as w from q), "
    "a as (select *, " + _FLAT.format(x="concat_ws(' ', source_system, source_id, coalesce(project, ''), what_text, artifact_locations)") + " as t from action_log), "
    "s as (select a.* exclude (t), question_id, case when contains(t, phrase) then len(w) + 5 else 0 end + len(list_filter(w, lambda x: contains(t, x))) as score from a, t), "
    "m as (select *, row_number() over (partition by question_id order by score desc, ts desc, action_id desc) as rank from s where score > 0 qualify rank <= 20), "
    f"e as (select question_id, action_id, score, rank, what_text, unnest(['obsidian', 'memory', 'git', 'local-file', source_system, 'action_log']) as system, unnest([concat_ws('/', {_json('obsidian.vault')}, {_json('obsidian.relative_path')}), {_json('memory_uri')}, {_json('git_ref')}, {_json('file_path')}, source_id, action_id::varchar]) as ref, unnest([0.25, 0.23, 0.2, 0.1, 0.08, 0.02])::double as bonus, unnest([1, 2, 3, 4, 5, 6]) as k from m), "
    "f as (select * from e where ref is not null and ref != '') "
)


def _asked(t: Tables) -> DataFrame:
    return t.spark.range(len(_QUESTIONS)).select(F.col("id").cast("int").alias("question_id"), F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col("id") + 1).cast("int")).alias("text"))


@query(
    _MATCHED + ", d as (select question_id, system, ref, max(score) as score, min(rank) as rank from f group by question_id, action_id, system, ref), n as (select question_id, system, count(*) as evidence_count from d group by all), "
    "y as (select question_id, unnest(['" + "', '".join(SYSTEMS) + "']) as system from q) select question_id, system, coalesce(evidence_count, 0) as evidence_count, system in ('" + "', '".join(EXPECTED) + "') and evidence_count is null as is_gap from y left join n using (question_id, system)", "action_log",
)
def coverage_systems(t: Tables) -> DataFrame:
    """DOM-16, WIN-5: which systems have evidence for questions, and which expected ones have none."""
    return coverage(matched(t.action_log(), _asked(t)), _asked(t)).drop("refs")


@query(
    _MATCHED + ", c as (select *, least(0.98, round(0.4 + ln(1 + score) / 5 + bonus, 2)) as confidence from f), r as (select question_id, system, ref, max(confidence) as confidence, count(*) as evidence_count, max_by(what_text, (confidence, -rank, -k)) as label, min(rank) as at_ from c group by all) "
    "select question_id, system, ref, confidence, evidence_count, label, row_number() over (partition by question_id order by confidence desc, evidence_count desc, at_, system, ref)::int as rank from r qualify rank <= 10", "action_log",
)
def route_candidates(t: Tables) -> DataFrame:
    """DOM-17, AGG-13: where to look for the answers of questions."""
    return routes(matched(t.action_log(), _asked(t)))


@query("select action_id from actions a where not exists (select 1 from accesses x where x.fact_id = a.action_id)", "actions", "accesses")
def underived_actions(t: Tables) -> DataFrame:
    """JOIN-9: what no later table has taken up yet."""
    return t.actions().select("action_id").join(t.accesses().select(F.col("fact_id").alias("action_id")), "action_id", "left_anti")
