"""Questions and gaps: keys, repeated asks, clusters, facts that answer them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, STOP_WORDS, jaccard, question_key, question_tokens
from ..jobs.catalog import query
from ..sources.ledger import Tables

_KEY = r"sha256(trim(regexp_replace(regexp_replace(lower(question), '\s+', ' ', 'g'), '[?!.,;:]+$', '')))"
_PLAIN = "length({w}) > 2 and {w} not in (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def tokens_sql(x: str) -> str:
    """The tokens of a question as SQL."""
    pairs = f"flatten(list_transform(regexp_extract_all(s, '[{CJK}]+'), lambda r: case when length(r) < 2 then []::varchar[] else list_transform(range(1, length(r)), lambda k: substr(r, k, 2)) end))"
    other = f"list_filter(regexp_extract_all(s, '[^{CJK}]+'), lambda w: {_PLAIN.format(w='w')})"
    parts = f"case when regexp_matches(s, '[{CJK}]') then list_concat({pairs}, {other}) else list_filter([s], lambda w: {_PLAIN.format(w='w')}) end"
    return rf"list_distinct(flatten(list_transform(regexp_split_to_array(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s-]+', ' ', 'g'), '\s+'), lambda s: {parts})))"


@query(f"select conv_id, turn, {_KEY} as question_hash from questions", "questions")
def question_hash(t: Tables) -> DataFrame:
    """DOM-8."""
    return t.questions().select("conv_id", "turn", question_key(F.col("question")).alias("question_hash"))


_GAPS = f"with g as (select {_KEY} as question_hash, count(*) as ask_count, min(conv_id) as first_asked, max(conv_id) as last_asked from questions group by 1) "


def gaps(t: Tables) -> DataFrame:
    q = t.questions().withColumn("question_hash", question_key(F.col("question")))
    return q.groupBy("question_hash").agg(F.count(F.lit(1)).alias("ask_count"), F.min("conv_id").alias("first_asked"), F.max("conv_id").alias("last_asked"))


@query(_GAPS + "select * from g", "questions")
def gap_dedupe(t: Tables) -> DataFrame:
    """DOM-8, SNK-6: one row per question however it was put."""
    return gaps(t)


@query(_GAPS + "select question_hash, ask_count, case when last_asked % 3 = 0 then 'resolved' when last_asked % 3 = 1 then 'open' else 'dismissed' end as status from g order by case when last_asked % 3 = 1 then 0 when last_asked % 3 = 0 then 1 else 2 end, ask_count desc, question_hash limit 100", "questions")
def gap_listing(t: Tables) -> DataFrame:
    """DOM-8, SORT-2, FIL-3: open ones first, then resolved, then dismissed."""
    s = F.col("last_asked") % 3
    g = gaps(t).withColumn("status", F.when(s == 0, "resolved").when(s == 1, "open").otherwise("dismissed"))
    order = F.when(F.col("status") == "open", 0).when(F.col("status") == "resolved", 1).otherwise(2)
    return g.orderBy(order, F.desc("ask_count"), "question_hash").limit(100).select("question_hash", "ask_count", "status")


@query(_GAPS + "select count(*) as questions, sum(ask_count)::bigint as asks, count(*) filter (ask_count > 1) as repeated, max(ask_count) as most from g", "questions")
def gap_stats(t: Tables) -> DataFrame:
    """AGG-4."""
    return gaps(t).agg(F.count(F.lit(1)).alias("questions"), F.sum("ask_count").alias("asks"), F.count_if(F.col("ask_count") > 1).alias("repeated"), F.max("ask_count").alias("most"))


def match_facts(gaps_: DataFrame, facts: DataFrame, most_gaps: int = 20, most_facts: int = 500, least: int = 2, floor: float = 0.75, days: int = 7, best: int = 3) -> DataFrame:
    """Facts that may answer open gaps: a row per gap (problem_id, question, ask_count) and candidate, and one without a candidate for a gap that has none.

    The ``most_gaps`` most asked gaps meet the ``most_facts`` newest facts (fact_id, subject, predicate, object, confidence, age_days,
    archived) of at least the floor within the window; both bounds are the feature's own.  Tokens are joined, rows never crossed.
    """
    g = gaps_.orderBy(F.desc("ask_count"), "problem_id").limit(most_gaps).select("problem_id", "question", "ask_count")
    f = facts.where(~F.col("archived") & (F.col("confidence") >= floor) & (F.col("age_days") <= days)).orderBy("age_days", "fact_id").limit(most_facts)
    f = f.select("fact_id", F.explode(question_tokens(F.concat_ws(" ", "subject", "predicate", "object"))).alias("token"))
    q = g.select("problem_id", F.explode(question_tokens(F.col("question"))).alias("token"))
    m = q.join(f, "token").groupBy("problem_id", "fact_id").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least)
    rank = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.desc("overlap"), "fact_id"))
    return g.select("problem_id", "ask_count").join(m.withColumn("rank", rank).where(F.col("rank") <= best), "problem_id", "left")


@query(
    "with g as (select " + _KEY + " as problem_id, min(question) as question, count(*) as ask_count from questions group by 1), o as (select * from g order by ask_count desc, problem_id limit 20), "
    "n as (select * from facts where not archived and confidence >= 0.75 and age_days <= 7 order by age_days, fact_id limit 500), "
    "f as (select fact_id, unnest(" + tokens_sql("concat_ws(' ', subject, predicate, object)") + ") as token from n), q as (select problem_id, unnest(" + tokens_sql("question") + ") as token from o), "
    "m as (select problem_id, fact_id, count(*) as overlap from q join f using (token) group by all having count(*) >= 2), "
    "r as (select *, row_number() over (partition by problem_id order by overlap desc, fact_id) as rank from m qualify rank <= 3) select problem_id, ask_count, fact_id, overlap, rank::int as rank from o left join r using (problem_id)",
    "questions", "facts",
)
def fact_gap_matches(t: Tables) -> DataFrame:
    """SIM-7, JOIN-17, WIN-5: new facts that may answer the most asked questions."""
    q = t.questions().groupBy(question_key(F.col("question")).alias("problem_id")).agg(F.min("question").alias("question"), F.count(F.lit(1)).alias("ask_count"))
    return match_facts(q, t.facts())


@query(
    "with q as (select conv_id, turn, " + tokens_sql("question") + " as w from questions), l as (select *, lag(w) over (partition by conv_id order by turn) as b from q) "
    "select conv_id, turn, round(case when len(w) + len(b) = 0 then 0 else len(list_intersect(w, b)) / (len(w) + len(b) - len(list_intersect(w, b)))::double end, 6) as similarity from l where b is not null",
    "questions",
)
def adjacent_similarity(t: Tables) -> DataFrame:
    """WIN-8, SIM-4: each question beside the one before it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = t.questions().withColumn("w", question_tokens(F.col("question"))).withColumn("b", F.lag("w").over(w)).where("b is not null")
    return q.select("conv_id", "turn", F.round(jaccard(F.col("w"), F.col("b")), 6).alias("similarity"))


def greedy_clusters(rows: pd.DataFrame) -> pd.DataFrame:
    """Joins each question to the first cluster whose anchor is similar enough, the most asked and then the latest first.  Rows: key, asks, last, tokens."""
    least = 0.3
    rows = rows.sort_values(["asks", "last", "key"], ascending=[False, False, True])
    anchors: list[tuple[str, set]] = []
    shared: dict[str, set] = {}
    out = []
    for key, tokens in zip(rows["key"], map(set, rows["tokens"])):
        for name, anchor in anchors:
            if tokens and anchor and len(tokens & anchor) / len(tokens | anchor) >= least:
                shared[name] &= tokens
                break
        else:
            name = key
            anchors.append((key, tokens))
            shared[key] = set(tokens)
        out.append(name)
    return pd.DataFrame({"key": rows["key"], "cluster": out, "asks": rows["asks"], "shared": [",".join(sorted(shared[c])) for c in out]})


def curiosity(asked: DataFrame, most: int = 500, clusters: int = 10) -> DataFrame:
    """Clusters of gaps (key, question, asks, last): (cluster, total_asks, members, shared_tokens), the most asked ``clusters``; and those alone, with one member.

    The clustering is sequential by definition; ``most`` questions, the most asked, are its own bound.
    """
    top = asked.orderBy(F.desc("asks"), F.desc("last"), "key").limit(most).select("key", "asks", "last", question_tokens(F.col("question")).alias("tokens"), F.lit(True).alias("one"))
    found = top.groupBy("one").applyInPandas(greedy_clusters, "key string, cluster string, asks long, shared string")
    c = found.groupBy("cluster").agg(F.sum("asks").alias("total_asks"), F.count(F.lit(1)).alias("members"), F.first("shared").alias("shared_tokens"))
    return c.where("members > 1").orderBy(F.desc("total_asks"), "cluster").limit(clusters).unionByName(c.where("members = 1"))


@query()
def curiosity_clusters(t: Tables) -> DataFrame:
    """SIM-6: greedy clusters of what is asked most."""
    q = t.questions().withColumn("key", question_key(F.col("question")))
    return curiosity(q.groupBy("key").agg(F.count(F.lit(1)).alias("asks"), F.max("conv_id").alias("last"), F.min("question").alias("question")))


@query("select conv_id, turn, array_to_string(list_sort(" + tokens_sql("question") + "), ' ') as tokens from questions", "questions")
def question_token_sets(t: Tables) -> DataFrame:
    """SIM-5."""
    return t.questions().select("conv_id", "turn", F.array_join(F.sort_array(question_tokens(F.col("question"))), " ").alias("tokens"))
