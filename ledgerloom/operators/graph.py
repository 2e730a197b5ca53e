"""The fact graph: links, neighbours, bounded traversal, orphans, components, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.catalog import query
from ..sources.ledger import AS_OF_SEC, Tables
from ..sources.scratch import saved
from .retrieval import bm25_best, fuse, keyword_lane, ranking_profile, rerank, top
from .sequences import connected


def reinforced(links: DataFrame) -> DataFrame:
    """One row per (a, b, kind): how often it was seen and its largest weight; loops and weights outside 0..1 are refused."""
    return links.where("a != b and weight between 0 and 1").groupBy("a", "b", "kind").agg(F.count(F.lit(1)).alias("observed_count"), F.max("weight").alias("weight"))


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def traverse(origins: DataFrame, links: DataFrame, depth: int = 3, direction: str = "out") -> DataFrame:
    """(origin, node, depth): the least distance of every node within ``depth`` steps; the origin itself has depth 0.

    Each step joins only the frontier, and meets the visited in an anti join, so cycles end and paths aren't enumerated.  A step's frontier is
    written, lest the next one computes it again.
    """
    edges = {"out": links.select("a", "b"), "in": links.select(F.col("b").alias("a"), F.col("a").alias("b")), "both": both_ways(links)}[direction].distinct()
    seen = origins.select(F.col("node").alias("origin"), "node", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.select("origin", F.col("node").alias("a")).join(edges, "a").select("origin", F.col("b").alias("node")).distinct()
        frontier = saved(step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(k)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; a node without links is its own component."""
    labels = connected(links.select("a", "b"), lambda df: saved(df, "stars")).withColumnRenamed("node", "_node")
    return nodes.select("node").distinct().join(labels, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("component"))


@query("select a, b, kind, count(*) as observed_count, max(weight) as weight from (select user_id % 50 as a, event_id % 50 as b, event_type as kind, value / 100.0::double as weight from events) where a != b and weight between 0 and 1 group by all")
def links_reinforced(t: Tables) -> DataFrame:
    """GRA-1: links that recur get stronger."""
    e = t("events").select((F.col("user_id") % 50).alias("a"), (F.col("event_id") % 50).alias("b"), F.col("event_type").alias("kind"), (F.col("value") / F.lit(100.0)).alias("weight"))
    return reinforced(e)


@query("select node, count(*) filter (d = 'out') as n_out, count(*) filter (d = 'in') as n_in from (select a as node, 'out' as d from links union all select b, 'in' from links) group by node", "links")
def links_by_direction(t: Tables) -> DataFrame:
    """GRA-2."""
    l = t.links()
    ends = l.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(l.select(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


@query("select node, string_agg(other::varchar, ',' order by other) as neighbors from (select a as node, b as other from links where kind = 'derived_from' union select b, a from links where kind = 'derived_from') group by node", "links")
def neighbors(t: Tables) -> DataFrame:
    """GRA-2: neighbours by kind, either direction."""
    l = both_ways(t.links().where("kind = 'derived_from'"))
    return l.groupBy("a").agg(F.array_join(F.transform(F.sort_array(F.collect_set("b")), lambda x: x.cast("string")), ",").alias("neighbors")).withColumnRenamed("a", "node")


@query("recursive with r as (select node as origin, node, 0 as depth from nodes where turn = 0 union select origin, b, depth + 1 from r join links on a = node where depth < 3) select origin, node, min(depth)::int as depth from r group by origin, node", "links", "nodes")
def bfs_depths(t: Tables) -> DataFrame:
    """GRA-3, SET-2, AGG-6: three steps from each opening turn."""
    return traverse(t.nodes().where("turn = 0"), t.links())


@query("recursive with e as (select a, b from links where kind != 'elaborates' union select b, a from links where kind != 'elaborates'), r as (select node as origin, node, 0 as depth from nodes where turn = 0 union select origin, b, depth + 1 from r join e on a = r.node where depth < 2) select origin, r.node, min(depth)::int as depth from r join nodes n on n.node = r.node where not n.archived group by origin, r.node", "links", "nodes")
def bfs_filtered_kinds(t: Tables) -> DataFrame:
    """GRA-3, JOIN-8/16: by kind and both directions; archived nodes are passed through, and left out at the end."""
    found = traverse(t.nodes().where("turn = 0"), t.links().where("kind != 'elaborates'"), 2, "both")
    return found.join(t.nodes().where("archived").select("node"), "node", "left_anti").select("origin", "node", "depth")


@query("select node from nodes n where not archived and age_days > 1 and not exists (select 1 from links l where l.a = n.node) and not exists (select 1 from links l where l.b = n.node)", "links", "nodes")
def orphans(t: Tables) -> DataFrame:
    """GRA-4, JOIN-5/7, SET-1: no link at either end."""
    return lone(t.nodes(), t.links())


def lone(nodes: DataFrame, links: DataFrame, days: int = 1) -> DataFrame:
    """Active nodes older than so many days without a link at either end; one anti join on the union of the ends."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return nodes.where(~F.col("archived") & (F.col("age_days") > days)).select("node").join(ends, "node", "left_anti")


_REACH = "recursive with e as (select a, b from links union select b, a from links), r as (select node, node as other from nodes union select r.node, e.b from r join e on e.a = r.other), c as (select node, min(other) as component from r group by node) "


@query(_REACH + "select node, component from c", "links", "nodes")
def components_by_min(t: Tables) -> DataFrame:
    """GRA-5."""
    return components(t.nodes(), t.links())


@query(_REACH + "select component, count(*) as n, min(age_days) as youngest_days from c join nodes using (node) group by component having min(age_days) > 90", "links", "nodes")
def stale_clusters(t: Tables) -> DataFrame:
    """GRA-6, AGG-8: components whose newest fact is older than 90 days."""
    c = components(t.nodes(), t.links()).join(t.nodes().select("node", "age_days"), "node")
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("age_days").alias("youngest_days")).where("youngest_days > 90")


@query(
    _REACH + ", o as (select count(*) as orphans from nodes n where not archived and age_days > 1 and not exists (select 1 from links l where l.a = n.node or l.b = n.node)) "
    "select (select count(*) from nodes where not archived) as active, (select count(*) from links) as links, (select orphans from o) as orphans, round((select count(*) from links) / (select count(*) from nodes where not archived)::double, 6) as density, (select count(distinct component) from c) as clusters", "links", "nodes",
)
def graph_snapshot(t: Tables) -> DataFrame:
    """GRA-7: one row of counts."""
    nodes, links = t.nodes(), t.links()
    active = nodes.agg(F.count_if(~F.col("archived")).alias("active"))
    n = links.agg(F.count(F.lit(1)).alias("links"))
    c = components(nodes, links).agg(F.countDistinct("component").alias("clusters"))
    o = lone(nodes, links).agg(F.count(F.lit(1)).alias("orphans"))
    return active.crossJoin(n).crossJoin(c).crossJoin(o).select("active", "links", "orphans", F.round(F.try_divide("links", "active"), 6).alias("density"), "clusters")  # a row each


@query("with s as (select day, count(*) as facts, sum(value) as value from actions group by day) select day, facts, facts - lag(facts) over (order by day) as delta from s", "actions")
def snapshot_delta(t: Tables) -> DataFrame:
    """WIN-4, WIN-10: one snapshot a day, beside the one before.  The window runs over one row per day."""
    s = t.actions().groupBy("day").agg(F.count(F.lit(1)).alias("facts"))
    return s.select("day", "facts", (F.col("facts") - F.lag("facts").over(Window.orderBy("day"))).alias("delta"))


@query("select a, b from links l where not exists (select 1 from nodes n where n.node = l.a and not archived) or not exists (select 1 from nodes n where n.node = l.b and not archived)", "links", "nodes")
def dangling_links(t: Tables) -> DataFrame:
    """JOIN-20: links with an end that isn't an active fact."""
    live = t.nodes().where("not archived").select("node").distinct()
    l = t.links().select("a", "b")
    l = l.join(live.select(F.col("node").alias("a"), F.lit(True).alias("has_a")), "a", "left").join(live.select(F.col("node").alias("b"), F.lit(True).alias("has_b")), "b", "left")
    return l.where("has_a is null or has_b is null").select("a", "b")


def candidates(found: DataFrame, reached: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, id, rrf) for seeds: a search's hits (query_id, id, score) and what the graph reaches (origin, node, depth), fused; the seed itself is left out."""
    graph = reached.where("node != origin").select(F.col("origin").alias("query_id"), F.col("node").alias("id"), (1 / (F.col("depth") + 1)).alias("score"))
    both = fuse({"retrieval": found, "graph": graph}).where("id != query_id").withColumn("rrf", F.round("rrf", 6))
    return top(both, most, "rrf", "id").select("query_id", "id", "rrf")


def _fact_links(t: Tables) -> DataFrame:
    """Links between text facts: to the one 7 further, and to the one 3 further if it is of the same kind."""
    f = t.ranked_facts().select(F.col("fact_id").alias("a"))
    return f.select("a", (F.col("a") + 7).alias("b"), F.lit("elaborates").alias("kind")).unionByName(f.select("a", (F.col("a") + 3).alias("b"), F.when(F.col("a") % 2 == 0, "contradicts").otherwise("derived_from").alias("kind")))


_CANDIDATES = (
    "recursive with q as (select fact_id as query_id, left(object, 200) as text from ranked_facts where fact_id % 50 = 0), "
    r"qt as (select query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1))) as term from q), "
    r"d as (select fact_id as doc, regexp_extract_all(lower(concat_ws(' ', subject, predicate, object)), '[\p{L}\p{N}_]+') as w from ranked_facts where not archived), "
    "stats as (select count(*) as n, avg(len(w)) as mean from d), p as (select doc, len(w) as length, unnest(w) as term from d), "
    "tf as (select doc, term, count(*) as tf, any_value(length) as length from p where term in (select term from qt) group by doc, term), df as (select term, count(*) as df from tf group by term), "
    "bm as (select query_id, doc, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as bm25 from qt join tf using (term) join df using (term) cross join stats group by query_id, doc), "
    "kw as (select query_id, doc as id, 1.0::double / row_number() over (partition by query_id order by bm25 desc, doc) as keyword from bm qualify row_number() over (partition by query_id order by bm25 desc, doc) <= 200), "
    "n as (select fact_id, count(*) as n from accesses where fact_id in (select id from kw) group by fact_id), "
    "rk as (select query_id, d.fact_id as id, round(1.2 * keyword + 0.15 * case when half_life_sec > 0 then pow(0.5, (1706745600 - reinforced_sec) / half_life_sec::double) else 1.0 end + 0.1 * least(1.0, ln(1 + coalesce(n, 0)) / ln(101.0::double)) + 0.1 * importance, 6) as score from ranked_facts d join kw on d.fact_id = kw.id left join n on n.fact_id = d.fact_id where not archived), "
    "l1 as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from rk qualify rank <= 50), "
    "lk as (select fact_id as a, fact_id + 7 as b from ranked_facts union all select fact_id, fact_id + 3 from ranked_facts where fact_id % 2 != 0), "
    "e as (select a, b from lk where b in (select fact_id from ranked_facts)), "
    "r as (select fact_id as origin, fact_id as node, 0 as depth from ranked_facts where fact_id % 50 = 0 union select origin, b, depth + 1 from r join e on a = node where depth < 2), "
    "g as (select origin, node, min(depth) as depth from r group by all), l2 as (select origin as query_id, node as id, row_number() over (partition by origin order by depth, node) as rank from g where node != origin), "
    "f as (select query_id, id, round(sum(1.0::double / (60 + rank)), 6) as rrf from (from l1 union all from l2) group by all having id != query_id), "
    "c as (select query_id, id, rrf from f qualify row_number() over (partition by query_id order by rrf desc, id) <= 10) "
)


def _reasoned(t: Tables) -> DataFrame:
    f = t.ranked_facts()
    seeds = f.where("fact_id % 50 = 0").select(F.col("fact_id").alias("query_id"), F.left("object", F.lit(200)).alias("text"))
    texts = f.where("not archived").select("fact_id", F.concat_ws(" ", "subject", "predicate", "object").alias("words"))
    found = saved(keyword_lane(bm25_best(texts, "fact_id", "words", seeds).withColumn("bm25", F.round("bm25", 6))), "found")  # used twice
    hits = rerank(fuse({"keyword": found}).withColumn("semantic", F.lit(0.0)), f, t.accesses(), ranking_profile(t.profiles()), AS_OF_SEC, 50)
    edges = _fact_links(t).where("kind != 'contradicts'").join(f.select(F.col("fact_id").alias("b")), "b", "left_semi")
    reached = traverse(seeds.select(F.col("query_id").alias("node")), edges, 2)
    return candidates(hits.select("query_id", F.col("fact_id").alias("id"), F.col("final_score").alias("score")), reached)


@query(_CANDIDATES + "select * from c", "ranked_facts", "accesses")
def reasoning_candidates(t: Tables) -> DataFrame:
    """GRA-8: per seed the ten best of the search for it and of what two steps reach."""
    return _reasoned(t)


def written_back(chains: DataFrame, used: DataFrame) -> DataFrame:
    """derived_from links of chains (chain_id, seed, chain) that say something and start from a fact, to the facts that they used (chain_id, fact_id)."""
    good = chains.where("chain is not null and seed is not null").select("chain_id", "seed")
    return good.join(used, "chain_id").where("seed != fact_id").select(F.col("seed").alias("a"), F.col("fact_id").alias("b"), F.lit("derived_from").alias("kind"), F.lit(1.0).alias("weight")).distinct()


@query(_CANDIDATES + "select query_id as a, id as b, 'derived_from' as kind from c where query_id % 100 != 0", "ranked_facts", "accesses")
def derived_links(t: Tables) -> DataFrame:
    """GRA-10: chains over the candidates; every second one came to nothing."""
    c = saved(_reasoned(t), "candidates")
    chains = c.select(F.col("query_id").alias("chain_id"), F.col("query_id").alias("seed"), F.when(F.col("query_id") % 100 != 0, "so").alias("chain")).distinct()
    return written_back(chains, c.select(F.col("query_id").alias("chain_id"), F.col("id").alias("fact_id"))).drop("weight")
