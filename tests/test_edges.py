"""Nulls in every column, empty texts and tables, ties and repeated rows, for the functions that take a user's DataFrames."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import activity, graph, ingest, ledger_ops, lifecycle, maintenance, questions, retrieval, similarity, text_ops
from ledgerloom.operators.sequences import connected
from ledgerloom.sources.scratch import saved

TEXTS = [(1, "alpha beta"), (2, None), (3, ""), (4, "alpha beta"), (None, "beta"), (5, "ÄÖ 数据库 x " * 3), (6, "word " * 50_000)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


@pytest.fixture(scope="module")
def none(texts):
    return texts.limit(0)


def test_text_functions_take_nulls_and_long_texts(texts):
    c = F.col("text")
    one = {
        "tokens": F.size(text.question_tokens(c)), "key": text.question_key(c), "chunks": F.size(text.chunks(c)), "sentences": text.first_sentences(c), "predicate": text.predicate(F.lit("x"), c),
        "normal": text.normalised(c), "correction": text.correction(c), "words": F.size(text.words(c)), "strip": text.strip(c), "uuid": text_ops.uuid5(c), "url": text.normal_url(c), "mime": ingest.mime(c), "slug": ingest.slug(c),
    }
    rows = {r.id: r for r in texts.select("id", *(x.alias(n) for n, x in one.items())).collect()}
    assert len(rows) == 7 and rows[6].chunks == 358 and rows[3].sentences == "" and rows[3].tokens == 0 and rows[2].key is None and rows[5].tokens == 2
    assert text.scrubbed(texts, "text").count() == text.scrubbed_json(texts, "text").count() == 7


def test_markdown_of_awkward_texts(texts, none):
    assert {r.id for r in text_ops.markdown_chunks(texts, "id", "text").collect()} == {1, 4, None, 5, 6} and text_ops.markdown_facts(texts, "id", "text").count() == 0
    assert text_ops.markdown_chunks(none, "id", "text").count() == 0


def test_keyword_search(spark, texts, none):
    q = spark.createDataFrame([(1, "Alpha, BETA"), (2, None), (3, "!"), (4, "zzz")], "query_id int, text string")
    got = retrieval.bm25(texts, "id", "text", q).collect()
    assert {(r.query_id, r.doc) for r in got} == {(1, 1), (1, 4), (1, None)} and len({r.bm25 for r in got if r.doc}) == 1
    assert retrieval.bm25(none, "id", "text", q).count() == 0 and retrieval.bm25(texts, "id", "text", q.limit(0)).count() == 0


def test_index_gives_the_scores_of_a_scan(spark, texts, tmp_path):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "word")], "query_id int, text string")
    docs = texts.where("id is not null and text is not null")
    retrieval.build_index(docs, "id", "text", str(tmp_path / "i"))
    scores = lambda df: sorted((r.query_id, r.doc, round(r.bm25, 9)) for r in df.collect())
    assert scores(retrieval.search_index(spark, str(tmp_path / "i"), q)) == scores(retrieval.bm25(docs, "id", "text", q)) != []


def test_nearest_of_awkward_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [-1.0, 0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>")
    assert {r.id: r.score for r in retrieval.nearest(v, q, "id").collect()} == {1: 1.0, 2: None, 3: None, 4: None, 5: -1.0}


def test_ranking_breaks_ties_by_id_and_takes_nothing(spark):
    kind = "fact_id long, subject string, predicate string, object string, confidence double, importance double, half_life_sec long, reinforced_sec long, archived boolean"
    facts = spark.createDataFrame([(k, None, None, None, None, None, h, 0, k == 9) for k, h in ((1, 0), (2, 0), (3, -5), (9, 0))], kind)
    c = spark.createDataFrame([(1, k, 0.5, 0.2) for k in (3, 2, 1, 9, 77)], "query_id int, id long, semantic double, keyword double")
    profile = {"w1": 1.2, "w2": 0.15, "w3": 0.1, "w4": 0.1, "access_saturation": 0}
    a = spark.createDataFrame([], "fact_id long, ts timestamp_ntz")
    got = retrieval.rerank(c, facts, a, profile, 100, 2).orderBy("rank_position").collect()
    assert [r.fact_id for r in got] == [1, 2] and got[0].w2 == 0.15 and got[0].w4 == 0.0
    assert retrieval.rerank(c.limit(0), facts, a, profile, 100).count() == retrieval.rerank(c, facts.limit(0), a, profile, 100).count() == 0


def test_graph_of_nothing_and_of_odd_links(spark):
    nodes = spark.createDataFrame([(1, 100, False), (2, 100, True), (3, 0, False), (4, 100, False)], "node long, age_days long, archived boolean")
    links = spark.createDataFrame([(5, 5), (None, 1), (6, 4), (4, 6), (4, 6)], "a long, b long")
    assert {r.node for r in graph.lone(nodes, links).collect()} == set() and {r.node for r in graph.lone(nodes, links.where("a = 6")).collect()} == {1}
    assert {r.node: r.component for r in graph.components(nodes, links).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert connected(links.limit(0), saved).count() == 0 and graph.traverse(nodes.limit(0).select("node"), links).count() == 0
    assert graph.written_back(spark.createDataFrame([(1, 7, "so"), (2, None, "so"), (3, 7, None)], "chain_id int, seed long, chain string"), spark.createDataFrame([(1, 7), (1, 8), (1, 8), (2, 8), (3, 8)], "chain_id int, fact_id long")).count() == 1


def test_life_cycles_of_empty_tables(spark):
    gaps = spark.createDataFrame([], "problem_id string, question string, status string, ask_count long, last_asked long, confidence double, tags string")
    asks = spark.createDataFrame([(None, None, None, None), ("", 1, None, None)], "question string, at long, confidence double, tags string")
    assert lifecycle.log_gaps(gaps, asks.limit(0)).count() == 0 and lifecycle.log_gaps(gaps, asks.where("question is not null")).first().status == "open"
    facts = spark.createDataFrame([], "fact_id long, subject string, predicate string, object string, confidence double, age_days long, archived boolean")
    open_ = lifecycle.log_gaps(gaps, asks.where("question is not null"))
    got = questions.match_facts(open_, facts).collect()
    assert len(got) == 1 and got[0].fact_id is None


def test_maintenance_of_empty_tables(spark):
    e = lambda kind: spark.createDataFrame([], kind)
    observations, facts, links = e("observe_id long, kind string, age_days long"), e("fact_id long, observe_id long"), e("a long, b long")
    assert [x.count() for x in maintenance.collected(observations, facts, links)] == [0, 0, 0]
    assert maintenance.gate(e("verdict_at long, verdict string")).first().decision == "skipped_below_entry"
    assert maintenance.stale_pages(e("path string, title string, synthesis_days long, failed boolean")).count() == 0


def test_leases_and_their_tokens(spark):
    jobs = spark.createDataFrame([(1, 2, None, None, False), (2, 1, "x:2", 100, False), (3, 1, None, None, True), (4, 1, None, None, False)], "id long, priority int, token string, lease_until int, done boolean")
    taken = ledger_ops.leased(jobs, 100, "w", 2)
    assert {r.id: r.token for r in taken.collect()} == {1: None, 2: "w:2", 3: None, 4: "w:4"}
    tokens = spark.createDataFrame([("w:2",), ("x:2",), (None,)], "token string")
    assert {r.id for r in ledger_ops.finished(taken, tokens, 120).where("done").collect()} == {2, 3}
    assert {r.id for r in ledger_ops.finished(taken, tokens, 160).where("done").collect()} == {3}
    assert {r.id: r.lease_until for r in ledger_ops.finished(taken, tokens, 120, done=False).collect()} == {1: None, 2: 180, 3: None, 4: 160}


def test_trimmed_values_and_coverage(spark):
    rows = spark.createDataFrame([("g", float(k)) for k in range(100)] + [("g", None), ("h", 1.0)], "g string, v double")
    got = ledger_ops.trimmed(rows, "g", "v")
    assert got.where("g = 'g'").agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()[:] == (96, 2.0, 97.0) and got.where("g = 'h'").count() == 1
    items = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2)], "source string, item int")
    targets = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "source string, target double")
    cover = {r.source: (r.expected, r.captured, r.coverage, r.met) for r in ledger_ops.covered(items, items.where("item = 1"), targets).collect()}
    assert cover == {"a": (2, 1, 0.5, True), "b": (0, 0, None, True)}


def test_versions_of_null_sources_and_repeated_texts(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, "s"), (1 << 20, "s")], "doc_id long, source string")
    assert {r.doc_id: r.prior for r in similarity.versions(d).collect()} == {1: None, 2: 1, 3: None, 1 << 20: 3}
    assert similarity.versions(d.limit(0)).count() == 0


def test_routes_without_matches(spark):
    actions = spark.createDataFrame([(1, None, None, None, None, None, None)], "action_id long, source_system string, source_id string, project string, what_text string, ts timestamp_ntz, artifact_locations string")
    q = spark.createDataFrame([(1, "lights"), (2, None)], "question_id int, text string")
    found = activity.matched(actions, q)
    assert found.count() == 0 and activity.routes(found).count() == 0 and activity.coverage(found, q).count() == 20
    assert activity.routes(activity.matched(actions, q, timeline=True)).count() == 2
