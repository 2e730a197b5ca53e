"""Steps whose cost a text must not pay more than once: corrections, first lines, fields of actions, postings."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import actions, retrieval
from ledgerloom.streaming import tables

OUTBOX = "seq long, adapter string, source_id string, source_kind string, source_uri string, idempotency_key string, trust_tier string, transform_policy string, payload string, appended_at string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_corrections_are_looked_for_once(spark):
    row = lambda k, x: (k, "a", "s", "local-file", "file:///d/s.txt", str(k), "user", "tp", x, "2024-01-01")
    new = tables.drained(spark.createDataFrame([row(1, "Well, ACTUALLY, it was so"), row(2, "nothing"), row(3, "其实是这样")], OUTBOX))
    for name in ("corrections", "signals"):
        assert "RLIKE" not in plan(new[name]) and new[name].count() == 2  # the patterns are behind both


def test_plain_searches_clear_no_correction(spark):
    texts = ["i WAS wrong ABOUT it", "CORRECTION:\tx", "correction :x", "Scratch That", "actually\n I", "actual it", "我之前说的错", "我上次以为的\n错", "实际上应该", "其实不", "忽略我说的", "算了刚才的话", "", None]
    want = F.coalesce(*(F.when(F.col("x").rlike(text.java(p)), n) for n, p in text.CORRECTIONS))
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", text.correction(F.col("x")).alias("got"), want.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and sum(r.got is not None for r in rows) == 8
    assert set(text.CORRECTION_HOLDS) == {n for n, _ in text.CORRECTIONS}


def test_the_start_of_a_text_has_the_line_of_the_whole(spark):
    texts = ["", None, " \n ", "a", " a\n\tb ", "ab cde", "a  b  c  d ", "ab \n", "\U0001f600 \U0001f600\U0001f600\U0001f600", "abcde", "x" * 9, "   abc" + " " * 50 + "d e f g"]
    x, most = F.col("x"), 4
    whole, start = actions.shortened(x, most), actions.shortened(actions.start_of(x, most), most)
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(whole.alias("a"), start.alias("b"), actions.one_line(x).isNull().alias("c"), actions.one_line(actions.start_of(x, most)).isNull().alias("d"), F.length(actions.start_of(x, most)).alias("n")).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows) and rows[-2].n == most + 1


def test_fields_of_actions_are_computed_once(spark):
    kind = "observe_id string, source_id string, source_uri string, source_kind string, occurred_at string, captured_at string, raw string, adapter string, adapter_sequence long, metadata string"
    raws = [' \n{"cwd":"/a//Repos/own/P/x","command":" ls "}', '{"cwd":"/","command":"ls"}', '["a"]', '"text"', "7", '{"cut', "", None]
    d = actions.action_fields(spark.createDataFrame([(str(k), "s", "zsh://h", "local-dir", "t", "t", r, "zsh", k, None) for k, r in enumerate(raws)], kind))
    assert "Generate" not in plan(d) and plan(d).count("split(") <= 3  # a path is taken apart once
    got = {r.observe_id: (r.what_text, r.project) for r in d.collect()}
    assert got["0"] == ("zsh command in P: ls", "P") and got["1"] == ("zsh command in /: ls", None)
    assert [got[k][0] for k in "234567"] == ['["a"]', '"text"', "7", '{"cut', "zsh observation from zsh://h", "zsh observation from zsh://h"]


def test_words_are_counted_within_their_row(spark, tmp_path):
    rows = [(1, "b a B c_1 a"), (2, ""), (3, None), (4, "\u00e9\u00c9 x"), (5, "!")]
    p = retrieval.counted(spark.createDataFrame(rows, "doc long, text string"))
    assert "Aggregate" not in plan(p) and "Repartition" not in plan(p)
    assert sorted((r.doc, r.length, r.term, r.tf) for r in p.collect()) == [(1, 5, "", 1), (1, 5, "a", 2), (1, 5, "b", 2), (1, 5, "c_1", 1), (2, 0, "", 1), (4, 2, "", 1), (4, 2, "x", 1), (4, 2, "\u00e9\u00e9", 1), (5, 0, "", 1)]
    q = spark.createDataFrame([(1, "aa bb cc")], "query_id long, text string")
    for k, more in enumerate(([], [(1, "aa cc")], [(None, "bb"), (9, None)])):  # ids of their own, a repeated one, missing ones
        docs = spark.createDataFrame([(1, "aa bb"), (2, "bb"), (3, "xx yy zz"), (4, ""), *more], "id long, text string")
        retrieval.build_index(docs, "id", "text", str(tmp_path / str(k)))
        x = docs.where("text is not null")
        s = spark.read.parquet(str(tmp_path / str(k) / "stats")).first()
        assert s.n == docs.count() and s.mean == docs.agg(F.avg(F.size(retrieval.words(F.col("text"))))).first()[0]
        tf = retrieval.words(F.col("text"))
        want = x.select("id", F.explode(tf).alias("term")).groupBy("id", "term").count().collect()
        got = spark.read.parquet(str(tmp_path / str(k) / "postings")).where("term != ''").collect()
        assert sorted(map(str, ((r.term, r.doc, r.tf) for r in got))) == sorted(map(str, ((r.term, r.id, r["count"]) for r in want)))


def test_best_of_many_queries_stay_in_the_tasks_that_hold_the_documents(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    monkeypatch.setattr(retrieval, "TASK", 150, raising=False)
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    monkeypatch.setattr(retrieval, "DENSE", 4_000, raising=False)
    texts = [" ".join(f"w{(k * j) % 17}" for j in range(1, 3 + k % 9)) for k in range(80)]
    rows = [(f"d{k:03d}", x) for k, x in enumerate(texts)] + [("copy1", texts[5]), ("copy2", texts[5]), ("d007", "w1 w1 more"), (None, "w1"), ("none", None), ("empty", "")]
    docs = spark.createDataFrame(rows, "id string, t string").repartition(7)
    asked = [(k, texts[k]) for k in range(0, 80, 9)] + [(5, texts[5]), (5, "w1 w3"), (200, "nothing of it"), (201, None), (202, "a")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    found = retrieval.bm25_best(docs, "id", "t", queries, 4)
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in physical and "Pandas" not in physical  # neither postings nor scores are dealt to blocks
    held, lengths, n = {}, {}, [x for i, x in rows if i is not None and x is not None]
    for i, x in rows:
        if i is not None and x is not None:
            held.setdefault(i, Counter()).update(x.split())
            lengths[i] = max(lengths.get(i, 0), len(x.split()))
    mean, want = sum(len(x.split()) for x in n) / len(n), []
    for q in {q for q, _ in asked}:
        terms = [w for k, x in asked if k == q and x for w in set(x.split()) if len(w) > 1]  # a word of two rows counts twice, as in SQL
        df = {w: sum(w in c for c in held.values()) for w in terms}
        score = {i: sum(max(math.log((len(n) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for w in terms) for i, c in held.items() if any(c[w] for w in terms)}
        want += [(q, i, round(s, 6)) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4]]
    got = retrieval.top(found.withColumn("bm25", F.round("bm25", 6)), 4, "bm25", "doc").collect()
    assert sorted((r.query_id, r.doc, r.bm25) for r in got) == sorted(want) and found.count() > len(want)
    assert retrieval.bm25_best(docs, "id", "t", queries.where("query_id > 200")).count() == 0


def test_memory_of_a_search_task_does_not_grow_with_its_documents():
    terms, per, queries = 2_000, 200, 20
    rng = np.random.default_rng(3)
    at, asked = np.arange(0, queries * 25 + 1, 25), rng.integers(0, terms, queries * 25).astype(np.int32)
    weight = rng.random(terms) + 0.5

    def batches(n):
        for lo in range(0, n, 1_000):
            code = (rng.integers(0, terms // per, (1_000, per)) + np.arange(0, terms, terms // per)).astype(np.int32)  # ascending, none twice
            offsets = pa.array(np.arange(0, 1_000 * per + 1, per, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (code.ravel(), np.ones(1_000 * per, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + 1_000)), pa.array(np.full(1_000, per, np.int32)), *lists], ["doc", "length", "codes", "counts"])

    def peak(postings):
        tracemalloc.start()
        rows = sum(map(len, retrieval.best_of_documents(batches(postings // per), pa.array(range(queries)), at, asked, weight, 150.0, 200, retrieval.BLOCK)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == queries * 200
        return most

    one, four = peak(2_000_000), peak(8_000_000)  # a block before had eight million, at over a hundred bytes each
    assert four < 1.3 * one and four < 200e6
