"""The index with additions, changes, deletions and merges against BM25 over the texts that are there."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval
from ledgerloom.operators.living_index import LivingIndex

DOC = "id long, text string"


def scores(df):
    return sorted((r.query_id, r.doc, round(r.bm25, 9)) for r in df.collect())


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(1, "alpha beta"), (2, "w3 w5 w7 unheard"), (3, "!"), (4, "only")], "query_id long, text string")


def test_scores_are_those_of_the_texts_that_are_there(spark, tmp_path, questions):
    r, index, there = random.Random(5), LivingIndex(spark, str(tmp_path / "i")), {}
    text = lambda: " ".join(r.choice(["alpha", "beta", "Gamma", *(f"w{k}" for k in range(9))]) for _ in range(r.randint(0, 12)))
    merged = 0
    for step in range(6):
        new = {k: (None if r.random() < 0.1 else text()) for k in r.sample(range(60), 20)}
        index.add(spark.createDataFrame([*new.items(), (None, "alpha alpha")], DOC), "id", "text")
        there |= new
        if step in (2, 5):
            gone = [*r.sample(range(70), 8), None]
            index.delete(spark.createDataFrame([(k,) for k in gone], "id long"), "id")
            there = {k: x for k, x in there.items() if k not in gone}
        if step > 2:
            merged += index.merge()
    now = spark.createDataFrame([(k, x) for k, x in there.items() if x is not None], DOC)
    assert scores(index.search(questions)) == scores(retrieval.bm25(now, "id", "text", questions)) != []
    log = index.log()
    assert merged and len(index.segments(log)) < 6
    assert 0 < index.postings(log, ["alpha"]).count() < index.postings(log).count()


def test_unfinished_operations_and_repeated_ids_do_not_count(spark, tmp_path, questions, monkeypatch):
    index = LivingIndex(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        index.search(questions)
    index.add(spark.createDataFrame([(1, "alpha"), (2, "only beta")], DOC), "id", "text")
    before = scores(index.search(questions))
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(1, "beta"), (1, "beta"), (7, "only")], DOC), "id", "text")
    monkeypatch.setattr(LivingIndex, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.delete(spark.createDataFrame([(1,)], "id long"), "id")
    monkeypatch.undo()
    assert scores(index.search(questions)) == before != []
    index.add(spark.createDataFrame([], DOC), "id", "text")
    index.add(spark.createDataFrame([(3, "only")], DOC), "id", "text")
    assert {d for q, d, _ in scores(index.search(questions)) if q == 4} == {2, 3}
    index.delete(spark.createDataFrame([(k,) for k in (1, 2, 3)], "id long"), "id")
    assert scores(index.search(questions)) == [] and not index.merge()
