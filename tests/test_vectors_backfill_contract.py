"""Vector cells and the join of two large sides against brute force; backfill that is stopped; the extractors' contract."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import vectors
from ledgerloom.operators.backfill import OriginBackfill
from ledgerloom.operators.contract import register

KIND = "id long, embedding array<float>"


def test_cells_find_what_a_search_through_everything_finds(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 40)
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 8)) * 4
    x = np.concatenate([centres[r.integers(0, 12, 700)] + r.normal(size=(700, 8)) * 0.3, np.repeat(r.normal(size=(1, 8)), 100, 0)]).astype(np.float32)
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] * 8)], KIND)
    asked = [0, 50, 333, 750]
    q = spark.createDataFrame([(k, x[k].tolist()) for k in asked] + [(-1, [0.0] * 8), (-2, None)], "query_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = vectors.Cells(d, "id").search(q, 15).collect()
    assert {r_.query_id for r_ in got} == set(asked)
    for k in asked:
        mine = sorted(((-round(r_.score, 9), r_.id) for r_ in got if r_.query_id == k))
        scores = np.sort(-(u @ u[k]))[:15]
        assert len(mine) == 15 and np.allclose([m[0] for m in mine], scores, atol=1e-7)
    looked = {r_.query_id: r_.looked_at for r_ in got}
    assert all(looked[k] < 500 for k in (0, 50, 333))  # most vectors weren't met
    assert len(vectors.Cells(d.limit(3), "id").search(q.limit(1), 15).collect()) == 3 and vectors.Cells(d.limit(0), "id").search(q, 5).count() == 0


def test_nearest_stored_equals_brute_force(spark):
    r = np.random.default_rng(5)
    c, s = r.normal(size=(60, 4)).round(2), r.normal(size=(90, 4)).round(2)
    key = lambda k: None if k % 10 == 9 else k % 3 if k % 7 else 5
    chunks = spark.createDataFrame([(k, key(k), v.tolist()) for k, v in enumerate(c)], "chunk_id long, key int, embedding array<double>")
    stored = spark.createDataFrame([(0 if k < 70 else k % 3, v.tolist()) for k, v in enumerate(s)], "key int, embedding array<double>")
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    got = {r_.chunk_id: r_.score for r_ in vectors.nearest_stored(chunks, stored, tile=8).collect()}
    for k, v in enumerate(c):
        under = [w for j, w in enumerate(s) if (0 if j < 70 else j % 3) == key(k)]
        assert (got[k] is None) if not under else abs(got[k] - max(cos(v, w) for w in under)) < 1e-12


@pytest.mark.parametrize("stop", [0, 1, 2])
def test_backfill_ends_in_the_same_table_wherever_it_was_stopped(spark, tmp_path, stop):
    rows = [(f"{k:04}", "a", f"u{k}", f"k{k}", "old" if k % 4 == 0 else None, "m" if k % 5 == 0 else None) for k in range(50)]
    o = spark.createDataFrame([*rows, rows[1], (None, "a", "u", "k", None, None)], "observe_id string, adapter string, source_uri string, idempotency_key string, origin_hash string, method string")
    fill = OriginBackfill(spark, str(tmp_path), 10)
    assert fill.run(o, dry_run=True) == {"scanned": 37, "updated": 0} and not list(tmp_path.iterdir())
    fill.run(o, batches=stop)
    # a batch that was written but not recorded
    spark.createDataFrame([("zzz", "wrong", "wrong")], "observe_id string, origin_hash string, method string").write.parquet(str(tmp_path / "hashes" / f"batch={stop}"))
    assert OriginBackfill(spark, str(tmp_path), 10).run(o) == {"scanned": 37 - 10 * stop, "updated": 37 - 10 * stop}
    assert fill.run(o) == {"scanned": 0, "updated": 0} and fill.run(o, dry_run=True)["scanned"] == 0
    got = {r.observe_id: (r.origin_hash, r.method) for r in fill.filled(o).where("observe_id is not null").collect()}
    want = o.withColumn("h", F.coalesce("origin_hash", F.sha2(F.concat_ws("|", "adapter", "source_uri", "idempotency_key"), 256))).where("observe_id is not null").collect()
    assert got == {r.observe_id: (r.h, r.method or (None if r.origin_hash else r.adapter)) for r in want}


def test_contract_of_extractors(spark):
    register(spark)
    ask = '{"observe_id":"o","content":"text","more":1}'
    cases = {
        '{"facts":[]}': [], "{": ["reply: not JSON"], "[]": ["reply: no list of facts"], '{"facts":5}': ["reply: no list of facts"],
        '{"facts":[{"subject":"s","predicate":"p","object":"o","confidence":true},{"subject":" ","predicate":1,"object":"o"},7]}': ["fact: confidence is not a number", "fact: subject is empty; predicate is not a text", "fact: not an object"],
    }
    d = spark.createDataFrame([(ask, r) for r in cases] + [(ask, None)], "request string, reply string")
    d.createOrReplaceTempView("cases")
    got = {}
    for r in spark.sql("select c.reply, x.* from cases c, lateral extracted(c.request, c.reply) x").collect():
        got.setdefault(r.reply, []).append(r.error)
    assert got == {k: v for k, v in cases.items() if v} | {None: ["reply: no text"]}
    one = spark.sql("""select * from extracted('{"observe_id":"o","content":"t"}', '```json\n{"facts":[{"subject":" s ","predicate":"p","object":"o"}]}\n```')""").first()
    assert tuple(one) == ("o", 0, "s", "p", "o", None, None)
    assert spark.sql("select error from extracted(null, '{}')").first()[0] == "request: no text"
    with pytest.raises(Exception, match="must be a text"):
        spark.sql("select * from extracted(1, '{}')").collect()
