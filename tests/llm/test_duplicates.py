"""Operators 7 and 8 against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import itq_dedup, minhash_dedup
from ledgerloom.llm.common import Scratch
from ledgerloom.llm.components import connected_components
from tests.conftest import SMALL


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_copies(seed=1):
    """Chains and stars of edited copies around the threshold."""
    r = np.random.default_rng(seed)
    word = lambda: "w%d" % r.integers(0, 3000)
    texts = []
    for _ in range(6):
        base = [word() for _ in range(int(r.integers(8, 120)))]
        for _ in range(25):
            copy = list(base)
            for k in r.integers(0, len(copy), int(r.integers(0, max(1, len(copy) // 7)))):
                copy[k] = word()
            texts.append(" ".join(copy))
    return texts + texts[:10] + ["", "one", "One", "a b", "A  b"]


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("rounds", [0, 2])
def test_near_duplicates_are_all_found(spark, monkeypatch, width, rounds):
    monkeypatch.setattr(minhash_dedup, "LEADER_ROUNDS", rounds) if rounds else None
    texts = near_copies()
    sets = [shingles(t, width) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 100
    want = groups(len(texts), links)
    got = minhash_dedup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=width).toPandas().sort_values("doc_id")
    assert got.n_shingles.tolist() == [len(s) for s in sets]
    assert got.component_id.tolist() == want
    assert got.kept.tolist() == [k == c for k, c in enumerate(want)]


def test_tiles_find_links_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE_ROWS", 4)
    texts = near_copies(2)
    sets = [shingles(t, 2) for t in texts]
    want = groups(len(texts), [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = minhash_dedup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=2).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == want


def test_awkward_documents(spark, awkward, nothing):
    rows = minhash_dedup.near_duplicates(spark, awkward, width=2).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].component_id == by[2][0].component_id == 1 and by[1][0].kept and not by[2][0].kept
    assert by[3][0].n_shingles == by[4][0].n_shingles == 0 and by[3][0].kept and by[4][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert by[5][0].n_shingles == 5
    assert minhash_dedup.near_duplicates(spark, nothing).count() == 0


def test_superminhash_estimates_jaccard():
    r = np.random.default_rng(0)
    u = r.integers(0, 1 << 62, 900).astype(np.uint64)
    sig = minhash_dedup.superminhash(np.concatenate((u[:600], u[300:])), np.array([0, 600, 1200]), 512)
    assert abs((sig[0] == sig[1]).mean() - 300 / 900) < 0.06
    assert (sig < (1 << 63)).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 150: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def vectors(r):
    base = r.standard_normal((30, 16))
    x = np.concatenate([base] + [base[:6] + 0.09 * r.standard_normal((6, 16)) for _ in range(20)])
    return np.concatenate((x, x[:3], 2.5 * x[:2])).astype(np.float32)


@pytest.mark.parametrize("tile", [2048, 7])
def test_vectors_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(itq_dedup, "TILE", tile)
    monkeypatch.setattr(itq_dedup, "IN_BUCKET", 16)
    x = vectors(np.random.default_rng(4)).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    links = [(a, b) for a in range(len(x)) for b in range(a) if c[a, b] >= 0.95]
    near = sum(0.9499 < v < 0.9501 for v in c[np.triu_indices(len(x), 1)])
    assert near == 0 and len(links) > 200
    got = itq_dedup.near_duplicate_vectors(spark, spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<float>, rep string")).toPandas().sort_values("vec_id")
    n = np.zeros(len(x), int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found = got.n_links.sum() / n.sum()
    assert found >= 0.98 and (got.n_links.to_numpy() <= n).all()
    assert got.component_id.tolist() == groups(len(x), links)


def test_recall_on_the_table(spark):
    x = np.stack(spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").toPandas().embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.95).sum(1) - 1
    got = itq_dedup.op7_itq_dedup(spark, SMALL).toPandas().sort_values("vec_id").n_links.to_numpy()
    assert got.sum() >= 0.9 * want.sum() and (got <= want).all()


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in itq_dedup.near_duplicate_vectors(spark, df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] and got[10] == [(3, 1, False)] * 2
    assert all(got[k] == [(0, k, True)] for k in (3, 4, 5, 6, 7, 8, 9)) and got[None] == [(0, None, True)]
    assert itq_dedup.near_duplicate_vectors(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1000, 2000])
def test_links_are_found_beside_a_large_common_mean(spark, monkeypatch, n):
    monkeypatch.setattr(itq_dedup, "IN_BUCKET", 32)
    r = np.random.default_rng(6)
    unit = lambda: (v := r.standard_normal((n, 63))) / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = unit(), unit()
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = (0.951 - 0.7) / 0.3  # pairs of cosine 0.951, of which the common part is 0.7
    x = np.concatenate((a, near * a + np.sqrt(1 - near**2) * b))
    x = np.hstack((np.full((2 * n, 1), np.sqrt(0.7)), np.sqrt(0.3) * x))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = itq_dedup.near_duplicate_vectors(spark, df).toPandas().set_index("vec_id")
    assert (got.n_links >= 1).mean() >= 0.99


def test_crosser_keeps_a_link_whose_hashes_share_their_upper_halves():
    items = [(1 << 40) + 1, (1 << 40) + 2, *((k << 40) for k in range(3, 11))]
    group = pa.table({"rep": [1, 2], "component": [1, 2], "tile": pa.array([0, 0], pa.int32()), "left": [0, 0], "right": [0, 0], "items": pa.array([items, items[:8]], pa.list_(pa.int64()))})
    assert minhash_dedup._crosser(80)(group).to_pylist() == [{"a": 1, "b": 2}]
    fewer = group.set_column(5, "items", pa.array([items, items[:7]], pa.list_(pa.int64())))
    assert minhash_dedup._crosser(80)(fewer).num_rows == 0


def test_class_hashes_do_not_follow_from_one_another(spark):
    x = F.array(F.lit(1.5), F.lit(2.5))
    a, b, chained = spark.range(1).select(F.xxhash64(x), F.xxhash64(F.lit(1), x), F.xxhash64(x, F.lit(1))).first()
    assert len({a, b, chained}) == 3
    # a hash of (e, 1) starts where the hash of e ends; that of (1, e) reads e from another seed
    y = F.array(F.lit(2.5), F.lit(1.5))
    assert spark.range(1).select(F.xxhash64(F.lit(1), y)).first()[0] != b


def test_tiny_and_huge_vectors(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1.0, 2.0]), (3, [1e300, 2e300]), (4, [-1e-310, 2e-310]), (5, [5e-324, 0.0]), (6, [1e308, 0.0])]
    got = itq_dedup.near_duplicate_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_hamming_radius_holds_pairs_at_the_threshold():
    r = np.random.default_rng(3)
    x = itq_dedup.unit(r.standard_normal((3000, 32)) @ np.diag(np.linspace(0.2, 2, 32)))
    model = itq_dedup.learn(x, 200)
    within = itq_dedup.radius(x, model, 0.95, 4000)
    assert 20 < within < 80
    a = x[:1500]
    to = r.standard_normal(a.shape)
    to = itq_dedup.unit(to - (to * a).sum(1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * to
    code = lambda v: (v - model[0]) @ model[1] >= 0
    assert ((code(a) != code(b)).sum(1) <= within).all()
