"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

A rotation learned on a bounded sample turns each vector into a binary code of balanced bits.  The code is cut into
substrings; each substring is a table.  Two codes whose Hamming distance is less than the number of tables agree in one of them at least.
Only codes are dealt to the buckets.  A code that has none within the Hamming radius beside it there goes no further; for the others
the original vectors are fetched and compared by cosine, in double precision.  Links aren't written out: a bucket gives the number of links of
each vector and the edges of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

#: Rows that the rotation is learned on, about: a share by the hash of the id.
SAMPLE = 20_000
#: Vectors in a bucket, about; it sets the length of the substrings.
IN_BUCKET = 512
#: Chance that a pair at the threshold meets in some table; it sets their number.
RECALL = 0.998
#: Tables beyond which shorter substrings, and so larger buckets, keep the recall.
MOST_TABLES = 64
#: Share of the sample that may lie nearer to the mean than the plan allows for.
NEAR_MEAN = 0.01
#: Rows of a tile: a larger bucket is compared tile by tile, in as many tasks.
TILE = 2048
#: Pairs at the threshold, made from the sample, whose Hamming distances set the radius; and what is added to the largest, as a share of the bits.
RADIUS_PAIRS, RADIUS_MARGIN = 20_000, 0.03


def learn(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projections): ``bits`` columns in blocks of at most the dimension, each block a PCA turned by ITQ."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(0)
    _, vectors = np.linalg.eigh(np.cov((x - mean).T) + 1e-12 * np.eye(dim)) if len(x) > 1 else (None, np.eye(dim))
    blocks = []
    while (n := sum(b.shape[1] for b in blocks)) < bits:
        k = min(dim, bits - n)
        w = vectors[:, ::-1][:, :k]
        v = (x - mean) @ w
        r = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(rounds):
            u, _, t = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ t).T
        blocks.append(w @ r)
    return mean, np.hstack(blocks)


def nearness(x: np.ndarray) -> float:
    """Squared distance from the mean of unit vectors that all but ``NEAR_MEAN`` of them have at least."""
    return float(np.quantile(((x - x.mean(0)) ** 2).sum(1), NEAR_MEAN)) if len(x) > 1 else 1.0


def plan(n: int, threshold: float, recall: float = RECALL, radius2: float = 1.0) -> tuple[int, int]:
    """(tables, bits of a table) for n unit vectors, at the squared distance ``radius2`` from the mean that codes are signs about."""
    bits = max(1, min(30, round(math.log2(max(n, 2) / IN_BUCKET)))) if n > 2 * IN_BUCKET else 1
    # the nearer to the mean, the wider is the angle between two vectors as seen from there
    same = 1 - math.acos(max(0.0, 1 - (1 - threshold) / max(min(radius2, 1.0), 1e-9))) / math.pi
    count = lambda: max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(same**bits, 1 - 1e-12))))
    while bits > 1 and count() > MOST_TABLES:
        bits -= 1
    return count(), bits


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; the largest component is taken out first, lest squares of tiny or huge ones leave the doubles."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def radius(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], threshold: float, pairs: int = RADIUS_PAIRS, seed: int = 5) -> int:
    """A Hamming distance that pairs at the threshold stay within: the largest of ``pairs`` made ones, and a margin.

    Each pair is a sample vector and one at the threshold from it, half of them towards another sample vector, half in a random direction.
    """
    (mean, w), rng = model, np.random.default_rng(seed)
    bits = w.shape[1]
    if x.shape[1] < 2 or threshold >= 1:
        return bits
    worst = 0
    for lo in range(0, pairs, 2048):
        a = x[rng.integers(0, len(x), min(2048, pairs - lo))]
        to = rng.standard_normal(a.shape)
        to[::2] = x[rng.integers(0, len(x), len(to[::2]))]
        to = to - (to * a).sum(1, keepdims=True) * a
        size = np.linalg.norm(to, axis=1, keepdims=True)
        b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * to / np.maximum(size, 1e-12)
        far = (((a - mean) @ w >= 0) != ((b - mean) @ w >= 0)).sum(1)
        worst = max(worst, int(far[size[:, 0] > 1e-9].max(initial=0)))
    return min(bits, worst + math.ceil(RADIUS_MARGIN * bits))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def coder(models: dict[int, tuple[np.ndarray, np.ndarray]], tables: int, bits: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's substrings, as one long per table, of which the dimension is a part; and the whole code, eight bits a byte."""
        for b in batches:
            vectors = b.column("embedding")
            out, packed = np.zeros((b.num_rows, tables), np.int64), np.zeros((b.num_rows, -(-tables * bits // 8)), np.uint8)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, at = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()[:-1]
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                mean, w = models[int(dim)]
                code = (unit(flat[at[rows][:, None] + np.arange(dim)]) - mean) @ w >= 0
                packed[rows] = np.packbits(code, axis=1)
                code = code.reshape(len(rows), tables, bits)
                out[rows] = (code * (1 << np.arange(bits))).sum(2) + (int(dim) << 31)
            codes = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("rep"), codes, pa.array([x.tobytes() for x in packed], pa.binary())], ["rep", "codes", "bits"])

    return encode


def _bits(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Codes of a column as rows of bits."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return np.unpackbits(packed.reshape(len(column), -1), axis=1, count=n)


def _pairs(left: int, right: int, tile: np.ndarray, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the left tile, some at once, and all of the right one."""
    a, b = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    for at in range(0, len(a), step):
        yield a[at : at + step], b


def pruner(within: int, tables: int, bits: int):
    def prune(key: tuple, group: pa.Table) -> pa.Table:
        """Of a bucket's tile pair, the rows that have another within the Hamming radius which no earlier table brings together."""
        table, left, right = key[0].as_py(), key[2].as_py(), key[3].as_py()
        g = group.combine_chunks()
        tile = g.column("tile").to_numpy()
        code = _bits(g.column("bits"), tables * bits)
        sign = code.astype(np.float32) * 2 - 1
        near = np.zeros(len(tile), bool)
        for rows, b in _pairs(left, right, tile):
            # the product of signs is the number of equal bits less that of different ones
            i, j = np.nonzero(sign[rows] @ sign[b].T >= tables * bits - 2 * within)
            i, j = rows[i], b[j]
            keep = i != j
            i, j = i[keep], j[keep]
            for lo in range(0, len(i), 1 << 14):
                p, q = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
                met = (code[p, : table * bits] == code[q, : table * bits]).reshape(len(p), table, bits).all(2).any(1) if table else np.zeros(len(p), bool)
                near[p[~met]] = near[q[~met]] = True
        return g.select(["table", "code", "left", "right", "rep", "tile", "bits"]).filter(pa.array(near))

    return prune


def comparer(threshold: float, tables: int, bits: int):
    def compare(key: tuple, group: pa.Table) -> pa.Table:
        """One tile pair of a bucket: links per vector, and edges to the smallest vector linked within."""
        table, left, right = key[0].as_py(), key[2].as_py(), key[3].as_py()
        g = group.sort_by("rep").combine_chunks()
        ids, weight, tile = (g.column(c).to_numpy() for c in ("rep", "weight", "tile"))
        x = unit(np.stack(g.column("embedding").to_pandas().to_numpy()).astype(np.float64))
        code = _bits(g.column("bits"), tables * bits).reshape(len(ids), tables, bits)
        codes = (code[:, :table] * (1 << np.arange(bits))).sum(2)
        links = np.zeros(len(ids), np.int64)
        parent = np.arange(len(ids))
        for rows, b in _pairs(left, right, tile):
            i, j = np.nonzero(x[rows] @ x[b].T >= threshold)
            i, j = rows[i], b[j]
            keep = (i < j) if left == right else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            new = ~(codes[i] == codes[j]).any(1)  # else an earlier table has counted it
            np.add.at(links, i[new], weight[j[new]])
            np.add.at(links, j[new], weight[i[new]])
            while True:  # hang roots under smaller roots until every link lies within one tree
                low, high = np.minimum(parent[i], parent[j]), np.maximum(parent[i], parent[j])
                if (low == high).all():
                    break
                np.minimum.at(parent, high, low)
                while (parent[parent] != parent).any():
                    parent = parent[parent]
        has = (links > 0) | (parent != np.arange(len(ids)))
        return pa.table({"rep": ids[has], "links": links[has], "under": ids[parent[has]]})

    return compare


def near_duplicate_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Vectors of equal dimension link when their cosine is at least ``threshold``; recall is by design at least ``RECALL`` at
    the threshold and higher above it, and no pair below it is linked.  A null vector, a zero one, an empty one and one with null or non-finite
    components link with nothing.  Equal vectors form a class that is compared once and counts as often as it has members.  Rows that
    share a vec_id are one vector's; a row without vec_id links with nothing, has no component and is kept.
    """
    scratch = Scratch(spark, "itq")
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    # the second hash starts from another seed, so that it doesn't follow from the first: 128 bits tell vectors apart
    v = v.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    classes = v.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.any_value("embedding").alias("embedding"))
    classes = scratch.save(classes)
    n = classes.count()
    samples = {}
    for (dim,) in classes.select(F.size("embedding")).distinct().collect():  # a table has few dimensions
        share = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
        rows = classes.where((F.size("embedding") == dim) & share).orderBy("rep").select("embedding").toPandas()
        if not len(rows):  # a rare dimension that the share passed over
            rows = classes.where(F.size("embedding") == dim).limit(SAMPLE).select("embedding").toPandas()
        samples[dim] = unit(_matrix(rows["embedding"]))
    tables, bits = plan(n, threshold, radius2=min(map(nearness, samples.values()), default=1.0))
    models = {dim: learn(x, tables * bits) for dim, x in samples.items()}

    within = max((radius(x, models[dim], threshold) for dim, x in samples.items()), default=0)
    coded = classes.select("rep", "embedding").mapInArrow(coder(models, tables, bits), "rep long, codes array<long>, bits binary")
    rows = scratch.save(coded).select("rep", "bits", F.posexplode("codes").alias("table", "code"))
    large = rows.groupBy("table", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    rows = rows.join(large.select("table", "code", "tiles"), ["table", "code"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    # a row of tile t meets every tile: as the left one from t on, as the right one before
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.withColumn("other", other).withColumn("left", F.least("tile", "other")).withColumn("right", F.greatest("tile", "other"))
    bucket = ["table", "code", "left", "right"]
    near = rows.select(*bucket, "rep", "tile", "bits").groupBy(*bucket)
    near = scratch.save(near.applyInArrow(pruner(within, tables, bits), "table int, code long, left int, right int, rep long, tile int, bits binary"))
    found = near.join(classes.select("rep", "weight", "embedding"), "rep").groupBy(*bucket)
    found = scratch.save(found.applyInArrow(comparer(threshold, tables, bits), "rep long, links long, under long"))

    labels = scratch.save(connected_components(found.select(F.col("rep").alias("a"), F.col("under").alias("b")), scratch))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = classes.select("h1", "h2", "rep", "weight").join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    groups = groups.select("h1", "h2", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = v.select("vec_id", "h1", "h2", "good").join(groups.withColumn("good", F.lit(True)), ["h1", "h2", "good"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings``; cosine of at least 0.95."""
    return near_duplicate_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
