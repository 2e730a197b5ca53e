"""Vector search that leaves out what can't be near: cells with exact bounds, and a join of two large sides within a key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..jobs.catalog import query
from ..sources.ledger import Tables
from ..sources.scratch import saved
from .retrieval import cosine
from .search import NONE, ROWS, Best, batches_of, matrix, meet, own_pairs, result, split, without_own

#: Cells at most, so that their centres fit into every task; vectors that the centres are learned from; vectors of one cell that one task meets.
MOST_CELLS, SAMPLE, TILE = 4_096, 50_000, 5_000
#: Vectors of one product.
MEET = 1_024
#: What rounding may take from a bound: distances come from products of unit vectors.
EPS = 5e-7


def unit(v: Column) -> Column:
    """The vector at length one; null if it is null, zero, or holds a null or something that isn't a number."""
    x = F.transform(v, lambda y: y.cast("double"))
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    return F.when((n > 0) & (n < float("inf")), F.transform(x, lambda y: y / n))


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))


class Cells:
    """Vectors (id, embedding) in cells around centres by k-means: every vector with its distance from its centre, every centre with that of its farthest vector.

    The centres are learned from about ``SAMPLE`` vectors, picked by a hash; any centres give right results.  Vectors without a direction or an id are left out.
    The centres, ``MOST_CELLS`` at most, go to every task.
    """

    def __init__(self, vectors: DataFrame, id: str, cells: int | None = None, seed: int = 7):
        self.spark = vectors.sparkSession
        v = saved(vectors.select(F.col(id).alias("id"), unit(F.col("embedding")).alias("unit")).where("unit is not null and id is not null"), "units")
        self.n, self.width = v.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("unit")), F.lit(1))).first()
        k = max(1, min(cells or math.ceil(math.sqrt(self.n)), MOST_CELLS, self.n))
        share = F.pmod(F.xxhash64("unit"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, self.n)) * (1 << 30))
        kind = "cell int, centre array<double>"
        if self.n:
            fitted = KMeans(k=k, seed=seed, maxIter=8, initSteps=1).fit(v.where(share).select(array_to_vector("unit").alias("features")))
            known = [(j, c.tolist()) for j, c in enumerate(fitted.clusterCenters())]
            placed = fitted.transform(v.withColumn("features", array_to_vector("unit"))).select("id", "unit", F.col("prediction").alias("cell"))
        else:
            known, placed = [], v.withColumn("cell", F.lit(0))
        placed = placed.join(F.broadcast(self.spark.createDataFrame(known, kind)), "cell").withColumn("away", _apart(F.col("unit"), F.col("centre"))).drop("centre")
        self.vectors = saved(placed, "placed")
        stats = {r.cell: r for r in self.vectors.groupBy("cell").agg(F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).collect()}
        self.centres = np.array([c for j, c in known if j in stats]).reshape(len(stats), self.width)
        self.cells, self.radius, self.tiles = (np.array([x(j) for j, _ in known if j in stats]) for x in (int, lambda j: stats[j].radius, lambda j: stats[j].tiles))

    def search(self, queries: DataFrame, k: int, first: int = 2, digits: int | None = None, but_own: bool = False) -> DataFrame:
        """(query_id, id, score, looked_at): the ``k`` nearest vectors of every query (query_id, embedding) by cosine, equal scores (at ``digits``, if given) by id, and how many vectors the query met.

        The ``first`` nearest cells give a distance that the k-th vector surely has at most.  By the triangle's inequality other cells, and vectors in them, whose distances from the
        centre tell that they are farther, aren't met; so the result is that of a search through everything.  Queries without a direction find nothing; fewer vectors than ``k`` are all found.
        Cells are dealt to tasks, queries go to the tasks of the cells that they are to meet, and a task gives ``k`` vectors a query at most.  With ``but_own`` an id isn't its own answer.
        """
        q = queries.select("query_id", unit(F.col("embedding")).alias("q")).where("q is not null")
        kinds = [q.schema["query_id"], self.vectors.schema["id"]]
        if not self.n:
            return q.select("query_id", F.lit(None).cast(kinds[1].dataType).alias("id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("looked_at")).limit(0)
        blocks, sets = split(self.n, self.width, q.count(), self.spark.sparkContext.defaultParallelism)
        centres, cells, radius, tiles = self.centres, self.cells, self.radius, self.tiles
        v = self.vectors.join(F.broadcast(self.spark.createDataFrame(list(zip(cells.tolist(), tiles.tolist())), "cell int, tiles int")), "cell")
        v = v.withColumn("block", F.pmod(F.col("cell") * 31 + F.pmod(F.xxhash64("id"), F.col("tiles")), F.lit(blocks)).cast("int")).drop("tiles")
        in_blocks = [np.unique((int(c) * 31 + np.arange(t)) % blocks) for c, t in zip(cells, tiles)]
        most = lambda low: np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(low - (0 if digits is None else 10.0**-digits), -1.0))) + EPS

        def plan(early: bool):
            """The cells and the blocks that each query is to meet: the first ones, or the others that may be near enough."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for part in (b.slice(lo, ROWS) for lo in range(0, b.num_rows, ROWS)):
                        gap = _gaps(matrix(part.column("q"))[0], centres)
                        if early:
                            met = [np.sort(x) for x in np.argsort(gap, 1, kind="stable")[:, :first]]
                            more = [pa.array([cells[x].tolist() for x in met], pa.list_(pa.int32())), pa.array(np.full(len(met), NONE))]
                        else:
                            far = gap - radius > most(part.column("low").to_numpy())[:, None]
                            done = part.column("cells").to_pylist()
                            met = [x[~np.isin(cells[x], d)] for x, d in zip((np.flatnonzero(~f) for f in far), done)]
                            more = [part.column("cells"), part.column("low")]
                        to = [np.unique(np.concatenate([in_blocks[j] for j in x])).tolist() if len(x) else [] for x in met]
                        yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("q"), *more, pa.array(to, pa.list_(pa.int32()))], ["query_id", "q", "cells", "low", "blocks"])

            return run

        def kernel(early: bool):
            def run(v: pa.Table, q: pa.Table) -> Iterator[pa.RecordBatch]:
                v = v.sort_by([("cell", "ascending"), ("id", "ascending")])
                # places by id, that equal scores go by
                order = pc.sort_indices(v, [("id", "ascending")]).to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                x, y, cell, away = matrix(v["unit"])[0], matrix(q["q"])[0], v["cell"].to_numpy(), v["away"].to_numpy()
                low, met = q["low"].to_numpy(), np.zeros(len(y), np.int64)
                done = np.zeros((len(y), len(cells)), bool)
                for r, c in enumerate(q["cells"].to_pylist()):
                    done[r, np.searchsorted(cells, c)] = True
                own = own_pairs(q, v) if but_own else (np.zeros(0, np.int64),) * 2
                best = Best(len(y), k, digits, False, low)
                here = np.unique(cell)
                for c, j in zip(here, np.searchsorted(cells, here)):
                    lo, hi = np.searchsorted(cell, [c, c + 1])
                    gap = _gaps(y, centres[j : j + 1])[:, 0]
                    rows = np.flatnonzero(done[:, j] if early else ~done[:, j] & (gap - radius[j] <= most(best.low)))
                    for part in (rows[a : a + ROWS] for a in range(0, len(rows), ROWS)):
                        for at in (np.arange(a, min(a + MEET, hi)) for a in range(lo, hi, MEET)):
                            near = np.abs(gap[part, None] - away[at]) <= most(best.low[part])[:, None]
                            s = np.where(near, y[part] @ x[at].T, -np.inf)
                            met[part] += near.sum(1)
                            without_own(s, part, at, own)
                            best.offer(part, place[at], s)
                found = best.settle()
                out = result(found, q, v.take(pa.array(order)), ["id"], digits)
                yield from batches_of(out | {"met": pa.array(np.zeros(len(found[0]), np.int64)), "hit": pa.array(np.ones(len(found[0]), bool))}, schema.names)
                yield from batches_of({"query_id": q["query_id"], "id": pa.nulls(len(y), v["id"].type), "score": pa.nulls(len(y), pa.float64()), "met": pa.array(met), "hit": pa.array(np.zeros(len(y), bool))}, schema.names)

            return run

        schema = StructType([*kinds, StructField("score", DoubleType()), StructField("met", LongType()), StructField("hit", BooleanType())])
        asked = StructType([*q.schema, StructField("cells", ArrayType(IntegerType())), StructField("low", DoubleType()), StructField("blocks", ArrayType(IntegerType()))])
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        q = saved(q.mapInArrow(plan(True), asked), "queries")
        early = saved(meet(v, q, blocks, sets, kernel(True), schema), "early")
        kth = early.where("hit").withColumn("_r", F.row_number().over(by)).where(F.col("_r") == k).select("query_id", F.col("score").alias("_low"))
        q = q.join(kth, "query_id", "left").select("query_id", "q", "cells", F.coalesce("_low", "low").alias("low"))
        late = meet(v, q.mapInArrow(plan(False), asked), blocks, sets, kernel(False), schema)
        met = saved(early.unionByName(late), "met")
        n = met.groupBy("query_id").agg(F.sum("met").alias("looked_at"))
        return met.where("hit").drop("met", "hit").withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r").join(n, "query_id")


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from centres, within ``EPS`` / 2."""
    return np.sqrt(np.maximum(0.0, 1 + (centres * centres).sum(1) - 2 * (x @ centres.T)))


def nearest_stored(chunks: DataFrame, stored: DataFrame, tile: int = TILE) -> DataFrame:
    """``chunks`` (chunk_id, key, embedding) with ``score``: the cosine of the nearest vector that ``stored`` (key, embedding) has under the chunk's key; null if there is none.

    Both sides are large: they meet in a join on the key, a key of many stored vectors in tiles of about ``tile``; each tile gives a maximum.  A chunk_id is one chunk.
    """
    s = stored.where("key is not null").select("key", F.col("embedding").alias("_e"))
    tiles = s.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles"))
    s = s.join(tiles, "key").withColumn("_tile", F.pmod(F.xxhash64("_e"), F.col("_tiles")).cast("int")).drop("_tiles")
    c = chunks.select("chunk_id", "key", "embedding").join(tiles, "key").select("chunk_id", "key", "embedding", F.explode(F.expr("sequence(0, _tiles - 1)")).alias("_tile"))
    best = c.join(s, ["key", "_tile"]).groupBy("chunk_id").agg(F.max(cosine(F.col("embedding"), F.col("_e"))).alias("score"))
    return chunks.drop("score").join(best, "chunk_id", "left")


@query("select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id % 50 = 0 and e.vec_id != q.vec_id qualify row_number() over (partition by q.vec_id order by round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) desc, e.vec_id) <= 20")
def vector_cells_top20(t: Tables) -> DataFrame:
    """SRC-13, UDF-3: the nearest vectors of those whose id is divisible by 50, by cells; equal scores at six places by id."""
    e = t("embeddings")
    found = Cells(e, "vec_id").search(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 20, digits=6, but_own=True)
    return found.select("query_id", "id", "score")
