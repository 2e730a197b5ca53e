"""The best vectors of many queries by matrix products: blocks of vectors meet the queries in tasks, and a task gives no more than the best of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bytes of one task's vectors, queries that one task holds, and vectors that a task is worth; queries and vectors of one product.
BLOCK, QUERIES, LEAST = 64 << 20, 20_000, 2_000
ROWS, TILE = 512, 4_096
#: Scores of pairs that have none (null), and of those that are no number; cosines lie between.  Pairs that don't count are at minus infinity.
#: A zero vector has no number with one that holds none, and null with others.
NULL, NAN, ZERO, NONE = -4.0, 4.0, -3.0, -1e300


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, lengths, what is odd about each or 0): ``NULL`` for a null or one that holds a null, ``ZERO``, ``NAN`` for one that holds what is no number."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(a)
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(n)), n)
    x = np.zeros((len(n), int(n.max(initial=0))))
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = values
    odd = np.zeros(len(n))
    with np.errstate(all="ignore"):
        length = np.sqrt((x * x).sum(1))
        odd[~np.isfinite(length)] = NAN
        odd[length == 0] = ZERO
        odd[pc.is_null(a).to_numpy(zero_copy_only=False)] = NULL
        odd[row[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = NULL
        x = np.where(odd[:, None] == 0, x / length[:, None], 0.0)
    return x, n, odd


def rounded(s: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves away from zero."""
    return s if digits is None else np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5), s) / 10.0**digits + 0.0


class Best:
    """The ``k`` best pairs of each query so far by rounded score, then place; ``in_order`` where places that come later are larger ones."""

    def __init__(self, queries: int, k: int, digits: int | None, in_order: bool, low: np.ndarray | None = None):
        self.k, self.digits, self.in_order = k, digits, in_order
        self.low = np.full(queries, NONE) if low is None else low.copy()
        self.known = np.zeros(queries, bool)  # whether the k-th is among the pairs here
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, rows: np.ndarray, at: np.ndarray, s: np.ndarray) -> None:
        """Scores of queries ``rows`` (each once) with vectors at places ``at``."""
        low = self.low[rows]
        if (low == NONE).any() and s.shape[1] > self.k:
            low = np.maximum(low, rounded(np.maximum(np.partition(s, -self.k, 1)[:, -self.k], NONE), self.digits))
        half = 0.0 if self.digits is None else 0.5 * 10.0**-self.digits + 1e-12
        r, c = np.nonzero(s >= (low - half)[:, None])
        score = s[r, c]
        seen = rounded(score, self.digits)
        keep = (seen > low[r]) | (seen == low[r]) & ~(self.in_order & self.known[rows[r]])
        self.parts.append((rows[r[keep]], seen[keep], at[c[keep]], score[keep]))
        self.waiting += int(keep.sum())
        if self.waiting > max(8 * self.k * len(rows), 200_000):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """(query, rounded score, place, score) of the best, sorted."""
        q, seen, at, score = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((at, -seen, q))
        q, seen, at, score = q[order], seen[order], at[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.low[q[last]], self.known[q[last]] = np.maximum(self.low[q[last]], seen[last]), True
        few = place < self.k
        self.parts, self.waiting = [(q[few], seen[few], at[few], score[few])], int(few.sum())
        return self.parts[0]


def own_pairs(queries: pa.Table, vectors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) that have the same id."""
    rows: dict = {}
    for k, x in enumerate(queries["query_id"].to_pylist()):
        rows.setdefault(x, []).append(k)
    pairs = [(k, j) for j, x in enumerate(vectors["id"].to_pylist()) for k in rows.get(x, ())]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def without_own(s: np.ndarray, rows: np.ndarray, at: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> None:
    """Pairs of an id with itself don't count; ``rows`` and ``at`` ascend."""
    if len(own[0]) and len(rows) and len(at):
        r, c = np.searchsorted(rows, own[0]), np.searchsorted(at, own[1])
        ok = (rows[np.minimum(r, len(rows) - 1)] == own[0]) & (at[np.minimum(c, len(at) - 1)] == own[1])
        s[r[ok], c[ok]] = -np.inf


def result(best: tuple[np.ndarray, ...], queries: pa.Table, vectors: pa.Table, columns: list[str], digits: int | None) -> dict[str, pa.Array]:
    q, seen, at, score = best
    shown = score if digits is None else seen
    shown = np.where(seen == NAN, np.nan, shown)
    return {"query_id": queries["query_id"].take(pa.array(q)), **{c: vectors[c].take(pa.array(at)) for c in columns}, "score": pa.array(shown, mask=seen == NULL)}


def batches_of(arrays: dict, schema: list[str]) -> Iterator[pa.RecordBatch]:
    yield from pa.table({c: arrays[c] for c in schema}).combine_chunks().to_batches(max_chunksize=50_000)


def split(n: int, width: int, asked: int, cores: int) -> tuple[int, int]:
    """(blocks of vectors, sets of queries), so that a task holds a block and a set whatever the tables' sizes."""
    return max(-(-n * width * 8 // BLOCK), min(2 * cores, n // LEAST), 1), max(-(-asked // QUERIES), 1)


def meet(vectors: DataFrame, queries: DataFrame, blocks: int, sets: int, kernel: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``kernel`` on each block of vectors (block, ...) with each set of the queries (blocks, query_id, ...) that are to meet the block."""
    c = F.col
    v = vectors.withColumn("_set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).withColumn("_slot", (c("block") * sets + c("_set")).cast("int")).drop("block", "_set").withColumn("_asked", F.lit(False))
    q = queries.withColumn("_block", F.explode("blocks")).withColumn("_slot", (c("_block") * sets + F.pmod(F.xxhash64("query_id"), F.lit(sets))).cast("int")).drop("blocks", "_block").withColumn("_asked", F.lit(True))
    dealt = v.unionByName(q, allowMissingColumns=True).repartitionById(blocks * sets, "_slot").drop("_slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            t = pa.Table.from_batches(got)
            asked = t["_asked"]
            a, b = t.filter(pc.invert(asked)), t.filter(asked)
            if a.num_rows and b.num_rows:
                yield from kernel(a, b)

    return dealt.mapInArrow(run, schema)


def nearest_best(vectors: DataFrame, queries: DataFrame, k: int, *columns: str, digits: int | None = 6, but_own: bool = False) -> DataFrame:
    """(query_id, id, *columns, score): surely the ``k`` best vectors (id, *columns, embedding) of every query (query_id, embedding) by cosine, and others beside them; equal scores at ``digits`` by id.

    Every pair is scored, by matrix products in double precision; a block of vectors gives ``k`` rows a query at most, so pairs are neither shuffled nor written.  Scores are as
    in ``cosine``: null for a zero vector or a null, behind all others.  With ``but_own`` an id isn't its own answer.  Rows without an id are left out.
    """
    vectors = vectors.where("id is not null").select("id", *columns, "embedding")
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    queries = queries.select("query_id", F.col("embedding").alias("q"))
    blocks, sets = split(n, width, queries.count(), vectors.sparkSession.sparkContext.defaultParallelism)
    kept = ["id", *columns]
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), *(vectors.schema[x] for x in kept), StructField("score", DoubleType())])

    def kernel(v: pa.Table, q: pa.Table) -> Iterator[pa.RecordBatch]:
        v = v.sort_by("id")
        x, n, odd = matrix(v["embedding"])
        y, m, odd_q = matrix(q["q"])
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(z, ((0, 0), (0, width - z.shape[1]))) for z in (x, y))
        own = own_pairs(q, v) if but_own else (np.zeros(0, np.int64),) * 2
        for lo in range(0, len(y), ROWS):
            rows = np.arange(lo, min(lo + ROWS, len(y)))
            best = Best(len(rows), k, digits, True)
            for at in (np.arange(a, min(a + TILE, len(x))) for a in range(0, len(x), TILE)):
                s = y[rows] @ x[at].T
                a, b = odd_q[rows, None], odd[at]
                if a.any() or b.any() or (m[rows, None] != n[at]).any():
                    s = np.where((a == ZERO) | (b == ZERO), NULL, s)
                    s = np.where((a == NAN) | (b == NAN), NAN, s)
                    s = np.where((a == NULL) | (b == NULL) | (m[rows, None] != n[at]), NULL, s)
                without_own(s, rows, at, own)
                best.offer(np.arange(len(rows)), at, s)
            q_, *rest = best.settle()
            yield from batches_of(result((q_ + lo, *rest), q, v, kept, digits), schema.names)

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    return meet(vectors.withColumn("block", block), queries.withColumn("blocks", F.sequence(F.lit(0), F.lit(blocks - 1))), blocks, sets, kernel, schema)
