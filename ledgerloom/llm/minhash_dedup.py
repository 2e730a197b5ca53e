"""Near-duplicates by SuperMinHash, banding, verification on full shingle sets, and union-find grouping.

One pass over the texts writes, for each document, the size and a 128-bit digest of its shingle set and the band keys of its
SuperMinHash signature.  Documents with equal sets form a class, which one of them represents; only classes are
compared.  In each bucket members meet a leader rather than one another; whoever isn't in its leader's component after that
meets another leader, and buckets that still hold several components are compared tile by tile inside tasks, so that no
link is lost and no group is paired off in rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, ranges, released, slices, text_batches, text_buffers, words_of
from .components import connected_components

BANDS, ROWS = 32, 5  # a pair at similarity 0.8 shares no band with a probability of 3 in a million
#: Needed texts are picked by a broadcast of their ids up to so many, by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Rounds with leaders before what remains is compared in tiles.
LEADER_ROUNDS = 2
#: Members and shingles of a tile.
TILE_ROWS, TILE_ITEMS = 1024, 2_000_000
_K = np.uint64(0xD6E8FEB86659FD93)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their pointer."""
    words, _, _, ptr = words_of(*text_buffers(texts))
    n = np.diff(ptr)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    starts = ranges(ptr[:-1], count)
    length = np.repeat(np.minimum(n, width), count)
    acc = np.repeat(np.minimum(n, width), count).astype(np.uint64)
    for k in range(width):
        has = length > k
        at = np.where(has, starts + k, 0)
        acc = np.where(has, mix(acc * _K + words[at] if len(words) else acc), acc)
    at, sets, sizes = 0, [], np.zeros(len(n), np.int64)
    for i, c in enumerate(count.tolist()):
        x = np.unique(acc[at : at + c])
        sets.append(x)
        sizes[i] = len(x)
        at += c
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def superminhash(elements: np.ndarray, ptr: np.ndarray, m: int) -> np.ndarray:
    """Signatures (texts x m): the least rank plus fraction at each place, a rank being its step in the element's own permutation.

    Step j gives place pi(j) of every element the value j + r.  A text is done when all its places hold less than j.
    The permutation is shuffled lazily: where place k stands after the earlier swaps is traced back through them.
    """
    n = np.diff(ptr)
    none = np.uint64(1 << 63)
    sig = np.full((len(n), m), none, np.uint64)
    flat = sig.reshape(-1)
    live = n > 0
    doc = np.repeat(np.arange(len(n)), n)
    x, swaps = elements, []
    for j in range(m):
        if j:
            open_ = live & (sig.max(1) >= np.uint64(j << 32))
            if not open_.any():
                break
            if open_.sum() < live.sum():
                keep = open_[doc]
                doc, x, swaps, live = doc[keep], x[keep], [s[keep] for s in swaps], open_
        u = mix(x + np.uint64((int(_GOLD) * (j + 1)) % (1 << 64)))
        k = (j + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        place = k.astype(np.int64)
        for t in range(j - 1, -1, -1):
            place[place == swaps[t]] = t
        swaps.append(k)
        np.minimum.at(flat, doc * m + place, (u >> np.uint64(32)) + np.uint64(j << 32))
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        acc = mix(acc * _K + sig[:, r :: rows][:, :bands])
    return acc


SIGNED = "doc_id long, n long, h1 long, h2 long, bands array<long>"


def signer(width: int, bands: int, rows: int):
    @released
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets, ptr = shingle_sets(b.column("text"), width)
                n = np.diff(ptr)
                total = lambda v: np.diff(np.concatenate(([np.uint64(0)], np.cumsum(v, dtype=np.uint64)))[ptr])
                keys = band_keys(superminhash(sets, ptr, bands * rows), bands, rows)
                keys, has = keys.view(np.int64), np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has))).astype(np.int32)), pa.array(keys[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n), pa.array(total(mix(sets)).view(np.int64)), pa.array(total(mix(sets * _K + _GOLD)).view(np.int64)), lists], ["doc_id", "n", "h1", "h2", "bands"]
                )

    return sign


def setter(width: int):
    @released
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets, ptr = shingle_sets(b.column("text"), width)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(sets.view(np.int64)))], ["rep", "items"])

    return sets_of


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _sized(percent: int, a: str, b: str):
    """Similar sets have similar sizes."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _crosser(percent: int):
    def cross(group: pa.Table) -> pa.Table:
        """Of each member and other component that are linked, the pair that is most similar."""
        g = group.combine_chunks()
        rep, component, tile, left, right = (g.column(c).to_numpy() for c in ("rep", "component", "tile", "left", "right"))
        _, where = np.unique(component, return_inverse=True)
        items = g.column("items").combine_chunks() if isinstance(g.column("items"), pa.ChunkedArray) else g.column("items")
        n = np.diff(items.offsets.to_numpy())
        rows = np.repeat(np.arange(len(rep)), n)
        _, column = np.unique(items.flatten().to_numpy(), return_inverse=True)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        # every pair of two components has an end outside the largest one
        small = np.flatnonzero(where != np.bincount(where).argmax())
        out = ([], [])
        for at in range(0, len(small), 256):
            part = small[at : at + 256]
            both = np.zeros((len(part), len(rep)))
            for c in range(0, int(column[-1]) + 1, 4096):
                lo, hi = np.searchsorted(column, [c, c + 4096])
                m = np.zeros((len(rep), 4096), np.float32)
                m[rows[lo:hi], column[lo:hi] - c] = 1
                both += m[part] @ m.T
            union = n[part][:, None] + n[None, :] - both
            like = np.where((100 * both >= percent * union) & (where[part][:, None] != where[None, :]), both / np.maximum(union, 1), 0)
            if left[0] != right[0]:
                like[tile[part][:, None] == tile[None, :]] = 0
            i, j = np.nonzero(like)
            best = np.lexsort((-like[i, j], where[j], i))
            i, j = i[best], j[best]
            keep = np.concatenate(([True], (i[1:] != i[:-1]) | (where[j][1:] != where[j][:-1]))) if len(i) else np.zeros(0, bool)
            out[0].append(rep[part[i[keep]]])
            out[1].append(rep[j[keep]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cross


def _tiled(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one bucket that are similar enough; at most one per member, bucket and other component."""
    rows = members.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("bucket", "rep", "component", "tile", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"))
    return rows.join(sets, "rep").groupBy("bucket", "left", "right").applyInArrow(_crosser(percent), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs`` (doc_id, text; other columns are ignored).

    A document's set: the distinct shingles of ``width`` words, lower-cased in A-Z; with fewer words, its whole sequence as one.  Pairs
    with 100 * intersection >= ``percent`` * union are linked.  ``component_id`` is the smallest doc_id reachable over
    links, ``kept`` whether it is the row's own.  No words or a null text: an empty set, linked with nothing.  Rows
    that share a doc_id are one document with several texts: they are linked, and each of its rows is kept or not alike.  A row
    without doc_id is linked with nothing, has no component and is kept.  An empty table gives an empty result.
    """
    text_batches(spark)
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    signed = scratch.save(texts.mapInArrow(signer(width, bands, rows), SIGNED))
    classes = scratch.save(
        signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("h1", "h2", "n", F.col("x.doc_id").alias("rep"), F.col("x.bands").alias("bands"))
    )
    n_classes = classes.count()
    members = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    shared = members.groupBy("bucket").agg(F.min("rep").alias("_l"), F.max("rep").alias("_m")).where("_l != _m").select("bucket")
    members = scratch.save(members.join(shared, "bucket").distinct().withColumn("component", F.col("rep")))

    needed = scratch.save(members.select(F.col("rep").alias("doc_id")).distinct())
    n_needed = needed.count()
    items = texts.join(F.broadcast(needed) if n_needed <= BROADCAST_IDS else needed, "doc_id").mapInArrow(setter(width), "rep long, items array<long>")
    sets = scratch.save(items)
    if sets.count() > n_needed:  # rows repeat a doc_id: each of its sets once
        sets = scratch.save(sets.distinct())

    links = None
    for turn in range(LEADER_ROUNDS + 1):
        if turn:
            labels = scratch.save(connected_components(links, scratch))
            members = members.drop("component").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
            several = members.groupBy("bucket").agg(F.min("component").alias("_l"), F.max("component").alias("_m"), F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n")).where("_l != _m")
            several = several.select("bucket", F.greatest(F.ceil(F.col("_k") / TILE_ROWS), F.ceil(F.col("_n") / TILE_ITEMS)).cast("int").alias("tiles"))
            members = scratch.save(members.join(several, "bucket"))
        if turn < LEADER_ROUNDS:
            leaders = members.groupBy("bucket").agg(F.min_by(F.struct("rep", "n", "component"), F.xxhash64("rep", F.lit(turn))).alias("l"))
            pairs = members.join(leaders, "bucket").where((F.col("component") != F.col("l.component")) & _sized(percent, "n", "l.n"))
            pairs = pairs.select(F.least("rep", "l.rep").alias("a"), F.greatest("rep", "l.rep").alias("b"))
        else:
            pairs = _tiled(members, sets, percent)
        found = scratch.save(_verified(pairs.distinct(), sets, percent))
        links = found if links is None else links.unionByName(found)
    labels = scratch.save(connected_components(links, scratch))
    scratch.drop(sets, members)

    groups = classes.select("h1", "h2", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    named = signed.select("doc_id", "n", "h1", "h2").join(groups, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; shingles of two words, similarity 0.8."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
