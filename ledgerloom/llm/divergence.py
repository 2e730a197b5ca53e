"""Source divergence audit: exact frequency filtering, then a recount of the kept terms through broadcast perfect hashes.

The first pass counts, for each language, in how many documents a term stands, and keeps the frequent ones.  They are dealt to shards, and a task
builds one minimal perfect hash for each shard: every term has a slot of its own and no slot is free.  The shards go to all tasks in blocks of bounded
size; a second pass over the texts finds the slot of each word, checks the term stored there byte by byte, and adds to the slots of the document's group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_WORD, Scratch, mix, ranges, released, slices, text_batches, text_buffers, words_of

#: A term: letters and all characters beyond ASCII; digits part terms as well.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
TOP = 10
#: Terms of a shard on average.
PER_SHARD = 4_096
#: Bytes of terms and slots that are broadcast at once; more shards than that are counted in further passes.
BLOCK_BYTES = 64 << 20
#: Bytes of counts that a task holds before it hands them on.
COUNT_BYTES = 64 << 20
#: Numbers in one piece of the matrix of a language's groups and terms.
PIECE = 1 << 16
_NO_TERM = NOT_WORD.copy()
_NO_TERM[0x30:0x3A] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NAMES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ----------------------------------------------------------------------------- terms


def terms(text: Column) -> Column:
    """The terms of a text in order; A to Z are lower-cased, nothing else."""
    return F.regexp_extract_all(F.translate(text, *_NAMES), F.lit(TERM), F.lit(0))


def frequent(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term) that at least ``least`` documents (lang, text) of the language hold; each task adds up its own documents first."""
    found = docs.select("lang", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return found.groupBy("lang", "term").count().where(F.col("count") >= least).select("lang", "term")


# ----------------------------------------------------------------------------- perfect hashes


def _hashes(words: list[bytes]) -> np.ndarray:
    """The hash that ``words_of`` gives each word."""
    off = np.cumsum([0, *(len(w) + 1 for w in words)])
    return words_of(np.frombuffer(b" ".join([*words, b""]), np.uint8), off, _NO_TERM)[0]


def displaced(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each hash) of a minimal perfect hash over distinct hashes.

    Hashes fall into buckets of four; the largest bucket first, each gets the first displacement that sends its hashes to free slots.
    Buckets with one hash take the slots that are left, written as -1 - slot.
    """
    n = len(h)
    bucket = (mix(h) % np.uint64(-(-n // 4))).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=-(-n // 4))
    start = np.cumsum(size) - size
    move, slot, free = np.zeros(len(size), np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own, base = h[by[start[b] : start[b] + size[b]]], 0
        while True:
            tried = np.arange(base, base + 256, dtype=np.uint64)
            to = (mix(own[None, :] + tried[:, None] * _STEP) % np.uint64(n)).astype(np.int64)
            ordered = np.sort(to, axis=1)
            good = np.flatnonzero(free[to].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
            if len(good):
                break
            base += 256
        move[b] = base + good[0]
        slot[by[start[b] : start[b] + size[b]]] = to[good[0]]
        free[to[good[0]]] = False
    left = np.flatnonzero(free)
    single = np.flatnonzero(size == 1)
    slot[by[start[single]]] = left
    move[single] = -1 - left
    return move, slot


SHARD = "lang string, shard int, n_shards long, n int, bytes long, moves array<long>, terms binary, lengths array<int>, twins array<string>, numbered array<string>"


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: its terms in the order of their slots; ``twins`` are terms whose hash another term of the shard has, and stand behind the others."""
    words = sorted(t.encode() for t in rows.term)
    h = _hashes(words)
    _, first, count = np.unique(h, return_index=True, return_counts=True)
    alone = np.zeros(len(words), bool)
    alone[first[count == 1]] = True
    hashed, twins = [w for w, a in zip(words, alone) if a], [w for w, a in zip(words, alone) if not a]
    move, slot = displaced(h[alone]) if hashed else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    placed = [b""] * len(hashed)
    for w, s in zip(hashed, slot):
        placed[s] = w
    body = b"".join(placed)
    row = (key[0], int(key[1]), int(rows._n.iloc[0]), len(words), len(body) + 16 * len(words), move.tolist(), body, [len(w) for w in placed], [w.decode() for w in twins], [w.decode() for w in (*placed, *twins)])
    return pd.DataFrame([row], columns=["lang", "shard", "n_shards", "n", "bytes", "moves", "terms", "lengths", "twins", "numbered"])


def _shard(h: np.ndarray, n_shards) -> np.ndarray:
    return (mix(h ^ _STEP) % np.asarray(n_shards, np.uint64)).astype(np.int64)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = _hashes([t.encode() for t in b.column("term").to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(_shard(h, b.column("_n").to_numpy()), pa.int32()), b.column("_n"), b.column("term")], names=["lang", "shard", "_n", "term"])


def shards(kept: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """A row for each shard of a language's kept terms (lang, term)."""
    n = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / per_shard).cast("long").alias("_n"))
    return kept.join(n, "lang").select("lang", "_n", "term").mapInArrow(_deal, "lang string, shard int, _n long, term string").groupBy("lang", "shard").applyInPandas(_build, SHARD)


class Block:
    """Shards (rows by language and shard, slots numbered from ``first``), packed for lookups; the slots of a language in the block follow one another."""

    def __init__(self, rows: list, n_shards: dict[str, int], first: int):
        self.n_shards, self.first = n_shards, first
        self.langs: dict[str, list[int]] = {}  # by language, its first slot here and the one behind its last
        self.places: dict[str, np.ndarray] = {}  # by language and shard: first move, moves, first slot, hashed terms
        self.twins: dict[tuple[str, bytes], int] = {}
        moves, lengths, n_moves, slot = [], [], 0, 0
        for r in rows:
            self.places.setdefault(r.lang, np.zeros((n_shards[r.lang], 4), np.int64))[r.shard] = (n_moves, len(r.moves), slot, len(r.lengths))
            self.twins |= {(r.lang, t.encode()): slot + len(r.lengths) + k for k, t in enumerate(r.twins)}
            self.langs.setdefault(r.lang, [slot, slot])[1] = slot + r.n
            moves.append(np.array(r.moves, np.int64))
            lengths.append(np.array([*r.lengths, *[0] * len(r.twins)], np.int32))
            n_moves, slot = n_moves + len(r.moves), slot + r.n
        self.moves, self.length = np.concatenate(moves), np.concatenate(lengths)
        self.body = np.frombuffer(b"".join(bytes(r.terms) for r in rows), np.uint8)
        self.start = np.cumsum(self.length, dtype=np.int64) - self.length
        self.twin_hashes = _hashes([t for _, t in self.twins])

    def slots(self, lang: str, h: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The slot of each word (its hash, and its place in the lower-cased bytes), -1 where it isn't a kept term of the language."""
        place = self.places[lang][_shard(h, self.n_shards[lang])]
        known = np.flatnonzero(place[:, 3] > 0)
        p, own = place[known], h[known]
        move = self.moves[p[:, 0] + (mix(own) % p[:, 1].astype(np.uint64)).astype(np.int64)]
        hashed = (mix(own + np.maximum(move, 0).astype(np.uint64) * _STEP) % p[:, 3].astype(np.uint64)).astype(np.int64)
        slot = p[:, 2] + np.where(move < 0, -1 - move, hashed)
        # the term stored there must be the word, byte by byte
        fits = self.length[slot] == (e - s)[known]
        known, slot = known[fits], slot[fits]
        out = np.full(len(h), -1, np.int64)
        if len(known):
            n = (e - s)[known]
            same = buf[ranges(s[known], n)] == self.body[ranges(self.start[slot], n)]
            right = np.logical_and.reduceat(same, np.cumsum(n) - n)
            out[known[right]] = slot[right]
        for k in np.flatnonzero(np.isin(h, self.twin_hashes)) if self.twins else ():
            out[k] = self.twins.get((lang, buf[s[k] : e[k]].tobytes()), -1)
        return out


# ----------------------------------------------------------------------------- recount


def _counter(shared, most: int):
    """The kernel of the second pass: (lang, source, slot, n) of one task's documents, from one dense row of slots for each group."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        held: dict[tuple[str, str], np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), dense in held.items():
                at = np.flatnonzero(dense)
                slot = at + (block.first + block.langs[lang][0])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(slot, pa.int64()), pa.array(dense[at])], names=["lang", "source", "slot", "n"])
            held.clear()

        for whole in batches:
            for b in slices(whole, "text"):
                raw, off = text_buffers(b.column("text"))
                h, s, e, ptr = words_of(raw, off, _NO_TERM)
                buf = LOWER[raw]
                groups: dict[tuple[str, str], list[int]] = {}
                for k, key in enumerate(zip(b.column("lang").to_pylist(), b.column("source").to_pylist())):
                    if key[0] in block.langs:
                        groups.setdefault(key, []).append(k)
                for (lang, source), rows in groups.items():
                    at = ranges(ptr[rows], ptr[np.array(rows) + 1] - ptr[rows])
                    slot = block.slots(lang, h[at], buf, s[at], e[at])
                    first, end = block.langs[lang]
                    if (lang, source) not in held:
                        if 8 * (end - first) + sum(x.nbytes for x in held.values()) > most:
                            yield from handed()
                        held[lang, source] = np.zeros(end - first, np.int64)
                    held[lang, source] += np.bincount(slot[slot >= 0] - first, minlength=end - first)
        yield from handed()

    return count


def recount(docs: DataFrame, built: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, count_bytes: int = COUNT_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, source, slot, n) of the kept terms in ``docs``, (lang, slot, place, term)) by the ``built`` shards; ``place`` counts from 0 in each language.

    The driver gets a row for each shard, and the shards of one block at a time.
    """
    spark = docs.sparkSession
    listed = sorted(tuple(r) for r in built.select("lang", "shard", "n_shards", "n", "bytes").collect())
    n_shards: dict[str, int] = {}
    lang_first: dict[str, int] = {}
    numbered, blocks, slot, size = [], [], 0, 0
    for lang, shard, n_shards[lang], n, nbytes in listed:
        lang_first.setdefault(lang, slot)
        if not blocks or size + nbytes > block_bytes:
            blocks, size = [*blocks, slot], 0
        numbered.append((lang, shard, slot, lang_first[lang], len(blocks)))
        slot, size = slot + n, size + nbytes
    schema = "lang string, shard int, base long, lang_base long, block int"
    place = spark.createDataFrame(numbered, schema)
    made = built.join(F.broadcast(place) if len(numbered) < 100_000 else place, ["lang", "shard"])
    terms_of = made.select("lang", "base", "lang_base", F.posexplode("numbered").alias("k", "term"))
    terms_of = terms_of.select("lang", (F.col("base") + F.col("k")).alias("slot"), (F.col("base") + F.col("k") - F.col("lang_base")).alias("place"), "term")
    counted = None
    for k, first in enumerate(blocks, 1):
        rows = made.where(F.col("block") == k).drop("numbered").collect()
        shared = spark.sparkContext.broadcast(Block(sorted(rows, key=lambda r: (r.lang, r.shard)), n_shards, first))
        part = scratch.save(docs.mapInArrow(_counter(shared, count_bytes), "lang string, source string, slot long, n long").groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")))
        counted = part if counted is None else counted.unionByName(part)
        shared.destroy()
    if counted is None:
        counted = spark.createDataFrame([], "lang string, source string, slot long, n long")
    return counted, terms_of


# ----------------------------------------------------------------------------- divergence


def share(n: str, total: str, v: str) -> Column:
    """1 + floor(1000000000 * (n + 2) / (total + 2 * v)), in decimals of 38 digits, so that no count is too large."""
    return F.expr(f"1 + cast({n} + 2 as decimal(20, 0)) * 1000000000 div cast({total} + 2 * {v} as decimal(20, 0))")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are below 2^30, so that squares fit."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of the distances of all pairs of a language's groups over one piece of its terms.  Rows with place -1 hold a group's share of a term that it lacks, in order of the groups."""
    absent = rows[rows.place < 0].sort_values("g")
    p = np.repeat(absent.p.to_numpy()[:, None], int(absent.width.iloc[0]), axis=1)
    found = rows[rows.place >= 0]
    p[found.g.to_numpy(), found.place.to_numpy()] = found.p.to_numpy()
    out = []
    for a in range(len(p) - 1):
        d, both = p[a + 1 :] - p[a], p[a + 1 :] + p[a]
        out.append(pd.DataFrame({"a": np.full(len(d), a), "b": np.arange(a + 1, len(p)), "value": (d * d // both).sum(axis=1)}))
    out = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": []})
    out.insert(0, "lang", key[0])
    return out


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, block_bytes: int = BLOCK_BYTES, count_bytes: int = COUNT_BYTES, piece: int = PIECE, per_shard: int = PER_SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank): how each group (lang, source) of ``docs`` (lang, source, text) differs from the others of its language.

    Part ``pair``: item is each other source of the language, value the summed distance of the two groups' shares over all kept terms, 0 if the language keeps none.
    Part ``term``: the ``top`` kept terms that the group has more of than its language, by distance.  Rank counts from 1, value descending, item by bytes.
    A term is kept if ``least`` documents of the language hold it.  Nulls in any of the three columns are empty strings; texts without terms
    still make a group; rows that repeat are separate documents; very long texts are read whole; equal values go by item; an empty table gives an empty result; other columns are not read.

    The pairs of a language are as many as its groups squared, which is the result's size; their sums are made for pieces of its terms.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "divergence")
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    built = scratch.save(shards(frequent(docs, least), per_shard))
    counted, numbered = recount(docs, built, scratch, block_bytes, count_bytes)
    v = built.groupBy("lang").agg(F.sum("n").cast("long").alias("v"))
    total = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(v, "lang", "left").fillna(0, ["total", "v"])
    w = Window.partitionBy("lang")
    groups = scratch.save(groups.withColumn("g", F.row_number().over(w.orderBy("source")) - 1).withColumn("s", F.count(F.lit(1)).over(w)))
    # a row for each group and kept term that it has
    cells = counted.join(groups, ["lang", "source"]).join(numbered, ["lang", "slot"])
    cells = scratch.save(cells.select("lang", "source", "g", "s", "v", "place", "term", "n", share("n", "total", "v").alias("p")))
    # terms
    whole = groups.groupBy("lang").agg(F.sum("total").alias("whole"))
    of_lang = cells.groupBy("lang", "place").agg(F.sum("n").alias("of_lang")).join(whole, "lang")
    more = cells.join(of_lang, ["lang", "place"]).withColumn("q", share("of_lang", "whole", "v")).where("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = more.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    # pairs
    width = F.greatest(F.lit(1), F.floor(F.lit(piece) / F.col("s"))).cast("long")
    at = cells.withColumn("w", width).select("lang", F.expr("place div w").alias("piece"), "g", F.expr("place % w").alias("place"), "p", F.lit(0).cast("long").alias("width"))
    lacking = groups.where("v > 0").withColumn("w", width).withColumn("piece", F.explode(F.expr("sequence(0L, (v - 1) div w)")))
    lacking = lacking.select("lang", "piece", "g", F.lit(-1).cast("long").alias("place"), share("0", "total", "v").alias("p"), F.expr("least(w, v - piece * w)").alias("width"))
    sums = at.unionByName(lacking).groupBy("lang", "piece").applyInPandas(_pairs, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("other")), F.struct(F.col("b").alias("g"), F.col("a").alias("other")))).alias("_x"), "value").select("lang", "_x.g", "_x.other", "value")
    one, two = groups.select("lang", "source", "g"), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("other"))
    pairs = one.join(two, "lang").where("g != other").join(sums, ["lang", "g", "other"], "left").fillna(0, ["value"])
    pairs = pairs.withColumn("rank", F.row_number().over(by)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct r) >= 10),
v as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
total as (select lang, source, sum(n) as total from c group by all),
whole as (select lang, sum(n) as total from c group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (coalesce(total.total, 0) + 2 * v.v) as p
  from groups g join kept k using (lang) join v using (lang) left join total using (lang, source) left join c using (lang, source, term)),
q as (
  select lang, term, 1 + 1000000000::hugeint * (sum(p.n) + 2) // (any_value(whole.total) + 2 * any_value(v.v)) as q
  from p join v using (lang) join whole using (lang) group by lang, term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p join q using (lang, term) where n > 0 and p > q)
select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from pair
union all
select * from (select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 10
"""
