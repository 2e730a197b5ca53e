"""Versions of a document: hashes, shingles, MinHash, and the gates that decide whether a change is noteworthy."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from ..functions.text import jaccard, normalised
from ..jobs.catalog import query
from ..sources.ledger import Tables
from ..sources.scratch import saved
from .sequences import with_previous
from .vectors import nearest_stored

#: The MinHash prime and the gates' thresholds.
PRIME = 4_294_967_311
SAME, NOVEL, COSINE = 0.98, 0.05, 0.985
#: Shingles that are permuted at once, so that they stay in a core's cache.
BLOCK = 16_384


@query("select sha256(text) as content_hash, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def content_dupes(t: Tables) -> DataFrame:
    """SIM-3 gate 1: exact copies."""
    d = t("documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    return d.where("copies > 1")


@query("select doc_id, sha256('local-file|file://' || source || '/' || doc_id || '|' || sha256(text)) as origin_hash from documents")
def origin_hashes(t: Tables) -> DataFrame:
    """DOM-21."""
    uri = F.concat(F.lit("file://"), F.col("source"), F.lit("/"), F.col("doc_id"))
    return t("documents").select("doc_id", F.sha2(F.concat_ws("|", F.lit("local-file"), uri, F.sha2("text", 256)), 256).alias("origin_hash"))


@query("select doc_id, sha256(source || ':' || lang || ':' || coalesce(nullif(n_chars::varchar, ''), '-')) as content_hash from documents")
def generated_hash(t: Tables) -> DataFrame:
    """PRJ-3: the run's stored hash."""
    return t("documents").select("doc_id", F.sha2(F.concat_ws(":", "source", "lang", F.coalesce(F.nullif(F.col("n_chars").cast("string"), F.lit("")), F.lit("-"))), 256).alias("content_hash"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \n\t\r]+"), lambda w: w != ""))


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, prior): each document and the one before it from its source, by ids alone; a source's documents are its versions."""
    ids = with_previous(docs.select("doc_id", "source"), ["source"], F.shiftright("doc_id", 16), ["doc_id"], ["doc_id"])
    return ids.select("doc_id", F.col("before.doc_id").alias("prior"))


def beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (doc_id, prior) with both rows of the table (doc_id, ...): its columns, and those of the prior as structs ``was``."""
    was = table.select(F.col("doc_id").alias("prior"), F.struct(*[c for c in table.columns if c != "doc_id"]).alias("was"))
    return pairs.join(table, "doc_id").join(was, "prior", "left")


_VERSIONS = "with v as (select doc_id, text, lag(doc_id) over (partition by source order by doc_id) as prior, lag(text) over (partition by source order by doc_id) as tb from documents) "
_JACCARD = "len(list_intersect(w, b)) / (len(w) + len(b) - len(list_intersect(w, b)))::double"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[ \n\t\r]+'), lambda x: x != ''))"


@query(_VERSIONS + f", j as (select doc_id, {_WORDS.format(x='text')} as w, {_WORDS.format(x='tb')} as b from v where prior is not null) select doc_id, round(case when len(w) + len(b) = 0 then 0 else {_JACCARD} end, 6) as similarity from j")
def exact_jaccard_versions(t: Tables) -> DataFrame:
    """SIM-4: exact Jaccard of each version and the one before."""
    d = t("documents")
    v = beside(versions(d).where("prior is not null"), d.select("doc_id", word_set(F.col("text")).alias("words")))
    return v.select("doc_id", F.round(jaccard(F.col("words"), F.col("was.words")), 6).alias("similarity"))


def _shingles(text: str) -> np.ndarray:
    """64-bit hashes of a text's shingles of five characters, distinct; a shorter text is one shingle."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(1, len(codes) - 4) if len(codes) else 0, np.uint64)
    for k in range(min(5, len(codes))):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


@F.pandas_udf(DoubleType())
def shared_shingles(texts: pd.Series, others: pd.Series) -> pd.Series:
    """Exact Jaccard of two texts' shingles; of two without any 0, null where either text is null.  The texts travel, as their sets would be eight times as large."""
    out = []
    for a, b in zip(texts, others):
        if a is None or b is None:
            out.append(None)
            continue
        x, y = _shingles(a), _shingles(b)
        n = len(np.unique(np.concatenate((x, y))))
        out.append((len(x) + len(y) - n) / n if n else 0.0)
    return pd.Series(out, dtype="float64")


def gates(pairs: DataFrame, snapshots: DataFrame, chunks: DataFrame | None = None, facts: DataFrame | None = None, same: float = SAME, novel: float = NOVEL, estimated: bool = True) -> DataFrame:
    """(doc_id, reason, noteworthy, jaccard, novel_ratio, new_facts): whether a version says anything that the prior one (null: there is none) doesn't.

    snapshots (doc_id, raw, normalised): the bytes' equality, then that of the normalised text, then MinHash (or exact) similarity of its shingles of
    five characters, then the share of chunks (doc_id, score: the cosine of its nearest stored vector) that are new; a version without chunks is
    all new.  The number of new facts (doc_id, n) is a signal only.
    """
    s = snapshots.select("doc_id", F.sha2("raw", 256).alias("raw"), F.sha2("normalised", 256).alias("norm"), (minhash("normalised") if estimated else F.col("normalised")).alias("sketch"))
    v = beside(pairs, saved(s, "sketches"))
    if estimated:
        alike = F.size(F.filter(F.zip_with("sketch", "was.sketch", lambda x, y: x == y), lambda x: x)) / 128.0
        alike = F.when((F.size("sketch") == 0) & (F.size("was.sketch") == 0), 1.0).otherwise(alike)
    else:
        differ = F.col("was").isNotNull() & ~F.coalesce(F.col("norm") == F.col("was.norm"), F.lit(False))  # a null text has no shingles
        alike = shared_shingles(*(F.when(differ, F.coalesce(c, F.lit(""))) for c in (F.col("sketch"), F.col("was.sketch"))))
    fresh = None if chunks is None else chunks.groupBy("doc_id").agg((F.count_if(F.col("score").isNull() | (F.col("score") < COSINE)) / F.count(F.lit(1))).alias("_novel"))
    v = v.withColumn("_novel", F.lit(None).cast("double")) if fresh is None else v.join(fresh, "doc_id", "left")
    v = v.withColumn("_facts", F.lit(0)) if facts is None else v.join(facts.select("doc_id", F.col("n").alias("_facts")), "doc_id", "left")
    v = v.withColumn("_alike", F.when(F.col("was").isNull(), 0.0).when(F.col("norm") == F.col("was.norm"), 1.0).otherwise(alike)).withColumn("_novel", F.coalesce("_novel", F.lit(1.0)))
    reason = (
        F.when(F.col("was").isNull(), "first-seen").when(F.col("raw") == F.col("was.raw"), "byte-identical").when(F.col("norm") == F.col("was.norm"), "whitespace-normalized-identical")
        .when(F.col("_alike") >= same, "near-duplicate-jaccard").when(F.col("_novel") < novel, "semantic-duplicate").when(F.col("_novel") < 1, "partial-novelty").otherwise("content-changed")
    )
    quiet = F.col("reason").isin("byte-identical", "whitespace-normalized-identical", "near-duplicate-jaccard", "semantic-duplicate")
    v = v.withColumn("reason", reason)
    none = F.when(F.col("reason").isin("byte-identical", "whitespace-normalized-identical", "near-duplicate-jaccard"), 0.0).otherwise(F.col("_novel"))
    return v.select("doc_id", "reason", (~quiet).alias("noteworthy"), F.col("_alike").alias("jaccard"), none.alias("novel_ratio"), F.when(quiet, 0).otherwise(F.coalesce("_facts", F.lit(0))).alias("new_facts"))


def _snapshots(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.col("text").alias("raw"), normalised(F.col("text")).alias("normalised"))


def _chunks(t: Tables) -> DataFrame:
    """A document's chunks are two vectors; each meets those of the version before."""
    e = t("embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).alias("doc_id"), "embedding")
    c = e.join(versions(t("documents")).select("doc_id", F.col("prior").alias("key")), "doc_id")
    return nearest_stored(c, e.select(F.col("doc_id").alias("key"), "embedding"))


_NORMAL = r"regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '\r\n?', chr(10), 'g'), '\n'), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_SETS = "list_distinct(case when length({x}) = 0 then []::varchar[] when length({x}) < 5 then [{x}] else list_transform(range(1, length({x}) - 3), lambda k: substr({x}, k, 5)) end)"


@query(
    _VERSIONS + f", n as (select doc_id, prior, text, tb, {_NORMAL.format(x='text')} as nt, {_NORMAL.format(x='tb')} as nb from v), j as (select *, {_SETS.format(x='nt')} as w, {_SETS.format(x='nb')} as b from n), "
    "c as (select v.doc_id, c.vec_id, max(list_cosine_similarity(c.embedding::double[], s.embedding::double[])) as best from v join embeddings c on c.vec_id // 2 = v.doc_id left join embeddings s on s.vec_id // 2 = v.prior group by all), "
    "k as (select doc_id, count(*) as m, count(*) filter (best is null or best < 0.985) as fresh from c group by doc_id), "
    f"g as (select j.doc_id, prior, text, tb, nt, nb, case when nt = nb then 1.0 when len(w) + len(b) = 0 then 0 else {_JACCARD} end as jac, coalesce(fresh / m::double, 1.0) as novel from j left join k using (doc_id)) "
    "select doc_id, case when prior is null then 'first-seen' when text = tb then 'byte-identical' when nt = nb then 'whitespace-normalized-identical' when jac >= 0.98 then 'near-duplicate-jaccard' when novel < 0.05 then 'semantic-duplicate' when novel < 1 then 'partial-novelty' else 'content-changed' end as reason, round(case when prior is null then 0 else jac end, 6) as jaccard from g"
)
def noteworthy_gates(t: Tables) -> DataFrame:
    """SIM-3: the five gates in order, on exact shingle sets."""
    g = gates(versions(t("documents")), _snapshots(t), _chunks(t), estimated=False)
    return g.select("doc_id", "reason", F.round("jaccard", 6).alias("jaccard"))


@query()
def noteworthy_by_sketch(t: Tables) -> DataFrame:
    """SIM-2/3: the same gates on MinHash sketches."""
    return gates(versions(t("documents")), _snapshots(t), _chunks(t))


def fnv1a(text: str, width: int = 5) -> np.ndarray:
    """32-bit FNV-1a hashes of a text's shingles of ``width`` characters, distinct; a shorter text is one shingle."""
    codes = np.frombuffer(text.encode("utf-16-le"), np.uint16).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint64)
    n = max(1, len(codes) - width + 1)
    h = np.full(n, 2166136261, np.uint64)
    for k in range(min(width, len(codes))):
        h = ((h ^ codes[k : k + n]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    return np.unique(h)


def _coefficients(n: int = 128) -> tuple[np.ndarray, np.ndarray]:
    draw = lambda name, k: int.from_bytes(hashlib.sha256(f"{name}:{k}".encode()).digest()[:4], "big")
    return np.array([draw("a", k) | 1 for k in range(n)], np.uint64), np.array([draw("b", k) for k in range(n)], np.uint64)


@F.pandas_udf(ArrayType(LongType()))
def minhash(texts: pd.Series) -> pd.Series:
    """128 MinHash values of each text: (a x + b) mod 4294967311 mod 2^32; empty for an empty text."""
    a, b = _coefficients()
    sets = [fnv1a(t or "") for t in texts]
    n = np.array([len(x) for x in sets])
    full = np.flatnonzero(n)
    sig = np.full((len(sets), 128), (1 << 32) - 1, np.int64)
    for block in np.split(full, np.flatnonzero(np.diff(np.cumsum(n[full]) // BLOCK)) + 1) if len(full) else ():
        first = np.concatenate(([0], np.cumsum(n[block])[:-1]))
        x = np.concatenate([sets[k] for k in block])
        # many texts at once, or one long text in pieces
        for at in range(0, len(x), len(x) if len(block) > 1 else BLOCK):
            piece = x if len(block) > 1 else x[at : at + BLOCK]
            for k in range(128):
                sig[block, k] = np.minimum(sig[block, k], np.minimum.reduceat(_permuted(piece, a[k], b[k]), first))
    return pd.Series([row if m else [] for row, m in zip(sig.tolist(), n)])


def _permuted(x: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """(a x + b) mod ``PRIME`` mod 2^32; a x + b < 2^64 for 32-bit a, b, x.

    The prime is 2^32 + 15, so the quotient is the upper half less 15 / 2^32 of it, or one less than that: shifts instead of divisions.
    """
    y = a * x
    y += b
    q = y >> np.uint64(32)
    less = q * np.uint64(15)
    less >>= np.uint64(32)
    q -= less
    q *= np.uint64(PRIME)
    y -= q
    np.add(y, np.uint64(PRIME), out=q)
    np.minimum(y, q, out=y)  # what went below zero is huge
    y &= np.uint64(0xFFFFFFFF)
    return y


@query()
def minhash_jaccard(t: Tables) -> DataFrame:
    """SIM-1/2: estimated Jaccard of each text and the one before it from its source."""
    d = t("documents")
    v = beside(versions(d).where("prior is not null"), saved(d.select("doc_id", minhash("text").alias("sig")), "sketches"))
    same = F.size(F.filter(F.zip_with("sig", "was.sig", lambda x, y: x == y), lambda x: x))
    return v.select("doc_id", (same / 128.0).alias("similarity"))
