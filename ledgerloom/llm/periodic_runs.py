"""Periodic run detection: repeated grams of words are seeds on diagonals, each extended once, over whole texts.

A stretch of words with period q and at least 4q words agrees with itself q words on over at least 3q words.  For periods of one scale,
2^s to 2^(s+1) - 1, the grams of 3 * 2^s words (5 at s = 0) are therefore met inside every run; and as such a gram is no shorter than the
period, the next place of an equal gram of the text lies exactly one smallest period on.  So the pairs of neighbouring occurrences are all that
is needed: never more than one for each word and scale.  Grams are named exactly, each from two shorter ones, and only grams that
occur again are named further, so that the scales thin out quickly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, text_batches, text_buffers

#: A run has this many words at least, and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

# ----------------------------------------------------------------------------- words


def words_named(buf: np.ndarray, off: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, their names, pointers): equal words of one text share a name, words of two texts never do."""
    texts, names, ptr, base = [], [], [0], 0
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        words = buf[a:b].tobytes().split()
        ids = dict.fromkeys(words)
        for k, word in enumerate(ids, base):
            ids[word] = k
        base += len(ids)
        names.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        texts.append(words)
        ptr.append(ptr[-1] + len(words))
    return texts, np.concatenate(names) if names else np.zeros(0, np.int64), np.array(ptr)


# ----------------------------------------------------------------------------- seeds


def longer(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """Names of the grams made of ``left`` at i and ``right`` at i + gap; -1 where either has none or the gram occurs once only."""
    out = np.full(len(left), -1, np.int64)
    at = np.flatnonzero((left[: len(left) - gap] >= 0) & (right[gap:] >= 0)) if gap < len(left) else np.zeros(0, np.int64)
    if len(at):
        pairs = left[at] * (int(right.max()) + 1) + right[at + gap]
        _, name, count = np.unique(pairs, return_inverse=True, return_counts=True)
        again = count[name] > 1
        out[at[again]] = name[again]
    return out


def seeds(grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of neighbouring occurrences of equal grams whose lag is of this scale, in order of lag and place."""
    at = np.flatnonzero(grams >= 0)
    at = at[np.argsort(grams[at], kind="stable")]
    lag = np.diff(at)
    ok = (grams[at[1:]] == grams[at[:-1]]) & (lag >= 1 << scale) & (lag < 2 << scale)
    place, lag = at[:-1][ok], lag[ok]
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def scales(names: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(scale, words of a gram, names of the grams) while there are grams that occur again."""
    if not len(names):
        return
    one = np.where(np.bincount(names)[names] > 1, names, -1)
    two = longer(one, one, 1)
    four = longer(two, two, 2)
    yield 0, 5, longer(four, one, 4)
    scale, n, grams = 1, 6, longer(four, two, 4)
    while (grams >= 0).any():
        yield scale, n, grams
        scale, n, grams = scale + 1, 2 * n, longer(grams, grams, n)


# ----------------------------------------------------------------------------- extension


def agreement(names: np.ndarray, at: int, lag: int, n: int) -> tuple[int, int]:
    """The widest range around [at, at + n) in which every word equals the one ``lag`` on."""
    first, last, step = at, at + n, 64
    while last + lag < len(names):
        to = min(last + step, len(names) - lag)
        differ = np.flatnonzero(names[last:to] != names[last + lag : to + lag])
        if len(differ):
            last += int(differ[0])
            break
        last, step = to, 2 * step
    step = 64
    while first > 0:
        to = max(first - step, 0)
        differ = np.flatnonzero(names[to:first] != names[to + lag : first + lag])
        if len(differ):
            first = to + int(differ[-1]) + 1
            break
        first, step = to, 2 * step
    return first, last


def runs_of(names: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) in order of start and period, for the words of any number of texts one after the other."""
    found = []
    for scale, n, grams in scales(names):
        place, lag = seeds(grams, scale)
        # a seed beside the seed before it lies in the same range
        head = np.ones(len(place), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
        covered: dict[int, int] = {}  # by lag, how far it is known
        for at, q in zip(place[head].tolist(), lag[head].tolist()):
            if at < covered.get(q, 0):
                continue
            first, covered[q] = agreement(names, at, q, n)
            length = covered[q] - first + q
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((first, length, q))
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


# ----------------------------------------------------------------------------- operator


@released
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            texts, names, ptr = words_named(*text_buffers(b.column("text")))
            runs = runs_of(names)
            first = np.searchsorted(runs[:, 0], ptr)
            dropped = np.zeros(len(names) + 1, np.int64)
            np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
            np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(dropped)[:-1] == 0
            text = [b" ".join(words) if a == z else b" ".join([words[k] for k in np.flatnonzero(kept[at : at + len(words)])]) for words, at, a, z in zip(texts, ptr.tolist(), first[:-1], first[1:])]
            start = runs[:, 0] - np.repeat(ptr[:-1], np.diff(first))
            rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, runs[:, 1], runs[:, 2])], names=["start", "length", "period"])
            runs_column = pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([b.column("_row"), runs_column, pa.array(text, pa.binary()).cast(pa.string())], names=["_row", "runs", "collapsed"])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (which has text) with ``runs``, an array of (start, length, period) in words by start and period, and ``collapsed``, the words without repeats.

    Words are runs of characters other than ASCII white space, numbered from 0.  A run is a stretch of ``LEAST_PERIODS`` smallest periods and ``LEAST_WORDS``
    words or more that no neighbouring word extends.  ``collapsed`` keeps of each run the first period, words joined by one space.
    Columns of these two names are replaced, others stay.  A null, empty or blank text has no runs and an empty ``collapsed``; very long ones are read
    whole; runs of different periods may overlap and all are given; rows that repeat are separate rows; an empty table gives an empty result.  Nothing is shuffled.
    """
    text_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rows = docs.select(F.struct(*columns).alias("_row"), F.col("text").alias("text"))
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(_find, schema).select(*(F.col("_row").getField(c).alias(c) for c in columns), "runs", "collapsed")


def highest(runs: Column) -> Column:
    """The run with the most periods, compared as exact fractions; the first one of equals; null if there is none."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    return F.aggregate(runs, F.lit(None).cast(kind), lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


# ----------------------------------------------------------------------------- query


def looped(text: Column, doc_id: Column) -> Column:
    """The text of a tenth of the documents, by a hash of the id, with everything behind some word repeating a stretch of its words; of others the text itself."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), at), " "))

    # the array of one list of words binds its element, so that the words are found once
    words = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return F.when(h % 10 == 0, F.coalesce(F.get(F.transform(words, loop), F.lit(0)), text)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the highest run, and digests of all runs and of the collapsed text, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = collapse_runs(docs.select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), highest(F.col("runs")).alias("_best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli")
    return best.select("doc_id", "n_runs", "_best.start", "_best.length", "_best.period", milli, "runs_sha256", "collapsed_sha256")


def _op12_sql(deepest: int = 16) -> str:
    """The same by tables of grams, for periods below 2^deepest."""
    grams = "".join(
        f"""g{k} as (
  select r, i, name from (select a.r, a.i, min(a.i) over w as name, count(*) over w as c from g{k - 1} a join g{k - 1} b on a.r = b.r and b.i = a.i + {3 << k - 1} window w as (partition by a.r, a.name, b.name)) where c > 1),
"""
        for k in range(2, deepest)
    )
    lags = " union all ".join(f"select * from (select r, i, lead(i) over (partition by r, name order by i) - i as q from g{k}) where q >= {1 << k} and q < {2 << k}" for k in range(deepest))
    gram = lambda n: " || ' ' || ".join(f"lead(x, {k}) over p" for k in range(n))
    first = lambda n: f"select r, i, name from (select r, i, min(i) over (partition by r, g) as name, count(*) over (partition by r, g) as c from (select r, i, {gram(n)} as g from w window p as (partition by r order by i)) where g is not null) where c > 1"
    return rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words,
         xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)), 4294967295) as h
  from documents),
v as (select *, len(words) as n, h // 10 as g from d),
u as (select *, case when n > 0 then g % n end as a, case when n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from v),
w as (
  select r, i, case when h % 10 = 0 and i >= a then words[a + (i - a) % p + 1] else words[i + 1] end as x
  from (select *, unnest(range(n)) as i from u)),
g0 as ({first(5)}),
g1 as ({first(6)}),
{grams}
s as materialized ({lags}),
m as (select a.r, q.q, a.i, a.i - row_number() over (partition by a.r, q.q order by a.i) as island from (select distinct r, q from s) q join w a on a.r = q.r join w b on b.r = a.r and b.i = a.i + q.q and a.x = b.x),
n as (select r, q, min(i) as start_, max(i) + 1 - min(i) + q as length_ from m group by r, q, island),
runs as materialized (select * from n where length_ >= greatest(6, 4 * q) and exists (select 1 from s where s.r = n.r and s.q = n.q and s.i between n.start_ and n.start_ + n.length_ - n.q - 1)),
best as (select * from (select *, row_number() over (partition by r order by length_::double / q desc, start_, q) as k from runs) where k = 1),
kept as (select r, string_agg(x, ' ' order by i) as t from w where not exists (select 1 from runs where runs.r = w.r and w.i >= start_ + q and w.i < start_ + length_) group by r),
listed as (select r, count(*) as n_runs, string_agg(start_ || ',' || length_ || ',' || q || chr(10), '' order by start_, q) as t from runs group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, start_::bigint as start, length_::bigint as length, q::bigint as period, (1000 * length_ // q)::bigint as exponent_milli,
       sha256(coalesce(listed.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
from d left join best using (r) left join kept using (r) left join listed using (r)
"""


OP12_SQL = _op12_sql()
