"""Mixing sources to target weights: hash-random keys, a range sort within each source, prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Documents that one range of keys holds on average; ranges are sorted and summed on their own.
PER_RANGE = 1_000
MOST_REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: A table of sources, or of ranges, goes to every task up to so many rows; a larger one meets the documents in a shuffle.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, weight): weight's share of all sizes, at most ``most`` times the size.

    target = min(most * size, level * weight); the level follows from prefix sums over the sources in the order in
    which they reach their ceiling.  The window runs over one row per source.
    """
    s = sources.withColumn("_cap", F.col("source_size") * most).withColumn("_at", F.col("_cap") / F.col("weight"))
    w = Window.orderBy("_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("_before", F.coalesce(F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_rest", F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.sum("source_size").over(everything) - F.col("_before")) / F.col("_rest"))
    s = s.withColumn("_free", F.col("_level") <= F.col("_at"))
    s = s.withColumn("_level", F.max(F.when(F.col("_free"), F.struct(-F.col("_at"), -F.col("_before"), F.col("_level").alias("x")))).over(everything)["x"])
    target = F.when(F.col("_free"), F.col("_level") * F.col("weight")).otherwise(F.col("_cap").cast("double"))
    return s.withColumn("target", target).drop("_cap", "_at", "_before", "_rest", "_level", "_free")


def sizes(docs: DataFrame, scratch: Scratch, *columns: str) -> DataFrame:
    """(doc_id, source, *columns, name, size): a table that reads every text once.  ``name`` is the id, or the text's digest where that is null."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return scratch.save(docs.select("doc_id", "source", *columns, name.alias("name"), n_words(F.col("text")).alias("size")))


def mix(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = "mix-1", name: Column | None = None) -> DataFrame:
    """Adds size, source_size, target and taken to ``docs`` (which has doc_id and source); columns of these names are replaced.

    Sources stand by code point, null last, and weigh ``weights`` in turn.  A source whose target exceeds its size is
    repeated in whole epochs; the last, partial epoch takes documents in the order of a hash of (seed, ``name``), the name being
    the doc_id unless said otherwise, and cuts the last one at the exact word.  Equal keys are ordered by doc_id and size; rows that repeat are
    separate rows.  A null text has size 0 and takes nothing; a very long one counts whole.  An empty table gives an empty result.

    The keys are uniform, so equal ranges of keys hold equal shares of a source however large it is: sums per range,
    a running total over the ranges (a few numbers per source) and a running total inside each range make the prefix sum.
    ``docs`` is read several times: give it texts only where they are cheap to read, see ``sizes``.
    """
    columns = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    name = F.col("doc_id") if name is None else name
    # names of the working columns that no column of docs has
    key = F.conv(F.left(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(name.cast("string"), F.lit("")))), F.lit(15)), 16, 10).cast("long")
    d = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_from"), size.cast("long").alias("size"), key.alias("_key"))
    by_source = d.groupBy("_from").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")).withColumnRenamed("_from", "source")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_source = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    targets = water_fill(by_source, most)
    # one row per source
    targets = targets.withColumn("_bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("_rows") / PER_RANGE))).cast("int"))
    scratch = Scratch(docs.sparkSession, "mix")
    t = scratch.save(targets.select(F.col("source").alias("_source"), "source_size", "target", "_bits"))
    d = d.join(_small(t), F.col("_from").eqNullSafe(F.col("_source")), "left").drop("_source")
    # 60-bit keys: the first bits name the range
    d = d.withColumn("_range", F.expr("shiftright(_key, 60 - _bits)"))
    ranges = d.groupBy("_from", "_range").agg(F.sum("size").alias("_sum"))
    start = F.sum("_sum").over(Window.partitionBy("_from").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    r = scratch.save(ranges.select(F.col("_from").alias("_source"), F.col("_range").alias("_r"), F.coalesce(start, F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_from", "_range").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(_small(r), F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("_start") - F.col("_in")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return d.select(*(F.col("_row").getField(c).alias(c) for c in columns), "size", "source_size", "target", taken.cast("long").alias("taken"))


def _small(table: DataFrame) -> DataFrame:
    """The table, marked for every task if it is known to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    docs = sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "sizes"))
    return mix(docs, F.col("size"), name=F.col("name")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || left(md5('mix-1:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 15))::bigint as k
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s),
c as (select *, (source_size * 3) / weight as at_ from w),
l as (
  select *, (sum(source_size) over () - coalesce(sum(source_size * 3) over (order by at_, source nulls last rows between unbounded preceding and 1 preceding), 0))::bigint::double
    / sum(weight) over (order by at_, source nulls last rows between current row and unbounded following) as level_
  from c),
f as (select min(struct_pack(a := at_, l := level_)) as m from l where level_ <= at_),
t as (select source, source_size, case when level_ <= at_ then (select m.l from f) * weight else (source_size * 3)::double end as target from l),
p as (
  select d.*, t.source_size, t.target,
         coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before_
  from d join t on d.source is not distinct from t.source),
q as (select *, floor(target)::bigint as budget, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(budget - epochs * source_size - before_, size)))::bigint as taken
from q
"""
