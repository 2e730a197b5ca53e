"""Rows beside the row before them, and connected nodes, without one task that holds a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, group: list[str], slot: Column, order: list[str], values: list[str]) -> DataFrame:
    """Adds ``before``, a struct of ``values`` of the row before in the group's order; null for the first.

    Slots must not descend along the order.  Windows run inside a slot, and over the last rows of the slots, of which a group has few;
    so a hot group is sorted slot by slot.
    """
    columns = [c for c in rows.columns if c != "before"]
    key = [f"_{k}" for k in range(len(group))]
    r = rows.select(F.struct(*columns).alias("_row"), slot.alias("_slot"), F.struct(*values).alias("_v"), F.struct(*order).alias("_at"), *(F.col(c).alias(k) for c, k in zip(group, key)))
    r = r.withColumn("_in", F.lag("_v").over(Window.partitionBy(*key, "_slot").orderBy("_at")))
    last = r.groupBy(*key, "_slot").agg(F.max_by("_v", "_at").alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*key).orderBy("_slot")))
    last = last.select(*(F.col(c).alias(f"{c}_") for c in (*key, "_slot")), "_carry")
    same = F.lit(True)
    for c in (*key, "_slot"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return r.join(last, same, "left").select(*(F.col("_row").getField(c).alias(c) for c in columns), F.coalesce("_in", "_carry").alias("before"))


def connected(edges: DataFrame, save: Callable[[DataFrame], DataFrame], drop: Callable[[DataFrame], None] = lambda df: None) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b): the smallest node it reaches.  Alternating stars: union-find in two joins a round.

    ``save`` writes a round's table and reads it again; ``drop`` is told of those that aren't needed any more.  Loops and repeated edges are allowed, null ends are ignored.  Joins are on nodes, never on
    components; a node with very many neighbours is one row with a minimum.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = save(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = mark(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        new = save(joined.select(F.explode(ends).alias("x")).select("x.*").where("a != b").distinct())
        drop(e)
        e, before, now = new, now, mark(new)
        if now == before:
            break
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
