"""A keyword index that takes new, changed and deleted documents: segments that are never rewritten, tombstones, merging by size.

In the index's folder ``postings/seq=N`` is the segment of operation N, by the hash of the term, ``deleted/seq=N`` says which documents of which segments it took away, and ``log`` has a row
for each finished operation.  An operation whose row isn't there is ignored, and the next one with its number replaces its folders.  One writer at a time; readers see whole operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..jobs.catalog import query
from ..sources.ledger import Tables
from ..sources.scratch import new_folder, saved
from .retrieval import BM25_SQL, PARTS, _questions, _texts, _TOP, counted, score_bm25, top, write_postings

#: So many segments of one size (within a factor of this number) become one.
MERGE = 4
LOG = "seq long, kind string, segment boolean, merged array<long>, docs long, words long, doc_type string"


@dataclass
class LivingIndex:
    """The index in a folder that driver and executors share.

    A document added again replaces what it was; one with a null text is taken away; rows without an id are left out; repeated ids within one addition are an error, and
    nothing of it counts.  An empty text counts as a document, without words.
    """

    spark: SparkSession
    path: str

    def log(self) -> list:
        """The finished operations in order; small, a row for each."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return sorted(self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect(), key=lambda r: r.seq) if there else []

    def _commit(self, log: list, kind: str, docs: int, total: int, doc_type: str, merged: tuple[int, ...] = ()) -> None:
        row = (self._next(log), kind, kind != "delete" and docs > 0, list(merged), docs, total, doc_type)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    @staticmethod
    def _next(log: list) -> int:
        return log[-1].seq + 1 if log else 1

    @staticmethod
    def segments(log: list) -> list:
        gone = {s for r in log for s in r.merged}
        return [r for r in log if r.segment and r.seq not in gone]

    def _postings(self, log: list, segments: list) -> DataFrame:
        read = self.spark.read.option("basePath", f"{self.path}/postings").schema(f"term string, doc {log[-1].doc_type}, tf long, length int, seq long, part int")
        return read.parquet(*(f"{self.path}/postings/seq={r.seq}" for r in segments))

    def _deleted(self, log: list, segments: list) -> DataFrame:
        """(doc, dead, length): documents of these segments that later operations took away."""
        folders = [f"{self.path}/deleted/seq={r.seq}" for r in log if r.kind != "merge"]
        return self.spark.read.schema(f"doc {log[-1].doc_type}, dead long, length int").parquet(*folders).where(F.col("dead").isin([r.seq for r in segments]))

    def postings(self, log: list, terms: list[str] | None = None, segments: list | None = None) -> DataFrame:
        """Postings (term, doc, tf, length, seq) of documents that are there, of some terms or all; only the terms' parts and row groups are read."""
        segments = self.segments(log) if segments is None else segments
        p = self._postings(log, segments)
        if terms is not None:
            parts = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(PARTS)).cast("int")).distinct().collect()]
            p = p.where(F.col("part").isin(parts) & F.col("term").isin(terms))
        dead = self._deleted(log, segments).select("doc", F.col("dead").alias("seq"))
        return p.drop("part").join(dead, ["doc", "seq"], "left_anti")

    def _take_away(self, log: list, ids: DataFrame) -> None:
        """Tombstones for what the index has of these ids (doc)."""
        out = f"{self.path}/deleted/seq={self._next(log)}"
        if self.segments(log):
            known = self.postings(log, [""]).select("doc", F.col("seq").alias("dead"), "length")
            known.join(ids.select("doc").distinct(), "doc", "left_semi").write.mode("overwrite").parquet(out)
        else:
            ids.select("doc", F.lit(0).cast("long").alias("dead"), F.lit(0).alias("length")).limit(0).write.mode("overwrite").parquet(out)

    def _write(self, rows: DataFrame, seq: int) -> None:
        """A segment."""
        write_postings(rows, f"{self.path}/postings/seq={seq}")

    def add(self, docs: DataFrame, id_: str, text: str) -> None:
        log = self.log()
        seq, kind = self._next(log), docs.schema[id_].dataType.simpleString()
        d = docs.where(F.col(id_).isNotNull()).select(F.col(id_).alias("doc"), F.col(text).alias("text"))
        self._write(counted(d), seq)
        own = self.spark.read.schema(f"term string, doc {kind}, tf long, length int, part int").parquet(f"{self.path}/postings/seq={seq}").where("term = ''")
        n = own.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"), F.count_distinct("doc").alias("ids")).first()
        if n.ids < n.docs:
            raise ValueError("an id repeats within the documents to add")
        self._take_away(log, d)
        self._commit(log, "add", n.docs, n.words, kind)

    def delete(self, ids: DataFrame, id_: str) -> None:
        log = self.log()
        self._take_away(log, ids.select(F.col(id_).alias("doc")))
        self._commit(log, "delete", 0, 0, log[-1].doc_type if log else ids.schema[id_].dataType.simpleString())

    def merge(self) -> bool:
        """Makes one segment of ``MERGE`` or more of a size, without what was taken away since; false if there is nothing to do."""
        log, sizes = self.log(), {}
        for r in self.segments(log):
            sizes.setdefault(int(math.log(r.docs, MERGE)), []).append(r)
        own = next((x for _, x in sorted(sizes.items()) if len(x) >= MERGE), None)
        if own is None:
            return False
        seq = self._next(log)
        self._write(self.postings(log, segments=own), seq)
        n = self.spark.read.schema(f"term string, doc {log[-1].doc_type}, tf long, length int, part int").parquet(f"{self.path}/postings/seq={seq}").where("term = ''")
        n = n.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        self._commit(log, "merge", n.docs, n.words, log[-1].doc_type, tuple(r.seq for r in own))
        return True

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc, bm25), as ``bm25`` over the documents that are there, for a block of queries (query_id, text), whose terms come to the driver."""
        log = self.log()
        if not log:
            raise ValueError(f"there is no index in {self.path}")
        terms = queries.select("query_id", F.explode(query_terms(F.lower("text"))).alias("term"))
        own = self.segments(log)
        if not own:
            return terms.select("query_id", F.lit(None).cast(log[-1].doc_type).alias("doc"), F.lit(0.0).alias("bm25")).limit(0)
        gone = self._deleted(log, own).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
        n, total = sum(r.docs for r in own), sum(r.words for r in own)
        stats = gone.select((F.lit(n) - F.col("n")).alias("n"), F.try_divide(F.lit(total) - F.col("words"), F.lit(n) - F.col("n")).alias("mean"))
        tf = self.postings(log, [r.term for r in terms.select("term").distinct().collect()])
        return score_bm25(saved(tf.drop("seq"), "hits"), stats, terms)


@query("with " + BM25_SQL + _TOP, "ranked_facts")
def bm25_living_index(t: Tables) -> DataFrame:
    """SRC-14, RET-2: the twenty best facts of every query from an index to which all facts came in parts, under older texts before, and from which archived ones went."""
    facts, index = t.ranked_facts(), LivingIndex(t.spark, new_folder(t.spark, "living"))
    part = F.pmod(F.xxhash64("fact_id"), F.lit(4))
    for k in range(4):
        index.add(facts.where(part == k), "fact_id", "subject")
    index.merge()
    index.add(_texts(facts), "fact_id", "words")
    index.delete(facts.where("archived"), "fact_id")
    found = index.search(_questions(t)).withColumn("bm25", F.round("bm25", 6))
    return top(found, 20, "bm25", "doc").drop("rank")
