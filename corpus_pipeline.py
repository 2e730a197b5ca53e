"""A training corpus from ``documents``: language ID, near-dedup, decontamination, secret redaction, source mixing.

Each stage takes (spark, docs, sf_dir); all but the last return documents' own columns.  ``run`` writes each stage's result to the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, minhash_dedup, mixing, secret_scan
from ledgerloom.llm.common import Scratch

#: Log likelihood of a letter by which letters without order may explain a document better than languages do; beyond it is text in none of them.
LEAST_EVIDENCE = -0.4
#: Ids to drop go to every executor up to so many; more meet the documents in a shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't among ``ids``; rows without doc_id stay."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters that the languages, or a mixture of them, explain.  Learned from the documents' own labels; without labels nothing is judged."""
    languages, model = language_id.learn(spark, docs)
    if not languages:
        return docs
    judged = language_id.predict(spark, docs, languages, model, text=True, evidence=True)
    return judged.where((F.col("lang_pred") != "und") & (F.col("evidence") >= LEAST_EVIDENCE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (shingles of five words, similarity 0.8): the one with the smallest id."""
    groups = minhash_dedup.near_duplicates(spark, docs, width=5)
    return _without(docs, Scratch(spark, "dropped").save(groups.where("not kept").select("doc_id").distinct()))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``; those without an id are searched, too."""
    return decontaminate.contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("item_ids") == 0).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets within texts; n_chars follows."""
    out = secret_scan.redact_secrets(docs, secret_scan.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: documents that the mix takes, with their columns, and size, source_size, target and taken.

    A document is taken ``taken // size`` times whole and its first ``taken % size`` words once more.
    """
    # documents without an id are told apart by their texts, or all of them would have one key
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    sized = docs.withColumn("_n", mixing.n_words(F.col("text"))).withColumn("_name", name)
    sized = Scratch(spark, "sized").save(sized)  # the words are counted once
    return mixing.mix(sized, F.col("_n"), name=F.col("_name")).where("taken > 0").drop("_n", "_name")


STAGES = [("language_id", language), ("minhash_dedup", near_dedup), ("decontaminate", clean_of_benchmark), ("secret_scan", without_secrets), ("mixing", mix)]

#: Mixture inference, near-duplicate groups and latent search aren't SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
