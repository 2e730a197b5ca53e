"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

Everything here is DataFrame functions.  Each URL is expanded into every (host suffix, path prefix) that a rule could
name; the expressions meet the rules on the first bits of a digest, full digests confirm, and the most specific rule
wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A rule table of at most so many rows goes to every executor; a larger one meets the expressions in a shuffle.
BROADCAST_RULES = 100_000
#: Hex digits of the digest that the join uses.
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased.  Null or no ``://``: empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def apply_rules(spark: SparkSession, pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``.

    ``rules`` has host, path, verdict.  A rule fits its host and all subdomains when the URL's path starts with the
    rule's path; the rule with the longest host, then the longest path, wins; between equal rules ``block`` wins.  (Rules whose host is
    longer but whose host and path together are shorter than another's win too: a host is more specific than a path.)
    No rule: ``rule`` is null, the verdict is ``default``.  A null or malformed URL has an empty host and path, fits no rule and
    gets the default, without being joined.  Rules with a null part, or with a verdict other than allow or block, are ignored.  Repeated rows
    give repeated results, an empty table an empty one, a very long URL is read whole; columns of these four names are replaced.

    The paths' lengths that occur in the rules (at most a few hundred: URLs are short) bound the prefixes tried.
    """
    good = rules.where("host is not null and path is not null and verdict in ('allow', 'block')").select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v")
    )
    good = good.groupBy("_h", "_p").agg(F.max("_v").alias("_v"))
    n, lengths = good.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.length("_p")))).first()
    good = good.select("_h", "_p", "_v", digest(F.col("_h"), F.col("_p")).alias("_full")).withColumn("_short", F.left("_full", F.lit(PREFIX_HEX)))
    if n <= BROADCAST_RULES:
        good = F.broadcast(good)

    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # the caller's columns travel as one, so that no working column meets them
    base = pages.select(F.struct(*columns).alias("_row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    own = [F.col("_row").getField(c).alias(c) for c in columns]
    if not n:
        return base.select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Labels of the host; suffix k drops the first k of them.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(int(x)) for x in lengths]), lambda k: k <= F.length("path")), lambda k: F.left(F.col("path"), k))
    # Equal (host, path) pairs are judged once: a page table repeats its hosts.
    pairs = base.select("host", "path").where("host != ''").distinct()
    expressions = pairs.select("host", "path", F.explode(suffixes).alias("_eh")).select("host", "path", "_eh", F.explode(prefixes).alias("_ep"))
    expressions = expressions.withColumn("_efull", digest(F.col("_eh"), F.col("_ep"))).withColumn("_short", F.left("_efull", F.lit(PREFIX_HEX)))
    hits = expressions.join(good, "_short").where((F.col("_efull") == F.col("_full")))
    # length-first structs: max() is the precedence
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("_h").alias("a"), F.length("_p").alias("b"), F.col("_v").alias("v"), F.concat("_h", "_p").alias("r"))).alias("_best")
    )
    # urls without a host share one key: they go past the join
    judged = base.where("host != ''").join(best, ["host", "path"], "left").unionByName(base.where("host = ''").withColumn("_best", F.lit(None).cast(best.schema["_best"].dataType)))
    return judged.select(*own, "host", "path", F.col("_best.r").alias("rule"), F.coalesce(F.col("_best.v"), F.lit(default)).alias("verdict"))


#: The contract's rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    # as literals: no Python rows
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))))
    return apply_rules(spark, pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1), '') as path
  from pages),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (
  select page_id, h || p as rule, v, row_number() over (partition by page_id order by length(h) desc, length(p) desc) as k
  from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') as verdict
from u left join m on u.page_id = m.page_id and m.k = 1
"""
