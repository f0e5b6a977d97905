"""URL filters: a blocked Bloom filter of the listed URL prefixes, then an exact hash join.

Every url is turned into the keys under which a rule could list it: each suffix of its host, whole labels only, with each
prefix of its path that is as long as some rule's path. A key that the Bloom filter doesn't know is dropped where it
stands; the few others meet the rules in a hash join, which removes false positives, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the contract: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row for each row of `pages` (page_id, url): page_id, url, host, path, rule, verdict.

    `rules`: verdict, host, path. A rule fits its host and all subdomains if the url's path starts with the rule's; the
    longest (host and path together) wins, block before allow among equally long ones; without one the verdict is
    `default` and rule is null. A null url, or one without ://, has an empty host and path. Further columns are not read.

    The filter is a table of words that is broadcast, sized by the number of rules and bounded by common.with_bloom_mark;
    what passes meets the rules by key and then the pages by url, where common keys and urls are spread.
    """
    rules = common.staged(rules.select("verdict", F.concat("host", "path").alias("key")).dropDuplicates(["verdict", "key"]), "rules")
    lengths = sorted(r[0] for r in rules.select(F.length(F.regexp_extract("key", "/.*", 0))).distinct().toLocalIterator())  # distinct lengths only
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(fits, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n)))))
    keyed = urls.filter("host != ''").select("url", F.explode(keys).alias("key"))
    hits = common.with_bloom_hits(keyed, F.xxhash64("key"), rules.select(F.xxhash64("key").alias("h")), rules.count())
    hits = common.staged(hits.distinct(), "hits")
    found = common.spread_join(hits, rules, "key")
    best = found.groupBy("url").agg(F.max(F.struct(F.length("key").alias("n"), (F.col("verdict") == "block").alias("b"), "key")).alias("best"))
    best = common.staged(best.select("url", F.col("best.key").alias("rule"), F.when(F.col("best.b"), "block").otherwise("allow").alias("judged")), "judged")

    marked = common.with_bloom_mark(urls, F.xxhash64("url"), best.select(F.xxhash64("url").alias("h")), best.count()).withColumn("__maybe", F.col("__maybe") & F.col("url").isNotNull())
    judged = common.spread_join(marked.filter("__maybe"), best, "url", "left")
    others = marked.filter("not __maybe").select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("judged"))
    return judged.unionByName(others).select("page_id", "url", "host", "path", "rule", F.coalesce("judged", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge_urls(spark, common.read(spark, sf_dir, "pages"), rules).drop("url")


OP5_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM pages),
rules(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT r, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (r)
"""
