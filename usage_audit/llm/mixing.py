"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Sources share the total by weight; none is repeated more than `max_epochs` times. A source whose share is above its
cap is clamped there and what it leaves is shared by the others in proportion to their weights, until none is above.
Sorted by cap / weight, the clamped sources are a prefix, so one running sum over the sources finds the final level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.joins import unused
from . import common

#: A source is cut into 2**this slices by hash, and the one where its target ends into as many once more: in the last one
#: there is one row of 16 millions.
SLICE_BITS = 12


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """`sources` (source_size, weight, one row a source) with ``target``: shares of the sum of all sizes.

    Sizes of zero get zero. The targets add up to that sum when max_epochs is 1 or more.
    """
    cap = F.lit(max_epochs) * F.col("source_size")
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = W.partitionBy()
    ranked = sources.withColumn("cap", cap).withColumn("total", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # a source is clamped when its share of what is left would be above its cap
    ranked = ranked.withColumn("clamped", F.col("weight") * F.col("left") > F.col("cap") * F.col("open"))
    clamped = F.sum(F.when(F.col("clamped"), F.col("cap"))).over(whole)
    clamped_weight = F.sum(F.when(F.col("clamped"), F.col("weight"))).over(whole)
    share = F.col("weight") * (F.col("total") - F.coalesce(clamped, F.lit(0))) / (F.col("all_weight") - F.coalesce(clamped_weight, F.lit(0)))
    return ranked.withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share.cast("double"))).drop("cap", "total", "all_weight", "left", "open", "clamped")


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``rank`` by code point (null last) and ``weight``, which repeats `weights` in that order."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*map(F.lit, weights))
    return sources.withColumn("rank", rank).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))


def place(seed: int) -> Column:
    """A row's place, 0 to 2**60 - 1, in an order that follows from the seed, its doc_id and its text alone."""
    parts = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, source): doc_id, size, source_size, target, taken, repeats.

    size counts the words (null text: 0). A document is taken whole `repeats` times: as often as its source's target
    holds the source, and once more if, in the source's order by seeded hash, the rest of the target holds it and all
    before it; one document more, of the size nearest to what is then missing, comes from all others of the source.
    So each source gives what its target says but for a fraction of a document, equal input gives equal output, and no
    document exceeds max_epochs times its size. Documents without words are repeated 0 times. Rows without source form
    a source of their own. Repeated rows are treated alike. Further columns are not read; no rows give no rows.
    """
    words = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"), place(seed).alias("place"))
    sized = common.staged(words, "sizes").withColumn("coarse", F.shiftright("place", 60 - SLICE_BITS)).withColumn("fine", F.shiftright("place", 60 - 2 * SLICE_BITS))

    sums = sized.groupBy("source", "coarse").agg(F.sum("size").alias("slice_size"))
    sources = cyclic_weights(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights)
    filled = water_fill(sources, max_epochs).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    filled = filled.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    filled = common.staged(filled.select(F.col("source").alias("of"), "source_size", "target", "times", "rest"), "targets")

    def ends_in(sums: DataFrame, rests: DataFrame, key: str, at: str) -> DataFrame:
        """(of, at, rest, before): the slice in which each source's rest ends, and the words of its earlier slices."""
        running = W.partitionBy("source").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
        earlier = sums.withColumn("sum", F.coalesce(F.sum("slice_size").over(running), F.lit(0))).join(rests, F.col("source").eqNullSafe(F.col("of")))
        earlier = earlier.withColumn("before", F.col("before") + F.col("sum"))
        ends = earlier.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("slice_size")))
        return ends.select("of", F.col(key).alias(at), "rest", "before")

    # in the fine slice of each source where the rest ends, a running sum finds the last document that is taken
    same = F.col("source").eqNullSafe(F.col("of"))
    at_coarse = ends_in(sums, filled.select("of", "rest", F.lit(0).cast("long").alias("before")), "coarse", "at_coarse")
    parts = sized.join(at_coarse.select("of", "at_coarse"), same & (F.col("coarse") == F.col("at_coarse"))).groupBy("source", "fine").agg(F.sum("size").alias("slice_size"))
    at = common.staged(ends_in(parts, at_coarse.select("of", "rest", "before"), "fine", "at"), "ends")
    row = W.partitionBy("of").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    worded = sized.filter("size > 0").join(at, same)
    left = F.col("rest") - (F.col("before") + F.sum("size").over(row))
    inside = common.staged(worded.filter("fine = at").select("of", "place", "size", left.alias("left")), "inside")
    fits = F.col("left") >= 0
    last = at.join(inside.groupBy(F.col("of").alias("i_of")).agg(F.max(F.when(fits, F.col("place"))).alias("last"), F.min(F.when(fits, F.col("left"))).alias("gap")), F.col("of").eqNullSafe(F.col("i_of")), "left")
    last = common.staged(last.select("of", "at", "last", F.coalesce(F.col("gap"), F.col("rest") - F.col("before")).alias("gap")), "last")
    # of all documents that are left, the one nearest in size to the gap
    onward = worded.filter("fine > at").select(F.col("of").alias("l_of"), "place", "size").unionByName(inside.filter(~fits).select(F.col("of").alias("l_of"), "place", "size"))
    off = F.abs(F.col("size") - F.col("gap"))
    extra = onward.join(last.select("of", "gap"), F.col("l_of").eqNullSafe(F.col("of"))).filter(off < F.col("gap")).groupBy("of").agg(F.min(F.struct(off.alias("off"), "place"))["place"].alias("extra"))
    cuts = filled.join(last.select(F.col("of").alias("l_of"), "at", "last"), F.col("of").eqNullSafe(F.col("l_of")), "left").join(extra.withColumnRenamed("of", "e_of"), F.col("of").eqNullSafe(F.col("e_of")), "left")
    cuts = common.staged(cuts.select("of", "source_size", "target", "times", "at", "last", "extra"), "cuts")

    more = F.when((F.col("fine") < F.col("at")) | (F.col("place") <= F.col("last")) & (F.col("fine") == F.col("at")) | (F.col("place") == F.col("extra")), 1).otherwise(0)
    repeats = F.when(F.col("size") == 0, 0).otherwise(F.col("times") + more).cast("long")
    mixed = sized.join(cuts, same).withColumn("repeats", repeats)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "source", "place")


def repeated(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """`docs` as the mix takes them: each row as many times as mix() says, with the columns of `docs`."""
    of, at, key, times, n = (unused(name, docs) for name in ("of", "at", "key", "times", "n"))
    mixed = mix(spark, docs, **options).select(F.col("doc_id").alias(of), F.col("place").alias(at), F.col("repeats").alias(times)).filter(F.col(times) > 0).distinct()
    joined = docs.withColumn(key, place(options.get("seed", 17))).join(mixed, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(key) == F.col(at)))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, common.read(spark, sf_dir, "documents")).drop("source", "place")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, 1 + rank % 3 AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS unspent, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open FROM w
      WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * unspent > cap * open AS clamped FROM l),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE
        ((weight * (sum(source_size) OVER () - coalesce(sum(cap) FILTER (clamped) OVER (), 0)))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) FILTER (clamped) OVER (), 0))::DOUBLE) END AS target FROM c),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
r AS (SELECT *, target - times * source_size AS rest FROM f),
x AS (SELECT d.*, r.source_size, r.target, r.times, r.rest, r.rest - sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS unfilled
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
g AS (SELECT *, coalesce(min(unfilled) FILTER (unfilled >= 0 AND size > 0) OVER (PARTITION BY source), rest) AS gap FROM x),
n AS (SELECT *, max(place) FILTER (unfilled >= 0 AND size > 0) OVER (PARTITION BY source) AS last,
             min(struct_pack(a := abs(size - gap), b := place)) FILTER (size > 0 AND unfilled < 0 AND abs(size - gap) < gap) OVER (PARTITION BY source) AS near FROM g),
m AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE times + (coalesce(place <= last, false) OR coalesce(place = near.b, false))::INT END AS repeats FROM n)
SELECT doc_id, size, source_size, target, size * repeats AS taken, repeats FROM m
"""
