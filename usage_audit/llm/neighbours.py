"""Approximate nearest neighbours by multiprobe p-stable hashing.

For the largest inner product, vectors get one coordinate more that brings all to one length; then the nearest in
Euclidean distance have the largest product. Each of TABLES tables hashes a vector by a few Gaussian projections, cut
into slots of one width. A query visits, in each table, its own bucket and the neighbouring ones in the order in
which they are likely to hold its neighbours: by the squared distances from its projections to the slots' borders. All
candidates are scored exactly; a query's own buckets come first, and what they yield is the bar for the others. Queries
that find too few are compared with all vectors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .ngrams import _groups, _runs

TABLES, WIDTH = 10, 1.0
#: Numbers of projections to choose from, and the most probes a table.
PROJECTIONS, MOST_PROBES = (3, 4, 5), 27
#: Both are fitted on at most so many vectors, drawn by hash, to reach TARGET recall among them with the fewest scored.
FIT_VECTORS, FIT_QUERIES, TARGET = 4096, 256, 0.95
#: Vectors, and queries, of a block of a bucket.
BLOCK = 4096


class Hashes:
    """`projections` of each table, for vectors of `dimension` and at most `longest` length."""

    def __init__(self, dimension: int, longest: float, projections: int, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        self.longest, self.n = longest, projections
        self.a = random.normal(size=(dimension + 1, TABLES * projections))
        self.b = random.uniform(0, WIDTH, TABLES * projections)
        self.perturbed = np.array(list(itertools.product((-1, 0, 1), repeat=projections)))

    def _slots(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.a + self.b) / WIDTH).reshape(len(x), TABLES, self.n)

    def _key(self, slots: np.ndarray) -> np.ndarray:
        """A long for a table (third axis from the end of `slots` is over tables) and its slots."""
        key = np.zeros(slots.shape[:-1], np.int64)
        for k in range(self.n):
            key = key * 4093 + slots[..., k]
        return key * TABLES + np.arange(TABLES).reshape((-1,) + (1,) * (slots.ndim - 3))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        length = (x * x).sum(1)
        wide = np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - length, 0))[:, None]], 1) / self.longest
        return self._key(np.floor(self._slots(wide)).astype(np.int64))

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """For each query and table its n buckets, the likeliest first."""
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        at = self._slots(np.concatenate([unit, np.zeros((len(q), 1))], 1))
        home = np.floor(at)
        low, high = (at - home) ** 2, (1 - (at - home)) ** 2
        cost = low @ (self.perturbed == -1).T.astype(float) + high @ (self.perturbed == 1).T.astype(float)
        order = np.argsort(cost, axis=2, kind="stable")[:, :, :n]
        return self._key((home[:, :, None] + self.perturbed[order]).astype(np.int64))


def first_probes(sample: np.ndarray, q: np.ndarray, hashes: Hashes) -> np.ndarray:
    """How many probes a table each query needs to visit each vector of the sample; one more than the most, if all miss."""
    own, probed = hashes.buckets(sample), hashes.probes(q, MOST_PROBES)
    need = np.full((len(q), len(sample)), MOST_PROBES + 1, np.int16)
    for p in range(probed.shape[2] - 1, -1, -1):
        for t in range(TABLES):
            need[own[:, t] == probed[:, t, p, None]] = p + 1
    return need


def fit(sample: np.ndarray, n_vectors: int, k: int, longest: float) -> tuple[Hashes, int]:
    """The number of projections, and of probes a table, that find TARGET of what is nearest with the fewest scored.

    The sample's first vectors ask the sample. Of the k nearest among all n_vectors a part is in the sample: as many of
    the nearest there have to be found, so that fewer candidates do as the table grows and neighbours get nearer.
    """
    q = sample[:FIT_QUERIES]
    product = q @ sample.T
    product[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = min(max(1, -(-k * len(sample) // n_vectors)), len(sample) - 1)
    choices = []
    for projections in PROJECTIONS:
        hashes = Hashes(sample.shape[1], longest, projections)
        if near < 1:
            return hashes, 1
        need = first_probes(sample, q, hashes)
        best = np.take_along_axis(need, np.argpartition(-product, near - 1, axis=1)[:, :near], 1)
        n = next((n for n in range(1, MOST_PROBES) if (best <= n).mean() >= TARGET), MOST_PROBES)
        choices.append(((best <= n).mean() < TARGET, (need <= n).mean(), projections, n, hashes))
    return min(choices, key=lambda c: c[:3])[4], min(choices, key=lambda c: c[:3])[3]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def valid_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, e, u): rows whose vector isn't null, empty or zero and has finite components only; u identifies it."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists(e, lambda x: x != 0)
    return df.filter(F.col("embedding").isNotNull()).filter(fine).select("vec_id", e.alias("e")).withColumn("u", F.xxhash64("e"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(u, e, ids): equal vectors once, with their `keep` smallest ids, sorted, nulls last. Each partition combines its own first."""
    smallest = lambda ids: sorted(ids, key=lambda i: (i is None, i))[:keep]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            e = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)  # all have one dimension
            for n, (u, i) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if u not in held:
                    held[u] = [e[n].tobytes(), []]
                got = held[u]
                got[1].append(i)
                if len(got[1]) > 4 * keep:
                    got[1] = smallest(got[1])
        us = list(held)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array([held[u][0] for u in us], pa.binary()), pa.array([smallest(held[u][1]) for u in us], pa.list_(pa.int64()))], names=["u", "e", "ids"])

    parts = rows.select("u", F.col("vec_id").cast("long").alias("vec_id"), "e").mapInArrow(combine, "u long, e binary, ids array<long>")
    return parts.groupBy("u").agg(F.first("e").alias("e"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))


def _search(index: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """(q, u, score): for each (key, q, e, bar) of `asked` the best `keep` of that bucket that aren't below the bar."""

    def blocks(n: str):
        return F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")

    sizes = index.groupBy("key").agg(F.count("*").alias("vectors")).join(asked.groupBy("key").agg(F.count("*").alias("queries")), "key")
    rows = index.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("u"), blocks("vectors")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks("queries") - 1)))
    questions = asked.join(sizes, "key").withColumn("j", F.pmod(F.xxhash64("q"), blocks("queries")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), blocks("vectors") - 1)))
    both = rows.select("key", "i", "j", F.lit(0).alias("asks"), F.col("u").alias("id"), "e", F.lit(0.0).alias("bar"))
    both = both.unionByName(questions.select("key", "i", "j", F.lit(1).alias("asks"), F.col("q").alias("id"), "e", "bar"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            table, at = _runs(table, 3)
            asks, ids, bars = (table.column(c).to_numpy() for c in ("asks", "id", "bar"))
            e = _matrix(table.column("e")) if table.num_rows else None
            out: list[tuple] = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                m = a + int(np.searchsorted(asks[a:b], 1))
                if m == a or m == b:
                    continue
                for c in range(m, b, 256):
                    q = slice(c, min(b, c + 256))
                    product = e[q] @ e[a:m].T
                    bar = bars[q]
                    if m - a > keep:
                        bar = np.maximum(bar, -np.partition(-product, keep - 1, axis=1)[:, keep - 1])
                    i, j = np.nonzero(product >= bar[:, None] - 1e-9)
                    i, j = i + c, j + a
                    out.append((ids[i], ids[j], np.einsum("ij,ij->i", e[i], e[j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["q", "u", "score"])

    dealt = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "asks")
    return dealt.mapInArrow(run, "q long, u long, score double")


def nearest(spark: SparkSession, df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of `queries` among the other rows of `df`.

    Both have vec_id and embedding; nearness is the inner product in double precision, ties go to the smaller vec_id.
    Rows whose vector is null, empty, zero, or has a null or non-finite component take no part, nor do vectors of a
    dimension other than the commonest. Equal vectors are searched once; each keeps its k + 1 smallest ids, more than
    which no answer needs. A row without vec_id is a candidate, last among equally near ones, and answers no query that
    has none itself. A query gets k answers, or all other rows if there are fewer. No rows give no rows.
    """
    rows, asked = valid_vectors(df), valid_vectors(queries)
    sizes = rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))).alias("longest"))
    shape = sizes.orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = rows.filter(F.size("e") == shape["d"]), asked.filter(F.size("e") == shape["d"])
    vectors = common.staged(distinct_vectors(rows, k + 1), "vectors")
    sample = [np.frombuffer(r["e"]) for r in vectors.orderBy(F.xxhash64("u", F.lit(5))).limit(FIT_VECTORS).select("e").toLocalIterator()]
    hashes, n_probes = fit(np.array(sample), vectors.count(), k, shape["longest"])

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = hashes.buckets(_matrix(batch.column(1)))
                at = np.repeat(np.arange(len(key)), key.shape[1])
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *part.columns], names=["key", "u", "e"])

    def probing(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 1000):
                    batch = whole.slice(start, 1000)
                    key = hashes.probes(_matrix(batch.column(1)), last)[:, :, first:].reshape(batch.num_rows, -1)
                    part = batch.take(pa.array(np.repeat(np.arange(len(key)), key.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *part.columns], names=["key", "q", "e", "bar"])

        return run

    asks = common.staged(asked.select(F.col("vec_id").cast("long").alias("query_id"), "u"), "queries")
    questions = asks.select("u").distinct().join(vectors.select("u", "e"), "u").select(F.col("u").alias("q"), "e")
    index = vectors.select("u", "e").mapInArrow(bucketed, "key long, u long, e binary")
    probe = "key long, q long, e binary, bar double"
    keep = k + 1
    found = common.staged(_search(index, questions.withColumn("bar", F.lit(float("-inf"))).mapInArrow(probing(0, 1), probe), keep).distinct(), "found")
    if n_probes > 1:
        best = W.partitionBy("q").orderBy(F.desc("score"))
        bars = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") == keep).select("q", F.col("score").alias("bar"))
        more = questions.join(bars, "q", "left").select("q", "e", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
        more = _search(index, more.mapInArrow(probing(1, n_probes), probe), keep)
        found = common.staged(found.unionByName(more).distinct(), "found")
    rows_found = found.join(vectors.select("u", F.size("ids").alias("n")), "u").groupBy("q").agg(F.sum("n").alias("n"))
    short = common.staged(questions.join(rows_found, "q", "left").filter(F.coalesce("n", F.lit(0)) < keep).select("q", "e"), "short")
    if not short.isEmpty():  # their buckets hold too few: all vectors are their candidates
        every = vectors.select(F.lit(0).cast("long").alias("key"), "u", "e")
        found = found.unionByName(_search(every, short.select(F.lit(0).cast("long").alias("key"), "q", "e", F.lit(float("-inf")).alias("bar")), keep)).distinct()
    each = found.join(vectors.select("u", "ids"), "u").select("q", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    top = each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    lists = top.groupBy(F.col("q").alias("u")).agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("top"))
    others = F.slice(F.filter("top", lambda x: ~x["vec_id"].eqNullSafe(F.col("query_id"))), 1, k)
    out = asks.join(lists, "u").select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings")
    return nearest(spark, rows, rows.filter(F.col("vec_id") % 20 == 0), 20)
