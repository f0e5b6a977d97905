r"""Phrase collocations by an FM-index per shard over word ids.

A task gathers the words of its documents, language by language, into shards. The words of a shard are numbered, and
its text (0 between pieces) and the reversed text are kept as two Burrows-Wheeler transforms whose rows are sorted by
as many symbols as a phrase may have words. A phrase is an interval of rows in either; extending it by a word to the
right is a step in the transform of the reversed text, to the left in the other, and the other interval moves along
(`FMIndex`). All phrases of a length are extended at once. What the shards count is summed by phrase, length by
length: a phrase is asked for only where its words without the first and without the last are frequent everywhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import common, tokens

#: Words that a task holds at most, but for one slice of documents; the largest language's then become a shard.
HELD_WORDS = 1 << 22
#: A filter of frequent phrases has at most 2**this words of 64 bits: a bound at any size of the corpus. Beyond it more
#: phrases are counted than needed, none is missed.
MOST_LOG2_WORDS = 20
#: A language's phrases are ranked in this many parts first.
RANK_PARTS = 64

SHARD = T.StructType([T.StructField(n, t) for n, t in (("lang", T.StringType()), ("words", T.ArrayType(T.StringType())), ("counts", T.ArrayType(T.LongType())), ("forward", T.BinaryType()), ("backward", T.BinaryType()))])

_PLAIN, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of `texts` (strings, null: empty), A-Z in lower case, as binary; and for each word whether a piece begins there.

    Pieces end at `[.,;:!?\\x0A-\\x0D]` and at the end of a text; words are the runs without space and tab in them.
    """
    texts = texts.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2].to_pybytes()[bounds[0] : bounds[-1]].translate(_LOWER), np.uint8) if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    edges = np.unique(bounds - bounds[0])
    kind = _KIND[data]
    plain = kind == _PLAIN
    begins, ends = plain.copy(), plain.copy()
    begins[1:] &= ~plain[:-1]
    ends[:-1] &= ~plain[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] = plain[inner]
    ends[inner - 1] = plain[inner - 1]
    first = np.flatnonzero(begins)
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - first, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[plain])])
    piece = np.searchsorted(np.union1d(np.flatnonzero(kind == _BREAK), edges), first, "right")
    return words, np.diff(piece, prepend=-1) != 0


def bwt(text: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each position of `text`, a circle, the positions sorted by `depth` symbols from there on."""
    sigma, rolled = int(text.max()) + 1, [np.roll(text, -i) for i in range(depth)]
    if sigma**depth < 1 << 62:
        key = rolled[0].astype(np.int64)
        for r in rolled[1:]:
            key = key * sigma + r
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(rolled[::-1])
    return text[order - 1]


class Phrases(NamedTuple):
    """Phrases of one length: a row of word ids each, how often they occur, and where their rows begin in either transform."""

    ids: np.ndarray
    n: np.ndarray
    first: tuple[np.ndarray, np.ndarray]

    def only(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.ids[keep], self.n[keep], (self.first[0][keep], self.first[1][keep]))


class FMIndex:
    """The transforms of a text and of its reverse; word ids are 1 and more, 0 ends a piece.

    A phrase's rows in the first begin with its words, in the second with its words reversed. Phrases may have as many
    words as symbols by which the rows are sorted.
    """

    def __init__(self, forward: np.ndarray, backward: np.ndarray):
        self.bwt = (forward, backward)
        #: For each row the one that a step of the search leads here from.
        self.source = tuple(np.argsort(b, kind="stable") for b in self.bwt)

    @staticmethod
    def of(text: np.ndarray, depth: int) -> FMIndex:
        return FMIndex(bwt(text, depth), bwt(text[::-1], depth))

    def words(self) -> Phrases:
        n = np.bincount(self.bwt[0])
        ids = np.flatnonzero(n[1:]) + 1
        first = (np.cumsum(n) - n)[ids]
        return Phrases(ids[:, None].astype(np.int32), n[ids], (first, first))

    def extended(self, p: Phrases, right: bool) -> Phrases:
        """All phrases of one word more, after (`right`) or before those of `p`, that don't pass the end of a piece."""
        own, other = (1, 0) if right else (0, 1)
        rows, source = len(self.bwt[own]), self.source[own]
        owner = np.full(rows, -1, np.int32)
        owner[np.repeat(p.first[own] - (np.cumsum(p.n) - p.n), p.n) + np.arange(int(p.n.sum()))] = np.repeat(np.arange(len(p.n), dtype=np.int32), p.n)
        # the rows of one phrase with one symbol before them stay together and become the longer phrase's interval
        owner, symbol = owner[source], self.bwt[own][source]
        begins = np.ones(rows, bool)
        begins[1:] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        at = np.flatnonzero(begins)
        n = np.diff(at, append=rows)
        mine = owner[at] >= 0
        at, n = at[mine], n[mine]
        parent, symbol = owner[at], symbol[at]
        # the other interval is the part of the parent's that comes after all smaller symbols
        by = np.argsort(parent, kind="stable")
        before = np.cumsum(n[by]) - n[by]
        heads = np.flatnonzero(np.diff(parent[by], prepend=-1))
        before -= np.repeat(before[heads], np.diff(heads, append=len(by)))
        there = np.empty(len(by), np.int64)
        there[by] = before
        there += p.first[other][parent]
        ids = np.hstack((p.ids[parent], symbol[:, None]) if right else (symbol[:, None], p.ids[parent])).astype(np.int32)
        return Phrases(ids, n, (there, at) if right else (at, there)).only(symbol > 0)

    def longer(self, p: Phrases) -> Phrases:
        """The phrases of one word more of which both the words but the last and those but the first are in `p`."""
        found = self.extended(p, right=True)
        return found.only(np.isin(found.first[0], self.extended(p, right=False).first[0]))


def _shards(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = defaultdict(list), defaultdict(int)

        def shard(lang: str) -> pa.RecordBatch:
            parts = held.pop(lang)
            del sizes[lang]
            coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
            begins = np.concatenate([b for _, b in parts])
            ids = coded.indices.to_numpy() + 1
            text = np.zeros(len(ids) + int(begins.sum()), np.int32)
            text[np.arange(len(ids)) + np.cumsum(begins)] = ids
            packed = [zstandard.compress(bwt(t, depth).tobytes(), 1) for t in (text, text[::-1])]
            listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([lang]), listed(coded.dictionary.cast(pa.string())), listed(pa.array(np.bincount(ids)[1:], pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in packed)], names=SHARD.names)

        for whole in batches:
            for batch in tokens.slices(whole, 1):
                langs = batch.column(0)
                for lang in langs.unique():
                    words, begins = words_of(batch.column(1).filter(pc.equal(langs, lang)))
                    if len(words):
                        held[lang.as_py()].append((words, begins))
                        sizes[lang.as_py()] += len(words)
                while sum(sizes.values()) >= HELD_WORDS:
                    yield shard(max(sizes, key=sizes.get))
        for lang in list(held):
            yield shard(lang)

    return run


def shards(docs: DataFrame, most_words: int) -> DataFrame:
    """(lang, words, counts, forward, backward): the FM-indexes of `docs` (text, lang); no lang is `und`."""
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text").mapInArrow(_shards(most_words), SHARD)


def _filter_of(frequent: DataFrame, n: int) -> np.ndarray:
    """A blocked Bloom filter, three bits a key, of the phrases of `frequent`: at most 2**MOST_LOG2_WORDS words."""
    log2 = max(6, min(MOST_LOG2_WORDS, max(1, n // 8).bit_length()))
    h = F.xxhash64("phrase")
    words = np.zeros(1 << log2, np.uint64)
    for r in frequent.groupBy(common._word(h, log2).alias("word")).agg(F.bit_or(common._bits(h)).alias("mask")).toLocalIterator():
        words[r["word"]] = np.int64(r["mask"]).view(np.uint64)
    return words


def _maybe(words: np.ndarray, phrases: pa.Array) -> np.ndarray:
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in phrases.to_pylist()), np.uint64, len(phrases))  # as xxhash64() in SQL
    one = np.uint64(1)
    bits = (one << (h & np.uint64(63))) | (one << (h >> np.uint64(6) & np.uint64(63))) | (one << (h >> np.uint64(12) & np.uint64(63)))
    return words[h >> np.uint64(64 - (len(words).bit_length() - 1))] & bits == bits


def _counts(filters: list):
    """The phrases of len(filters) + 1 words of each shard, as far as all shorter ones in them pass their filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, words = batch.column(0)[row], batch.column(1)[row].values.cast(pa.string())
                index = FMIndex(*(np.frombuffer(zstandard.decompress(batch.column(c)[row].as_py()), np.int32) for c in (2, 3)))
                said = lambda p: pc.binary_join_element_wise(*(words.take(pa.array(p.ids[:, k] - 1)) for k in range(p.ids.shape[1])), " ")  # noqa: B023, E731
                p = index.words()
                for kept in filters:
                    p = index.longer(p.only(_maybe(kept.value, said(p))))
                for at in range(0, len(p.n), 100_000):
                    part = p.only(slice(at, at + 100_000))
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part.n)).cast(pa.string()), said(part), pa.array(part.n, pa.int64())], names=["lang", "phrase", "n"])

    return run


def frequent_phrases(spark: SparkSession, docs: DataFrame, most_words: int = 3, least: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with all words of each language, and for each length up to `most_words` the (lang, phrase, n) that occur
    `least` times or more in `docs` (text, lang), exactly."""
    index = common.staged(shards(docs, most_words), "phrase-indexes")
    words = index.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("n"))
    words = common.staged(words, "words")
    found, filters = [common.staged(words.filter(F.col("n") >= least), "phrases-1")], []
    for length in range(2, most_words + 1):
        filters.append(spark.sparkContext.broadcast(_filter_of(found[-1], found[-1].count())))
        # a shard has a phrase once: there is nothing to combine before the shuffle
        counted = index.select("lang", "words", "forward", "backward").mapInArrow(_counts(filters), "lang string, phrase string, n long").repartition("lang", "phrase")
        found.append(common.staged(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), f"phrases-{length}"))
    return words.groupBy("lang").agg(F.sum("n").alias("n")), found


def _key(phrase) -> F.Column:
    """Language and phrase in one; a phrase holds no line feed."""
    return F.concat("lang", F.lit("\n"), phrase)


def collocations(spark: SparkSession, docs: DataFrame, most_words: int = 3, least: int = 10, within: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, left_word, left_n, right_word, right_n): each language's first `top` phrases.

    Phrases have 2 to `most_words` words and occur a >= `least` times in one piece of a text (words_of). Cut after its
    first k words, l and r are how often the parts occur; score is 1000000 a a / (l r), rounded down, at the cut where that
    is smallest (ties: the first). n counts the language's words. A phrase that a phrase of one word more, of `least`
    occurrences too, holds in at least `within` % of its own is left out. The order is by score and a, descending, then
    by phrase in bytes. left_word and right_word are the commonest that extend it into a phrase of `least` occurrences,
    if any, with the count of that; the longest phrases have none. Null texts are empty, null languages are `und`,
    repeated rows count each time; further columns are not read; no rows give no rows.
    """
    if most_words < 2:
        raise ValueError("a phrase has two words at least")
    sizes, found = frequent_phrases(spark, docs, most_words, least)
    known = found[0]
    for f in found[1:]:
        known = known.unionByName(f)
    known = known.select(_key(F.col("phrase")).alias("part"), F.col("n").alias("m"))

    words, part = F.split("phrase", " "), lambda a, b: F.array_join(F.slice("words", a, b), " ")
    candidates, parts, extensions = [], [], []
    for length, f in enumerate(found[1:], 2):
        split = f.withColumn("words", words)
        cuts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), _key(part(F.lit(a), F.lit(b))).alias("part")) for k in range(1, length) for side, a, b in ((0, 1, k), (1, k + 1, length - k))])
        candidates.append(f.withColumnRenamed("n", "a"))
        parts.append(split.select("lang", "phrase", "n", F.explode(cuts).alias("c")).select("lang", "phrase", "n", "c.*"))
        if length > 2:
            for side, shorter, word in (("right", part(F.lit(1), F.lit(length - 1)), F.element_at("words", -1)), ("left", part(F.lit(2), F.lit(length - 1)), F.element_at("words", 1))):
                extensions.append(split.select("lang", shorter.alias("phrase"), F.lit(side).alias("side"), F.struct((-F.col("n")).alias("minus"), word.alias("word")).alias("x")))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    counted = common.spread_join(common.staged(union(parts), "cuts"), known, "part").groupBy("lang", "phrase", "n", "k").agg(F.max(F.when(F.col("side") == 0, F.col("m"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("m"))).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    counted = counted.select("lang", "phrase", "k", "l", "r", exact("n").alias("x"), exact("l").alias("y"), exact("r").alias("z"))
    scored = counted.withColumn("score", F.expr("(x * x * 1000000) div (y * z)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "best.score", "best.l", "best.r")
    judged = union(candidates).join(best, ["lang", "phrase"])
    of = lambda side: F.min(F.when(F.col("side") == side, F.col("x")))
    none = spark.createDataFrame([], "lang string, phrase string, side string, x struct<minus: bigint, word: string>")
    onward = union([none, *extensions]).groupBy("lang", "phrase").agg(of("left").alias("left"), of("right").alias("right"))
    judged = judged.join(onward, ["lang", "phrase"], "left").withColumns({"left_word": F.col("left.word"), "left_n": -F.col("left.minus"), "right_word": F.col("right.word"), "right_n": -F.col("right.minus")})
    most = F.greatest(F.coalesce("left_n", F.lit(0)), F.coalesce("right_n", F.lit(0)))
    judged = judged.filter(most * 100 < F.col("a") * within)

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")
    few = judged.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", place("lang", "part")).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", place("lang")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_word", "left_n", "right_word", "right_n")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, common.read(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, m, array_to_string(g, ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, m, unnest(list_transform(range(len(w) - m + 1), lambda i: w[i + 1 : i + m])) AS g FROM p, (VALUES (1), (2), (3)) v(m)) GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.m, c.phrase, f, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 :], ' ') AS y FROM c, (VALUES (1), (2)) v(k) WHERE k < c.m),
scored AS (
  SELECT cuts.lang, cuts.m, cuts.phrase, cuts.f AS a, k, x.f AS l, y.f AS r, ((1000000 * cuts.f::HUGEINT * cuts.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = cuts.x AND x.m = k JOIN grams y ON y.lang = cuts.lang AND y.phrase = cuts.y AND y.m = cuts.m - k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, sub, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS sub FROM c WHERE m = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.sub = b.phrase WHERE b.m = 3 OR coalesce(100 * o.f, 0) < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""
