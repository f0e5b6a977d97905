"""Similarity join on word n-grams: all links of a Jaccard similarity of `threshold` or more, and their classes.

Texts with equal shingle sets are one text, their representative. MinHash bands bring representatives into buckets.
Within a bucket, MinHash values are compared a few at a time; a pair is dropped as soon as the posterior probability that
its similarity reaches the threshold falls below `TOLERANCE`. What stays connected is verified: every pair of texts in
it by exact intersection of their shingle sets. Only edges of spanning trees and counts of links leave a task, so a group
of near copies costs rows in proportion to its members. Buckets and groups larger than a block are dealt out as pairs of
blocks, so no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, THRESHOLD = 5, 0.8
#: BANDS of ROWS MinHash values each. Two texts of similarity s share no band with probability (1 - s**ROWS)**BANDS,
#: 5e-8 at 0.8.
BANDS, ROWS = 32, 4
#: MinHash values compared at a time, and the posterior probability under which a pair is dropped.
STEP, TOLERANCE = 16, 1e-7
#: Representatives of a block, in buckets and at verification.
BUCKET_BLOCK, EXACT_BLOCK = 2048, 256
#: Members of candidate groups that are verified in one task, about.
EXACT_TASK = 500
#: Bytes of text that are hashed at once.
AT_ONCE = 1 << 20

_U = np.uint64
_ODD, _WORD_STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_ODD), -1, 1 << 64))
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(20240607)
_A = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * _U(2) + _U(1)
_B = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the ascending 64-bit hashes of its distinct runs of `words` words.

    A text of fewer words has one shingle of all of them; one without words, or null, has none. Words are runs of
    anything but ASCII white space.
    """
    out: list[np.ndarray] = []
    texts = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, "right")) - 1)
        out.extend(_shingles(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], words))
        at = to
    return out


def _shingles(data: np.ndarray, ends: np.ndarray, words: int) -> Iterator[np.ndarray]:
    n = len(data)
    space = _SPACES[data]
    border = np.zeros(n + 1, bool)
    border[ends] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    first = np.flatnonzero(~space & (before | border[:-1]))
    last = np.flatnonzero(~space & (after | border[1:])) + 1
    # a word's hash is a polynomial of its bytes modulo 2**64, from differences of one running sum
    power, back = np.full(n + 1, _ODD), np.full(n + 1, _INVERSE)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * power[:-1], out=total[1:])
    word = _mix((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64))
    bound = np.searchsorted(first, ends)
    joined = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        joined = joined * _WORD_STEP + word[k : len(word) - words + 1 + k]
    joined = _mix(joined)
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(joined[a : b - words + 1])
        elif b > a:
            h = np.array([b - a], np.uint64)  # arrays wrap around, scalars warn
            for w in range(a, b):
                h = h * _WORD_STEP + word[w : w + 1]
            yield _mix(h)
        else:
            yield np.zeros(0, np.uint64)


def set_hashes(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set of shingles."""
    return int(_mix(own).sum(dtype=np.uint64).astype(np.int64)), int((_mix(own ^ _ODD) * _WORD_STEP).sum(dtype=np.uint64).astype(np.int64))


def minhash(own: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS MinHash values of a set, 32 bits each."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, (own[at : at + 4096, None] * _A + _B).min(0))
    return (least >> _U(32)).astype(np.uint32)


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = 0, STEP, 2 * STEP ... compared values the fewest matches that keep a pair.

    With a uniform prior, P(similarity >= t | m of n match) is the probability of m successes or fewer in n + 1 trials
    of chance t.
    """
    out = [0]
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def bayes_tree(signatures: np.ndarray, fewest: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs that incremental comparison doesn't drop."""
    rest, edges = np.arange(len(signatures)), []
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        pivot = queue.pop()
        at, found = np.arange(len(rest)), np.zeros(len(rest), np.int64)
        for k in range(1, len(fewest)):
            part = slice((k - 1) * STEP, k * STEP)
            found = found + (signatures[rest[at], part] == signatures[pivot, part]).sum(1)
            stay = found >= fewest[k]
            at, found = at[stay], found[stay]
            if not len(at):
                break
        near = rest[at]
        edges.extend((pivot, int(x)) for x in near)
        queue.extend(near.tolist())
        rest = np.delete(rest, at)
    return edges


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of `threshold` or more; a symmetric matrix, exactly."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) > 1  # shingles of one set alone don't count
    number = np.cumsum(shared) - 1
    inside = shared[column]
    column, owner = number[column[inside]], owner[inside]
    common_ = np.zeros((len(sets), len(sets)), np.float64)
    width = max(256, (1 << 22) // len(sets))
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        common_ += has @ has.T
    union = sizes[:, None] + sizes[None] - common_
    # integers on both sides of the threshold: exact but for the threshold's own digits
    out = common_ >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values of the first `keys` columns, in tables that hold whole runs."""
    held: list[pa.RecordBatch] = []

    def last_key(b: pa.RecordBatch):
        return tuple(b.column(k)[b.num_rows - 1].as_py() for k in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = last_key(batch)
        same = np.ones(batch.num_rows, bool)
        for k in range(keys):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == key[k]
        start = int(np.argmin(same[::-1]) and batch.num_rows - np.argmin(same[::-1])) if not same.all() else 0
        if start or held and last_key(held[-1]) != key:
            held.append(batch.slice(0, start))
            yield pa.Table.from_batches([b for b in held if b.num_rows] or [batch.slice(0, 0)])
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table, keys: int) -> tuple[pa.Table, np.ndarray]:
    table = table.combine_chunks()
    change = np.zeros(table.num_rows, bool)
    for k in range(keys):
        x = table.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return table, np.append(np.append(0, np.flatnonzero(change)), table.num_rows)


def _lower(docs: DataFrame) -> DataFrame:
    """(doc_id, v, text): the text in lower case, and a stand-in for a missing doc_id."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("v"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, v, row, u, u2, n, signature, bands) of each row; u and u2 identify its shingle set of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingles(batch.column(2))
                least = np.stack([minhash(s) for s in sets])
                wide = least.astype(np.uint64).reshape(len(sets), BANDS, ROWS)
                band = np.zeros((len(sets), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    band = _mix(band * _ODD + wide[:, :, k])
                u = np.array([set_hashes(s) for s in sets], np.int64).reshape(-1, 2)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(band.astype(np.int64).ravel()))
                short = np.ascontiguousarray(least.astype(np.uint8))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(u[:, 0]), pa.array(u[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in short], pa.binary()), keys], names=["doc_id", "v", "row", "u", "u2", "n", "signature", "bands"])

    return _lower(docs).mapInArrow(run, "doc_id long, v long, row long, u long, u2 long, n long, signature binary, bands array<long>")


def _block_pairs(rows: DataFrame, members: Column, block: int, node: str) -> DataFrame:
    """`rows` once for each pair (b1 <= b2) of blocks of its group that its own block ``b`` is in."""
    blocks = F.ceil(members / F.lit(block)).cast("int")
    own = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(3), node), blocks).cast("int"))
    other = own.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return other.withColumn("b1", F.least("b", "o")).withColumn("b2", F.greatest("b", "o")).drop("o")


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the pairs that share a band and that comparison doesn't drop."""
    keyed = reps.select("u", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    bucketed = _block_pairs(keyed.join(full, "key"), F.col("members"), BUCKET_BLOCK, "u").select("key", "b1", "b2", "u")
    rows = bucketed.join(reps.select("u", "signature"), "u").select("key", "b1", "b2", "u", "signature")
    fewest = fewest_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            table, at = _runs(table, 3)
            if table.num_rows < 2:
                continue
            u = table.column("u").to_numpy()
            values = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            size = np.diff(at)
            pairs = at[:-1][size == 2]  # most buckets: compared all at once
            found, left = np.zeros(len(pairs), np.int64), np.arange(len(pairs))
            for k in range(1, len(fewest)):
                part = slice((k - 1) * STEP, k * STEP)
                found = found + (values[pairs[left], part] == values[pairs[left] + 1, part]).sum(1)
                stay = found >= fewest[k]
                left, found = left[stay], found[stay]
            a, b = [u[pairs[left]]], [u[pairs[left] + 1]]
            for i, j in zip(at[:-1][size > 2].tolist(), at[1:][size > 2].tolist(), strict=True):
                tree = np.array(bayes_tree(values[i:j], fewest), np.int64).reshape(-1, 2) + i
                a.append(u[tree[:, 0]])
                b.append(u[tree[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    dealt = rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    return dealt.mapInArrow(run, "a long, b long")


def verified(rows: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """In so many tasks, (u, parent, links, texts) of each representative in each pair of blocks: `rows` has component, b1, b2, b, u, copies, text.

    links counts the documents, texts the representatives that it is linked with there; parent is its parent in a
    spanning forest of the links, or itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            table, at = _runs(table, 3)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                group = table.slice(i, j - i)
                u, copies, block = (group.column(c).to_numpy() for c in ("u", "copies", "b"))
                sets = shingles(group.column("text").combine_chunks())
                mine = np.array([set_hashes(s)[0] for s in sets]) == u  # else another text of the same doc_id
                one = np.zeros(len(u), bool)
                one[np.flatnonzero(mine)[np.unique(u[mine], return_index=True)[1]]] = True
                u, copies, block, sets = u[one], copies[one], block[one], [s for s, m in zip(sets, one, strict=True) if m]
                if len(u) < 2:
                    continue
                linked = similar(sets, threshold)
                parent, rest = u.copy(), np.ones(len(u), bool)
                queue: list[int] = []
                for root in range(len(u)):
                    if rest[root]:
                        queue.append(root)
                        rest[root] = False
                    while queue:
                        x = queue.pop()
                        near = np.flatnonzero(linked[x] & rest)
                        parent[near], rest[near] = u[x], False
                        queue.extend(near.tolist())
                counted = linked if group.column("b1")[0] == group.column("b2")[0] else linked & (block[:, None] != block)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(parent), pa.array((counted * copies).sum(1)), pa.array(counted.sum(1))], names=["u", "parent", "links", "texts"])

    dealt = rows.select("component", "b1", "b2", "b", "u", "copies", "text").repartition(tasks, "component", "b1", "b2").sortWithinPartitions("component", "b1", "b2")
    return dealt.mapInArrow(run, "u long, parent long, links long, texts long")


def jaccard_classes(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, class_id, copies, links; row, a hash of
    doc_id and lower-cased text; and class_key, a number of the class.

    Two documents are linked when the sets of their runs of five lower-cased words have a Jaccard similarity of
    `threshold` or more. class_id is the smallest doc_id that a document is connected with by links; copies counts the
    documents with its very shingle set, itself included; links counts the other documents that it is linked with,
    copies included. A text of one to four words is one shingle; a null text or one without words is linked with none.
    A class of rows without doc_id has a null class_id. Repeated rows are copies. Further columns aren't read.
    """
    signed = common.staged(signatures(docs), "signatures")
    same = signed.filter("n > 0").groupBy("u", "u2", "n").agg(F.min("doc_id").alias("least"), F.min("v").alias("v"), F.count("*").alias("copies"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    reps = common.staged(same, "representatives")
    near = common.components(candidate_edges(reps))
    groups = near.groupBy("component").agg(F.count("*").alias("members"))
    members = near.withColumnRenamed("node", "u").join(groups, "component").join(reps.select("u", "v", "copies"), "u")
    members = common.staged(members, "members")
    n_members = members.count()
    texts = common.with_bloom_hits(_lower(docs).select("v", "text"), F.xxhash64("v"), members.select(F.xxhash64("v").alias("h")), n_members)
    rows = _block_pairs(members.join(texts, "v"), F.col("members"), EXACT_BLOCK, "u")
    links = common.staged(verified(rows, threshold, n_members // EXACT_TASK + 1), "links")
    classes = common.components(links.select(F.col("u").alias("a"), F.col("parent").alias("b"))).withColumnRenamed("node", "u")
    counts = links.groupBy("u").agg(F.sum("links").alias("links"))
    known = reps.select("u", "u2", "n", "least", "copies").join(classes, "u", "left").join(counts, "u", "left")
    known = common.staged(known.withColumn("component", F.coalesce("component", "u")), "known")
    names = known.groupBy("component").agg(F.min("least").alias("class_id"))
    known = known.join(names, "component").select("u", "u2", "n", F.col("component").alias("class_key"), "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    worded = signed.filter("n > 0").select("doc_id", "row", "u", "u2", "n").join(known, ["u", "u2", "n"]).select("doc_id", "class_id", "copies", "links", "row", "class_key")
    alone = signed.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"), "row", F.col("row").alias("class_key"))
    return worded.unionByName(alone)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark, common.read(spark, sf_dir, "documents")).drop("row", "class_key")
