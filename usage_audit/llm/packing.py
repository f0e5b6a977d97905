"""Lexical retrieval packing.

Documents are dealt to shards by what they say: a tree of centroids, fitted on a sample of the whole corpus, puts related
documents of any part of it into one shard, and grows with the corpus. Each shard is an inverted index of its documents'
tokens. Windows are filled one after another: a seed document asks the index, by BM25 over its most telling tokens, for
the nearest documents that aren't used yet, and they fill its window greedily. Document frequencies, lengths and their
mean are those of the whole corpus: they are summed over all shards first, in one table of the vocabulary's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Ids are below this: the size of the table of document frequencies, and the bound of its broadcast.
VOCABULARY = 1 << 16
END_ID = 0
#: Documents of a shard, about: the reach of a seed's retrieval, and the bound of a task's memory.
DOCS_PER_SHARD = 2000
#: A seed asks by so many of its tokens, those with the highest idf; it gets so many neighbours at once.
QUERY_TOKENS, NEIGHBOURS = 12, 16
K1, B = 1.2, 0.75
#: Sketches have so many dimensions; the tree is fitted on so many of them a leaf, and has at most so many leaves.
DIMENSIONS, SAMPLES, MOST_LEAVES = 128, 32, 4096
#: A leaf's documents fall into so many cells by a MinHash of their tokens: a hot leaf is split along these.
CELLS = 64

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids, place) of each row: byte-level BPE ids and the end id, 16 bits each, and a hash of row and text."""
    end = np.array([END_ID], np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = tokens.byte_encoder(folder)
        for whole in batches:
            for batch in tokens.slices(whole, 1):
                ids = [x + end for x in encoded(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], names=["doc_id", "ids", "place"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("place"))
    return rows.mapInArrow(run, "doc_id long, ids binary, place long")


def statistics(ids: DataFrame) -> np.ndarray:
    """Documents that hold each id, over all documents; then, in two more places, all documents and all ids."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY + 2, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                a = np.frombuffer(x, np.uint16)
                total[np.unique(a)] += 1
                total[VOCABULARY:] += (1, len(a))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["id", "n"])

    out = np.zeros(VOCABULARY + 2, np.int64)
    for r in ids.select("ids").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["id"]] = r["n"]
    return out


class _Sketcher:
    """Random projections of documents' weighted tokens, of length 1, and MinHash cells."""

    def __init__(self, df: np.ndarray, n_docs: int) -> None:
        self.idf, self.rare = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32), df * 10 <= n_docs
        r = np.random.default_rng(17)
        self.signs = r.integers(0, 2, (VOCABULARY, DIMENSIONS), np.int8) * np.int8(2) - np.int8(1)
        self.order = r.permutation(VOCABULARY)

    def __call__(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        out, cells = np.zeros((len(docs), DIMENSIONS), np.float32), np.zeros(len(docs), np.int64)
        for i, d in enumerate(docs):
            t, tf = np.unique(d, return_counts=True)
            out[i] = (self.idf[t] * (1 + np.log(tf)).astype(np.float32)) @ self.signs[t].astype(np.float32)
            cells[i] = self.order[t[self.rare[t]]].min(initial=VOCABULARY) * 40503 // 7 % CELLS
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return out, cells


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most `k` spherical k-means centroids of the rows of `x`."""
    c = x[np.random.default_rng(5).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        c = np.add.reduceat(x[order], first, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class _Tree:
    """Two levels of centroids; the leaves of one parent have neighbouring numbers."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.top = _centroids(sample, max(1, round(leaves**0.5)))
        near = np.argmax(sample @ self.top.T, axis=1)
        self.below = [_centroids(sample[near == k], max(1, round(leaves * (near == k).mean()))) if (near == k).any() else self.top[k : k + 1] for k in range(len(self.top))]
        self.first = np.cumsum([0] + [len(b) for b in self.below])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        near = np.argmax(x @ self.top.T, axis=1)
        out = np.zeros(len(x), np.int64)
        for k in np.unique(near):
            out[near == k] = self.first[k] + np.argmax(x[near == k] @ self.below[k].T, axis=1)
        return out


def shards_of_cells(weights: np.ndarray, leaf_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of each cell's shards, for cells of these weights in documents; none of a leaf's cells, in order.

    Neighbouring cells fill a shard up to DOCS_PER_SHARD; a leaf that fits into one shard stays whole, and only a cell
    that is itself above that, one of copies, has several shards.
    """
    first, number = np.zeros(len(weights), np.int64), np.ones(len(weights), np.int64)
    shard, held = 0, 0.0
    for at in range(0, len(weights), leaf_cells):
        leaf = weights[at : at + leaf_cells]
        if held and leaf.sum() <= 1.5 * DOCS_PER_SHARD < held + leaf.sum():
            shard, held = shard + 1, 0.0
        for c in range(at, at + len(leaf)):
            w = weights[c]
            if held and held + w > 1.5 * DOCS_PER_SHARD:
                shard, held = shard + 1, 0.0
            first[c] = shard
            if w > 1.5 * DOCS_PER_SHARD:
                number[c] = int(np.ceil(w / DOCS_PER_SHARD))
                shard += number[c]
            else:
                held += w
    return first, number


class _Index:
    """An inverted index of one shard: for each token the documents that hold it, with their BM25 parts."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n_docs: int, mean_length: float) -> None:
        lengths = np.array([len(d) for d in docs])
        self.idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        held = [np.unique(d, return_counts=True) for d in docs]
        token, tf = np.concatenate([t for t, _ in held]), np.concatenate([c for _, c in held])
        doc = np.repeat(np.arange(len(docs)), [len(t) for t, _ in held])
        part = (self.idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean_length))).astype(np.float32)
        order = np.argsort(token, kind="stable")
        self.first = np.searchsorted(token[order], np.arange(VOCABULARY + 1))
        self.doc, self.part = doc[order], part[order]
        self.queries, self.all_tokens = [], []
        for t, _ in held:
            t = t[(self.first[t + 1] - self.first[t] > 1)]  # a token of no other document finds nothing
            self.all_tokens.append(t)
            self.queries.append(t[np.lexsort((t, -self.idf[t]))[:QUERY_TOKENS]] if len(t) > QUERY_TOKENS else t)

    def scores(self, seed: int, whole: bool = False) -> np.ndarray:
        """BM25 of the documents by the seed's most telling tokens, or with `whole` by all of its tokens."""
        at = [(self.first[t], self.first[t + 1]) for t in (self.all_tokens if whole else self.queries)[seed].astype(np.int64)]
        if not at:
            return np.zeros(0)
        return np.bincount(np.concatenate([self.doc[a:b] for a, b in at]), np.concatenate([self.part[a:b] for a, b in at]))


def pack_shard(docs: list[np.ndarray], index: _Index, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard. Every token lies in exactly one of them.

    Whole windows of long documents are sequences of their own; what remains of each document is packed. A window that
    is not full takes its seed's best unused neighbours as long as any scores, then the next unused documents; the one
    that it cuts seeds the next window.
    """
    sequence, left = 0, []
    for d, ids in enumerate(docs):
        whole = len(ids) // window
        for k in range(whole):
            yield d, k * window, window, sequence, 0
            sequence += 1
        left.append(len(ids) - whole * window)
    unused = np.array(left) > 0
    following, seed, asker, offset = 0, -1, -1, 0
    near: list[int] = []
    score, whole = np.zeros(0), False

    def best() -> list[int]:
        open_ = np.where(unused[: len(score)], score, 0)
        some = np.argpartition(-open_, NEIGHBOURS)[:NEIGHBOURS] if len(open_) > NEIGHBOURS else np.arange(len(open_))
        some = some[open_[some] > 0]
        return some[np.lexsort((-some, open_[some]))].tolist()  # the best is last

    while True:
        if seed < 0:
            while near and not unused[near[-1]]:
                near.pop()
            if not near and asker >= 0:  # the window outlasts its neighbours: its seed asks again, at last by all its tokens
                near = best()
                if not near and not whole:
                    score, whole = index.scores(asker, True), True
                    near = best()
                if not near:
                    asker = -1
            if near:
                seed = near.pop()
            else:
                while following < len(docs) and not unused[following]:
                    following += 1
                if following == len(docs):
                    return
                seed = following
            unused[seed] = False
        take = min(left[seed], window - offset)
        yield seed, len(docs[seed]) - left[seed], take, sequence, offset
        left[seed] -= take
        first = offset == 0
        offset += take
        if offset == window:
            sequence, offset = sequence + 1, 0
            near, asker = [], -1
        if first and offset:
            score, whole, asker = index.scores(seed), False, seed
            near = best()
        if not left[seed]:
            seed = -1


def deal(spark: SparkSession, ids: DataFrame, sums: np.ndarray) -> DataFrame:
    """`ids` with its shard: related documents of the whole corpus have the same."""
    n_docs, n_ids = int(sums[VOCABULARY]), int(sums[VOCABULARY + 1])
    leaves = min(MOST_LEAVES, n_docs // DOCS_PER_SHARD)
    if leaves < 2:
        return ids.withColumn("shard", F.lit(0).cast("long"))
    df = spark.sparkContext.broadcast(sums[:VOCABULARY].tobytes())

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = _Sketcher(np.frombuffer(df.value, np.int64), n_docs)
        for batch in batches:
            x, _ = sketch([np.frombuffer(i, np.uint16) for i in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), batch.column(1)], names=["x", "place"])

    one_of = max(1, n_docs // (SAMPLES * leaves))
    some = ids.filter(F.pmod(F.xxhash64("place"), F.lit(one_of)) == 0).select("ids", "place").mapInArrow(sketched, "x binary, place long")
    got = sorted((r["place"], bytes(r["x"])) for r in some.collect())  # at most about 2 * SAMPLES * MOST_LEAVES rows
    tree = spark.sparkContext.broadcast(_Tree(np.frombuffer(b"".join(x for _, x in got), np.float16).reshape(-1, DIMENSIONS).astype(np.float32), leaves))
    n_cells = int(tree.value.first[-1]) * CELLS

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = _Sketcher(np.frombuffer(df.value, np.int64), n_docs)
        for batch in batches:
            x, cells = sketch([np.frombuffer(i, np.uint16) for i in batch.column(1).to_pylist()])
            cell = tree.value.leaves(x) * CELLS + cells
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["doc_id", "ids", "place", "cell"])

    placed = common.staged(ids.mapInArrow(celled, "doc_id long, ids binary, place long, cell long"), "cells")
    weights = np.zeros(n_cells)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.length("ids") / 2).alias("ids")).toLocalIterator():
        weights[r["cell"]] = (r["n"] + r["ids"] * n_docs / n_ids) / 2  # long documents fill a shard sooner
    first, number = shards_of_cells(weights, CELLS)
    found = np.flatnonzero(weights)
    plan = spark.createDataFrame(pa.table({"cell": found, "first": first[found], "number": number[found]}))
    # at most MOST_LEAVES * CELLS rows, whatever the input
    return placed.join(F.broadcast(plan), "cell").select("doc_id", "ids", "place", (F.col("first") + F.pmod("place", "number")).alias("shard"))


def pack(spark: SparkSession, docs: DataFrame, window: int, folder: str, digest: bool = False) -> DataFrame:
    """The pieces of all rows of `docs` (doc_id, text), packed into sequences of at most `window` tokens.

    doc_id, start, length, ids (32 bits each), doc_tokens, sequence_id, offset; with `digest` ids_crc32 instead of ids,
    made in the same task: a second Python step there would double an executor's workers. A null or empty text has the end id
    alone. Only the last sequence of each shard may be short of `window`. Rows with equal doc_id are packed each for
    itself. Sequences are numbered within shards: sequence_id = shard * 2**32 + number. No rows give no pieces;
    further columns of `docs` aren't read.
    """
    ids = common.staged(tokenised(docs, folder), "ids")
    sums = statistics(ids)
    n_docs, n_ids = int(sums[VOCABULARY]), int(sums[VOCABULARY + 1])
    df = spark.sparkContext.broadcast(sums[:VOCABULARY].tobytes())

    def one(got: pa.Table) -> pa.Table:
        got = got.combine_chunks().sort_by([("doc_id", "ascending"), ("place", "ascending")])
        lists = [np.frombuffer(x, np.uint16) for x in got.column("ids").to_pylist()]
        index = _Index(lists, np.frombuffer(df.value, np.int64), n_docs, n_ids / max(1, n_docs))
        d, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pack_shard(lists, index, window), strict=True))
        base = got.column("shard")[0].as_py() << 32
        cut = [lists[i][a : a + n].astype("<u4").tobytes() for i, a, n in zip(d, start, length, strict=True)]
        ids = {"ids_crc32": pa.array(map(zlib.crc32, cut), pa.int64())} if digest else {"ids": pa.array(cut, pa.binary())}
        sizes = np.array([len(x) for x in lists])
        columns = {"doc_id": got.column("doc_id").take(pa.array(d)), "start": start, "length": length} | ids
        return pa.table(columns | {"doc_tokens": sizes[d], "sequence_id": sequence + base, "offset": offset})

    dealt = deal(spark, ids, sums)
    return dealt.groupBy("shard").applyInArrow(one, PIECES.replace("ids binary", "ids_crc32 long") if digest else PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, common.read(spark, sf_dir, "documents"), 1024, tokens.vocabulary_dir(), digest=True)
