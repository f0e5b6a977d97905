"""Exact dedup by Golomb-coded fingerprint exchange.

Each partition of the documents sends the fingerprints of its texts, sorted, without repeats and Golomb-coded, to
their owners (ranges of the fingerprint space). An owner returns to each sender a bitmap of the fingerprints that
occur more than once. Only rows so marked, the suspects, have their texts shuffled, and equal bytes decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import common

#: Bits of a fingerprint, the leading ones of the text's SHA-256.
FP_BITS = 56
#: Rows that a sender codes at once, and fingerprints that an owner gets about.
CHUNK, PER_OWNER = 200_000, 1_000_000
#: A group with more than 1/HOT_PART of all rows is hot; there are fewer than HOT_PART such groups.
HOT_PART, HOT_SALTS = 1000, 256

BLOCK = T.StructType(
    [T.StructField(n, t) for n, t in (("sender", T.LongType()), ("owner", T.LongType()), ("n", T.IntegerType()), ("k", T.IntegerType()), ("unary", T.BinaryType()), ("low", T.BinaryType()), ("local", T.BinaryType()), ("pos", T.BinaryType()), ("ids", T.ArrayType(T.LongType())), ("shas", T.BinaryType()))]
)


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Golomb code (parameter 2**k) of ascending distinct values below `span`: k, the quotients in unary, the remainders."""
    if not len(values):
        return 0, b"", b""
    k = max(0, int(math.log2(max(1.0, 0.69 * span / len(values)))))
    gaps = np.diff(values, prepend=np.uint64(0)) if len(values) else values
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, low: bytes) -> np.ndarray:
    """The values that golomb_encode() was given."""
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(low, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
        gaps += (bits << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _send(owners: int):
    span = -(-(1 << FP_BITS) // owners)

    def blocks(sender: int, ids: pa.Array, shas: np.ndarray) -> pa.RecordBatch:
        fp = shas[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - FP_BITS)
        order = np.argsort(fp, kind="stable")
        ids, shas = ids.take(pa.array(order)), shas[order]
        own, first, pos, n = np.unique(fp[order], return_index=True, return_inverse=True, return_counts=True)
        owner = own // np.uint64(span)
        rows = []
        for o in np.unique(owner):
            a, b = np.searchsorted(owner, [o, o + np.uint64(1)])
            i, j = first[a], first[b] if b < len(first) else len(fp)
            k, unary, low = golomb_encode(own[a:b] - o * np.uint64(span), span)
            rows.append((sender, int(o), int(b - a), k, unary, low, np.packbits(n[a:b] > 1).tobytes(), (pos[i:j] - a).astype(np.int32).tobytes(), ids[i:j], shas[i:j].tobytes()))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        cols = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:8], types, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[8]) for r in rows)]), pa.int32()), pa.concat_arrays([r[8] for r in rows]))
        return pa.RecordBatch.from_arrays([*cols, lists, pa.array([r[9] for r in rows], pa.binary())], names=BLOCK.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, held, rows = TaskContext.get().partitionId() << 20, [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield blocks(sender, *_columns(held))
                sender, held, rows = sender + 1, [], 0
        if rows:
            yield blocks(sender, *_columns(held))

    return run


def _columns(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    shas = t.column("sha").combine_chunks().cast(pa.binary(32))
    return t.column("doc_id").combine_chunks().cast(pa.int64()), np.frombuffer(shas.buffers()[1], np.uint8, 32 * t.num_rows, 32 * shas.offset).reshape(-1, 32)


def _judge(got: pd.DataFrame) -> pd.DataFrame:
    """At an owner: a bitmap for each sender of the fingerprints that more than one row has."""
    lists = [golomb_decode(r.n, r.k, r.unary, r.low) for r in got.itertuples()]
    seen, back, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    twice, at, maps = (n > 1)[back], 0, []
    for r in got.itertuples():
        maps.append(np.packbits(twice[at : at + r.n] | (np.unpackbits(np.frombuffer(r.local, np.uint8))[: r.n] > 0)).tobytes())
        at += r.n
    return pd.DataFrame({"sender": got["sender"], "owner": got["owner"], "twice": maps})


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            pos, shas = np.frombuffer(r["pos"], np.int32), np.frombuffer(r["shas"], "S1")
            marks = np.unpackbits(np.frombuffer(r["twice"], np.uint8))[pos] > 0
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(pos), [None, pa.py_buffer(shas)])
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), fixed.cast(pa.binary()), pa.array(marks)], names=["doc_id", "sha", "suspect"])


def exchange(spark: SparkSession, docs: DataFrame, n_rows: int) -> DataFrame:
    """(doc_id, sha, suspect) of each row; a row that isn't suspect has a text that no other row has."""
    owners = max(1, n_rows // PER_OWNER, min(64, n_rows // 1000))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(common.normalised(F.col("text")), 256)).alias("sha"))
    blocks = common.staged(hashed.mapInArrow(_send(owners), BLOCK), "fingerprints")
    sent = blocks.select("sender", "owner", "n", "k", "unary", "low", "local")
    maps = sent.groupBy("owner").applyInPandas(_judge, "sender long, owner long, twice binary")
    marked = blocks.select("sender", "owner", "pos", "ids", "shas").join(maps, ["sender", "owner"])
    return common.staged(marked.mapInArrow(_receive, "doc_id long, sha binary, suspect boolean"), "marked")


def exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is replaced by one space; a null text counts
    as empty. The row with the smallest doc_id stays; a row without doc_id comes after all others, and of repeated
    rows (equal doc_id and text) one stays. Any further columns of `docs` are not read. No rows give no rows.
    """
    n_rows = docs.count()
    marked = exchange(spark, docs, n_rows)
    suspects = marked.filter("suspect")
    sizes = common.staged(suspects.groupBy("sha").agg(F.count("*").alias("rows")), "suspects")
    hot = sizes.filter(F.col("rows") > max(HOT_SALTS, n_rows // HOT_PART)).select("sha", F.lit(HOT_SALTS).alias("salts"))

    def salted(rows: DataFrame) -> DataFrame:
        """Hot groups, fewer than HOT_PART of them, are spread over salts."""
        return rows.join(F.broadcast(hot), "sha", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")

    def for_each_salt(groups: DataFrame) -> DataFrame:
        return groups.join(F.broadcast(hot), "sha", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.normalised(F.col("text")).alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    texts = common.with_bloom_hits(texts, F.xxhash64("sha"), sizes.select(F.xxhash64("sha").alias("h")), sizes.count())
    texts = salted(texts).join(for_each_salt(sizes.select("sha")), ["sha", "salt"], "left_semi")
    # equal bytes decide: the text itself is the grouping key, combined before the shuffle
    same = texts.groupBy("sha", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = same.groupBy("sha").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    groups = common.staged(groups.select("sha", "keep_id", "group_size", F.assert_true(F.col("texts") == 1, F.lit("two texts have one SHA-256")).alias("ok")).drop("ok"), "groups")

    once = W.partitionBy("sha", "doc_id").orderBy("sha")
    joined = salted(suspects.withColumn("copy", F.row_number().over(once))).join(for_each_salt(groups), ["sha", "salt"])
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    out = joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), hexed)
    alone = marked.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    return out.unionByName(alone)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, common.read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
