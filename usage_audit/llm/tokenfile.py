"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus' frequencies, so the common ones take one byte. A file holds the documents
of one range of doc_id in ascending order:

    magic "TIDS", version, number of documents and of ids, bytes of the rank table   (unsigned, little-endian)
    doc_id of each document (64 bit), ids of each document (64 bit)
    rank table: the id of each rank (32 bit), for the ranks that the file uses
    control bytes, two bits for each id: its bytes less one, four ids a byte, the first in the lowest bits
    data bytes

A decoder looks each control byte up in a table of 256 rows to get four lengths, sums them and gathers.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import common, tokens

#: Appended to each document.
END_ID = 1
#: Ids are below this: the size of the frequency table, and the bound of its broadcast.
VOCABULARY = 1 << 16
#: Ids of a file, about, unless a document alone has more: the bound of a task's memory. Files come in ascending doc_id.
IDS_PER_FILE = 4_000_000

_HEADER = np.dtype([("magic", "S4"), ("version", "<u4"), ("docs", "<u8"), ("ids", "<u8"), ("ranks", "<u8")])
_LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3).astype(np.uint8) + 1


def encode(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, id_of_rank: np.ndarray) -> bytes:
    """A file of these documents; `id_of_rank` lists the ids, the most frequent first."""
    rank_of = np.zeros(VOCABULARY, np.uint32)
    rank_of[id_of_rank] = np.arange(len(id_of_rank), dtype=np.uint32)
    ranks = rank_of[ids]
    used = int(ranks.max()) + 1 if len(ranks) else 0
    size = np.uint8(1) + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two_bits = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    two_bits[: len(ranks)] = size - 1
    control = (two_bits.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1, dtype=np.uint8)
    parts = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = parts[np.arange(4) < size[:, None]]
    head = np.array([(b"TIDS", 1, len(doc_ids), len(ids), used)], _HEADER)
    return b"".join((head.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), id_of_rank[:used].astype("<u4").tobytes(), control.tobytes(), data.tobytes()))


def decode(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, and all ids, of a file."""
    head = np.frombuffer(content, _HEADER, 1)[0]
    if head["magic"] != b"TIDS" or head["version"] != 1:
        raise ValueError("not a token-id file of version 1")
    docs, n, ranks, at = int(head["docs"]), int(head["ids"]), int(head["ranks"]), _HEADER.itemsize
    doc_ids, counts = np.frombuffer(content, "<i8", 2 * docs, at).reshape(2, docs)
    at += 16 * docs
    id_of_rank = np.frombuffer(content, "<u4", ranks, at)
    at += 4 * ranks
    control = np.frombuffer(content, np.uint8, -(-n // 4), at)
    data = np.frombuffer(content, np.uint8, offset=at + len(control))
    sizes = _LENGTHS[control].ravel()[:n]
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    rank = data[first].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for byte in range(1, int(sizes.max()) if n else 0):
        more = np.flatnonzero(sizes > byte)
        rank[more] |= data[first[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return doc_ids, counts, id_of_rank[rank] if n else rank


def tokenised(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, row, ids) of each row: a number of its own, its word BPE ids and the end id, in 16-bit integers."""
    end = np.array([END_ID], np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = tokens.word_encoder(folder)
        for whole in batches:
            for batch in tokens.slices(whole, 2):
                ids = [x + end for x in encoded(batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["doc_id", "row", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, ids binary")


def frequencies(ids: DataFrame) -> np.ndarray:
    """How often each id occurs; VOCABULARY sums, whatever the input."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16), minlength=VOCABULARY)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["id", "n"])

    sums = ids.select("ids").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(VOCABULARY, np.int64)
    for r in sums.toLocalIterator():
        out[r["id"]] = r["n"]
    return out


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """All ids, the most frequent first, ties by id."""
    return np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)


def write_files(spark: SparkSession, docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Write the token-id files of `docs` (doc_id, text) under `path`, a URI that all executors reach.

    Rows are dealt to partitions by ranges of (doc_id, row), rows without doc_id last, so that neither a repeated doc_id
    nor a missing one is bound to one partition; each partition writes files of about IDS_PER_FILE ids one after
    another, named by partition and number, which is their order. Each is written under another name and moved when
    complete, so a repeated task leaves whole files. Returns (part int, number int, name string, docs long, ids long).
    """
    fs, base = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)  # for no documents, no files
    ids = common.staged(tokenised(docs, folder), "ids")
    counts = frequencies(ids)
    ranks = spark.sparkContext.broadcast(by_frequency(counts).tobytes())
    parts = max(1, int(-(-counts.sum() // (2 * IDS_PER_FILE))))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row").asc()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        part, number, held, doc_ids, lists = TaskContext.get().partitionId(), 0, 0, [], []

        def file() -> pa.RecordBatch:
            counts = np.fromiter(map(len, lists), np.int64, len(lists)) // 2
            content = encode(np.array(doc_ids, np.int64), counts, np.frombuffer(b"".join(lists), np.uint16), np.frombuffer(ranks.value, np.uint32))
            name, draft = f"tokens-{part:08d}-{number:08d}.tids", f"{base}/_draft-{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write(content)
            fs.move(draft, f"{base}/{name}")
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([len(lists)], pa.int64()), pa.array([int(counts.sum())], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "number", "name", "docs", "ids"])

        for batch in batches:
            for doc_id, x in zip(batch.column(0).fill_null(NO_ID).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lists and held + len(x) // 2 > IDS_PER_FILE:
                    yield file()
                    number, held, doc_ids, lists = number + 1, 0, [], []
                held += len(x) // 2
                doc_ids.append(doc_id)
                lists.append(x)
        if lists:
            yield file()

    dealt = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return common.staged(dealt.mapInArrow(write, "part int, number int, name string, docs long, ids long"), "files")


#: Stands in a file for a row without doc_id.
NO_ID = np.iinfo(np.int64).min


def read_files(spark: SparkSession, path: str, written: DataFrame, digest: bool = False) -> DataFrame:
    """The documents of the files under `path`: doc_id, start, n_tokens, ids (32-bit), in any order; with `digest`
    ids_crc32, made where the file is decoded, instead of ids.

    start counts the ids of all documents before it, in ascending doc_id; rows without doc_id come last.
    """
    before = lambda window: F.sum("ids").over(window) - F.col("ids")
    parts = written.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", before(W.orderBy("part")).alias("of_part"))
    inside = written.select("part", "name", before(W.partitionBy("part").orderBy("number")).alias("of_file"))
    starts = inside.join(parts, "part").select("name", (F.col("of_part") + F.col("of_file")).alias("first"))
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, counts, ids = decode(content.as_buffer())
                ids = ids.astype("<u4", copy=False)
                ends = np.cumsum(counts)
                for i in range(0, len(doc_ids), 2000):
                    part = slice(i, i + 2000)
                    cut = [ids[b - n : b] for n, b in zip(counts[part], ends[part], strict=True)]
                    last = pa.array([zlib.crc32(x) for x in cut], pa.int64()) if digest else pa.array([x.tobytes() for x in cut], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut)), pa.array(doc_ids[part], mask=doc_ids[part] == NO_ID), pa.array(ends[part] - counts[part]), pa.array(counts[part]), last], names=schema.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tids").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(run, schema).join(starts, "name").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32" if digest else "ids")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-files")
    written = write_files(spark, common.read(spark, sf_dir, "documents"), path, tokens.vocabulary_dir())
    return read_files(spark, path, written, digest=True)
