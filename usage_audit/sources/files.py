"""Reading files and logs, and upserting tables."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .. import vocabulary as V
from ..operators.joins import unused


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, suffix, content, bytes) of every file under `root`; only textual files have content, none is left out.

    path is relative to `root`. A byte order mark goes and line ends become line feeds.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", ""), "\r\n?", "\n")
    tail = root.rstrip("/").split("://")[-1]
    relative = F.substring_index(F.col("path"), tail + "/", -1)
    return raw.select(relative.alias("path"), suffix.alias("suffix"), F.when(suffix.isin(*V.TEXT_SUFFIXES), text).alias("content"), F.col("length").alias("bytes"))


def write_artifacts(rows: DataFrame, root: str) -> int:
    """Write the `content` (null: empty) of each of `rows` (path, content) to a file of its own at `path` under `root`, a
    folder that all tasks reach; the number of files. Paths must be distinct; a repeated task writes the same again.

    Tasks write them themselves: as Spark's partitions each would be a folder, with a writer and commit of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                at = f"{base.rstrip('/')}/{path.as_py()}"
                folder = at.rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(at) as out:
                    out.write((content.as_py() or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    fs, base = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)  # for no rows, no files
    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files under `paths` by their column names: their first lines, read in one job over all of them."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    by_names: dict[tuple[str, ...], list[str]] = {}
    for r in first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect():  # names of files, as many as the caller has
        names = [c.replace("\ufeff", "").strip().upper() for c in next(csv.reader([r["header"]]), [])]
        names = [n if n and n not in names[:k] else f"{n}_{k}" for k, n in enumerate(names)]
        by_names.setdefault(tuple(names), []).extend(map(unquote, r["files"]))
    return by_names


def read_event_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of CSV logs with differing columns, all strings, names trimmed and in upper case, plus LOG_FILE.

    A missing column is null; a name that a file has twice, or none, gets its position added. EVENT_TYPE comes from its
    column, else from the file's name. Files of one header are one scan, however many they are; empty files say nothing.
    """

    def one(names: tuple[str, ...], files: list[str]) -> DataFrame:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(files)
        return df.withColumn("LOG_FILE", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))

    found = _headers(spark, paths)
    none = spark.createDataFrame([], "EVENT_TYPE string, LOG_FILE string")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(names, files) for names, files in found.items()] or [none])
    said = F.nullif(F.trim("EVENT_TYPE"), F.lit("")) if "EVENT_TYPE" in rows.columns else F.lit(None).cast("string")
    from_name = F.coalesce(F.nullif(F.regexp_extract("LOG_FILE", r"\(([A-Za-z]+)\)", 1), F.lit("")), F.regexp_extract("LOG_FILE", r"^([A-Za-z]+)", 1))
    return rows.withColumn("EVENT_TYPE", F.coalesce(said, from_name))


#: A type's files are ranked in this many parts first.
RANK_PARTS = 64


def latest_log_files(files: DataFrame, since, per_type: int) -> DataFrame:
    """Of `files` (event_type, log_date, file, ...) the newest `per_type` of each type since then; if a type has none so new,
    its newest min(per_type, 3) of any age.

    The newest of each of RANK_PARTS parts of a type come first, then the newest of these: no task has a whole type. If
    any file of a type is new enough, its newest is.
    """
    most = max(per_type, 3)
    part, n, new = (unused(name, files) for name in ("part", "n", "new"))
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("log_date"), "file"))
    few = files.withColumn(part, F.pmod(F.xxhash64("file", "log_date"), F.lit(RANK_PARTS))).withColumn(n, place("event_type", part)).filter(F.col(n) <= most)
    ranked = few.withColumn(n, place("event_type")).filter(F.col(n) <= most).withColumn(new, F.col("log_date") >= F.lit(since))
    recent = F.coalesce(F.col(new), F.lit(False))
    any_new = F.max(recent).over(W.partitionBy("event_type"))
    return ranked.withColumn(part, any_new).filter(F.when(F.col(part), recent & (F.col(n) <= per_type)).otherwise(F.col(n) <= min(per_type, 3))).drop(part, n, new)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], policy: str, columns: list[str] | None = None) -> DataFrame:
    """`existing` with `incoming` put in: where a key is in both, `columns` (all others if not given) are treated by `policy`.

    replace: the new value; keep: the old row; coalesce: the new value unless it is null; add: the sum. Equal keys within
    `incoming` must have been settled before.
    """
    if policy not in ("replace", "keep", "coalesce", "add"):
        raise ValueError(f"no such policy: {policy}")
    others = [c for c in existing.columns if c not in keys]
    touched = set(columns or others)
    a = existing.select(*keys, F.struct(*others).alias("__a"))
    b = incoming.select(*keys, F.struct(*others).alias("__b"))

    def value(c: str):
        old, new = F.col(f"__a.{c}"), F.col(f"__b.{c}")
        both = {"replace": new, "keep": old, "coalesce": F.coalesce(new, old), "add": F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))}[policy] if c in touched else old
        return F.when(F.col("__b").isNull(), old).when(F.col("__a").isNull(), new).otherwise(both).alias(c)

    return a.join(b, keys, "full").select(*keys, *map(value, others))
