"""Helpers shared by the operators: reading tables, cutting lineage, skew-safe filters and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.graph import components, cut, shared_folder  # noqa: F401  the same here as there
from ..operators.joins import unused

#: ASCII white space, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
#: A run of anything else: a word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for `name` in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and rows can't change on a retry."""
    return cut(df, name)


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _word(h: Column, log2: int) -> Column:
    return F.shiftrightunsigned(h, 64 - log2)


def _bits(h: Column) -> Column:
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, by).bitwiseAND(F.lit(63)).cast("int"))
    return one(0).bitwiseOR(one(6)).bitwiseOR(one(12))


def with_bloom_mark(df: DataFrame, hashed: Column, keys: DataFrame, n_keys: int, max_log2_words: int = 20, mark: str = "__maybe") -> DataFrame:
    """`df` with column `mark`: may its 64-bit `hashed` be among column ``h`` of `keys`?

    A blocked Bloom filter of one 64-bit word a key, three bits each, kept as a table (word, mask) of at most
    2**max_log2_words rows: that bound is why it may be broadcast at any size of the input. When more keys come
    than it was sized for, more rows are marked; none is missed, and callers join exactly afterwards.
    """
    log2 = max(6, min(max_log2_words, max(1, n_keys // 8).bit_length()))
    h, of, word, mask = (unused(n, df) for n in ("hash", "of", "word", "mask"))
    words = keys.groupBy(_word(F.col("h"), log2).alias(word)).agg(F.bit_or(_bits(F.col("h"))).alias(mask))
    probed = df.withColumn(h, hashed).withColumn(of, _word(F.col(h), log2))
    joined = probed.join(F.broadcast(words), F.col(of) == F.col(word), "left")
    maybe = F.coalesce(F.col(mask).bitwiseAND(_bits(F.col(h))) == _bits(F.col(h)), F.lit(False))
    return joined.withColumn(mark, maybe).drop(h, of, word, mask)


def with_bloom_hits(df: DataFrame, hashed: Column, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows of `df` whose 64-bit `hashed` may be among column ``h`` of `keys`."""
    mark = unused("maybe", df)
    return with_bloom_mark(df, hashed, keys, n_keys, mark=mark).filter(F.col(mark)).drop(mark)


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `table`, which has few rows a key; `how` is inner or left.

    Keys that more than a thousandth of `rows` hold, fewer than 1000, would meet in one task each: what the table says
    of these is broadcast to wherever their rows are.
    """
    n = unused("n", rows)
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias(n)).filter(F.col(n) * 1000 > rows.count()).filter(F.col(key).isNotNull()).select(key))
    here = rows.join(F.broadcast(table.join(hot, key, "left_semi")), key, how).join(hot, key, "left_semi")
    return here.unionByName(rows.join(hot, key, "left_anti").join(table, key, how))


def keep_decided(docs: DataFrame, key: Column, decisions: DataFrame, n_decisions: int) -> DataFrame:
    """`docs` without the rows that `decisions` (h long, keep boolean) drops; of equal keys that stay, one row stays.

    Only rows whose key is in the Bloom filter of the decided keys are shuffled; all others stay where they are.
    """
    columns = docs.columns
    by, mark, stays, n = (unused(name, docs) for name in ("key", "maybe", "keep", "n"))
    marked = with_bloom_mark(docs.withColumn(by, key), F.col(by), decisions.select("h"), n_decisions, mark=mark)
    sure = marked.filter(~F.col(mark)).select(columns)
    maybe = marked.filter(mark).join(decisions.select(F.col("h").alias(by), F.col("keep").alias(stays)), by, "left")
    undecided = maybe.filter(F.col(stays).isNull()).select(columns)
    first = F.row_number().over(W.partitionBy(by).orderBy(by))
    rest = maybe.filter(stays).withColumn(n, first).filter(F.col(n) == 1).select(columns).unionByName(undecided)
    return sure.unionByName(rest)
