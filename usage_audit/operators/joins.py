"""Joins that hold at any size of either side: rows that can't match stay where they are, hot keys are dealt over salts.

Helper columns get names that the frames don't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A filter has at most 2**this words of 64 bits: that bound is why it may be broadcast at any size of the input.
MOST_LOG2_WORDS = 20
#: A key that more than 1/HOT_PART of the rows hold is hot: there are fewer than HOT_PART such. Their rows are dealt over SALTS.
HOT_PART, SALTS = 1000, 64
#: Keys are counted in so many buckets by their hash first, to find those that may be hot.
BUCKETS = 1 << 16
#: Rows that a task joins, sorts or sums at once, about, where they are dealt by `dealt`.
ROWS_OF_TASK = 100_000


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, or the first of name_1, name_2 and so on, that is no column of the frames, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if n.lower() not in taken)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """`rows` by the hash of `keys` in as many tasks as `n` rows need. Partitions that Spark chooses are merged until they
    are large, for as many tasks as there are cores; these stay as they are, so a task's memory doesn't grow with the input."""
    return rows.repartition(n // ROWS_OF_TASK + 1, *keys)


def _word(h: Column, log2: int) -> Column:
    return F.shiftrightunsigned(h, 64 - log2)


def _bits(h: Column) -> Column:
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, by).bitwiseAND(F.lit(63)).cast("int"))
    return one(0).bitwiseOR(one(6)).bitwiseOR(one(12))


def maybe_among(rows: DataFrame, table: DataFrame, keys: list[str], n_keys: int | None = None) -> DataFrame:
    """The `rows` whose `keys` may be in `table`, and a few others; nothing is shuffled but the filter.

    A blocked Bloom filter with three bits a key, as a table (word, mask) that is broadcast. Beyond eight keys a word it
    lets more others through, none is missed: an exact join must follow. Null keys go.
    """
    n = table.count() if n_keys is None else n_keys
    log2 = max(6, min(MOST_LOG2_WORDS, max(1, n // 8).bit_length()))
    h, word, mask = unused("hash", rows), unused("word", rows), unused("mask", rows)
    words = table.select(F.xxhash64(*keys).alias(h)).groupBy(_word(F.col(h), log2).alias(word)).agg(F.bit_or(_bits(F.col(h))).alias(mask))
    known = rows.dropna(subset=keys).withColumn(h, F.xxhash64(*keys)).withColumn(f"{word}_of", _word(F.col(h), log2))
    return known.join(F.broadcast(words), F.col(f"{word}_of") == F.col(word)).filter(F.col(mask).bitwiseAND(_bits(F.col(h))) == _bits(F.col(h))).select(rows.columns)


def hot_keys(rows: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    """The `keys` that more than 1/HOT_PART of `rows`, and more than `least`, hold: fewer than HOT_PART. `rows` is read
    three times: buckets of keys are counted before the keys of crowded ones, fewer than HOT_PART, are."""
    n, most = unused("n", rows), max(rows.count() // HOT_PART, least)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    crowded = [r[0] for r in rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()]
    maybe = rows.filter(bucket.isin(crowded)) if crowded else rows.limit(0)
    return maybe.groupBy(*keys).agg(F.count("*").alias(n)).filter(F.col(n) > most).dropna(subset=keys).select(*keys)


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """`rows` joined with `table` on `keys`; `how` is inner, left or left_semi.

    The rows of a hot key, of which a list of fewer than HOT_PART is broadcast, are dealt over SALTS tasks, and what the
    table says of it is sent to each. Without `hot` (keys), `rows` is read three times more to find them: a written table is best.
    """
    salts, salt = unused("salts", rows, table), unused("salt", rows, table)
    hot = F.broadcast((hot_keys(rows, keys) if hot is None else hot).withColumn(salts, F.lit(SALTS)))
    dealt = rows.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col(salts)), F.lit(0)).cast("int")).drop(salts)
    copies = table.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(salts)
    return dealt.join(copies, [*keys, salt], how).drop(salt)
