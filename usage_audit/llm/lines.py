"""Line dedup, with DataFrame functions only.

The lines of each document are exploded and their normalised form hashed; a hash that enough documents hold marks its
lines everywhere. Which positions of a text go is put together again by the text's own hash, and the text without them
is joined by position. Only hashes, positions and the texts that lose a line are shuffled.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What is stripped at both ends of a line.
EDGES = " \t\n\x0b\x0c\r"
#: A line or text with more than 1/HOT_PART of the hits is hot: there are fewer than HOT_PART such. Hot texts' rows are
#: spread over this many salts.
HOT_PART, SALTS = 1000, 64


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(EDGES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def _hash(value: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits, in two columns."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


def frequent_lines(docs: DataFrame, least_documents: int, least_chars: int) -> DataFrame:
    """(h, g, n): hashes of the line keys of `least_chars` code points that `least_documents` rows of `docs` (text) hold.

    A key counts once a row, so no distinct count is shuffled: rows are documents.
    """
    keys = F.array_distinct(F.transform(F.split("text", "\n", -1), line_key))
    each = docs.select(F.explode(keys).alias("key")).filter(F.char_length("key") >= least_chars)
    return each.select(_hash(F.col("key"), ("h", "g"))).groupBy("h", "g").agg(F.count("*").alias("n")).filter(F.col("n") >= least_documents)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, least_documents: int = 10, least_chars: int = 1) -> DataFrame:
    r"""One row for each row of `docs` (doc_id, text): doc_id, n_lines, n_dropped, text.

    Texts are split at \n. A line whose key (line_key) has `least_chars` code points or more and is found in
    `least_documents` rows or more is dropped wherever it stands; the others are joined by \n in their order. A null or
    empty text is one empty line and stays an empty text, as does one that loses all its lines. Equal lines of one row
    count once; repeated rows and rows without doc_id are documents like others. Further columns are not read; no rows
    give no rows. Lines and texts are told apart by 128 bits of their hashes.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.select("*", *_hash(F.col("text"), ("a", "b")))
    frequent = common.staged(frequent_lines(texts, least_documents, least_chars), "frequent-lines")
    n_lines, n_hits = frequent.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    # hot lines are looked up where they are; of the others those that the filter lets through meet the list
    hot = frequent.filter(F.col("n") * HOT_PART > n_hits).select("h", "g", F.lit(True).alias("hot"))
    hashed = F.transform(F.split("text", "\n", -1), lambda x: F.struct(_hash(line_key(x), ("h", "g"))))
    placed = texts.select("a", "b", F.posexplode(hashed).alias("pos", "line")).select("a", "b", "pos", "line.*")
    placed = common.with_bloom_mark(placed.join(F.broadcast(hot), ["h", "g"], "left"), F.col("h"), frequent.select("h"), n_lines)
    candidates = common.staged(placed.filter("hot or __maybe").drop("__maybe"), "candidate-lines")
    found = candidates.filter("hot").select("a", "b", "pos").unionByName(candidates.filter("hot is null").join(frequent, ["h", "g"], "left_semi").select("a", "b", "pos"))
    # copies of a text say the same; they are combined before the shuffle
    dropped = found.groupBy("a", "b").agg(F.collect_set("pos").alias("drop"), F.count("*").alias("hits"))
    dropped = common.staged(dropped.withColumn("rows", F.col("hits") / F.size("drop")), "dropped-lines")
    n_texts, n_rows = dropped.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()

    hot_texts = F.broadcast(dropped.filter(F.col("rows") * HOT_PART > n_rows).select("a", "b", F.lit(SALTS).alias("salts")))
    marked = common.with_bloom_mark(texts, F.col("a"), dropped.select(F.col("a").alias("h")), n_texts)
    rows = marked.filter("__maybe").join(hot_texts, ["a", "b"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)).cast("int"))
    drops = dropped.select("a", "b", "drop").join(hot_texts, ["a", "b"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
    joined = rows.select("doc_id", "text", "a", "b", "salt").join(drops.select("a", "b", "salt", "drop"), ["a", "b", "salt"], "left").select("doc_id", "text", "drop")
    joined = joined.unionByName(marked.filter("not __maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("drop")))
    # `lines` is named twice below, so that the optimizer splits a text once and not for each line
    split = joined.select("doc_id", "text", "drop", F.split("text", "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return split.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(spark, common.read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
s AS (SELECT row, string_agg(line, chr(10) ORDER BY pos) AS kept, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM f) GROUP BY row)
SELECT doc_id, len(lines) AS n_lines, len(lines) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (row)
"""
