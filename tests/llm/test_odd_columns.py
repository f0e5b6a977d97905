"""Columns called like the helpers' own, rows without ids, slots at any size."""

import numpy as np
from pyspark.sql import functions as F

from usage_audit.llm import common, mixing, neighbours, sharding, toxicity

ODD = [f"{p}{n}" for n in ("key", "h", "of", "maybe", "keep", "n", "id", "place", "times", "toxic", "hash", "word", "mask", "at") for p in ("", "__")]


def with_odd(df):
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in ODD])


def test_helpers_keep_clashing_columns(spark, monkeypatch):
    docs = with_odd(spark.createDataFrame([(k, f"some words of text {k}", "s", "en") for k in range(40)], "doc_id long, text string, source string, lang string"))
    want = {r["doc_id"]: r for r in docs.collect()}
    decided = spark.createDataFrame([(k, k % 2 == 0) for k in range(10)], "k long, keep boolean").select(F.xxhash64("k").alias("h"), "keep")
    kept = common.keep_decided(docs, F.xxhash64("doc_id"), decided, 10)
    assert {r["doc_id"]: r for r in kept.collect()} == {k: r for k, r in want.items() if k >= 10 or k % 2 == 0}
    mixed = mixing.repeated(spark, docs).collect()
    assert mixed and all(r == want[r["doc_id"]] for r in mixed)
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: {})
    monkeypatch.setattr(toxicity, "scored", lambda docs, model, name: docs.withColumn(name, F.when(F.col("doc_id") < 5, 1.0).otherwise(0.0)))
    monkeypatch.setattr(common, "read", lambda *_: None)
    assert {r["doc_id"]: r for r in toxicity.without_toxic(spark, docs, "").collect()} == {k: r for k, r in want.items() if k >= 5}


def test_slots_follow_doc_id_at_any_size(spark):
    docs = spark.range(5000).select(F.when(F.col("id") % 9 > 0, F.col("id") % 1700).alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text")).repartition(9)
    got = sharding.assign_shards(spark, docs, 3).toPandas()
    assert len(got) == 5000
    for _, part in got.groupby("shard"):
        part = part.sort_values(["doc_id", "text_crc32", "size"], na_position="first")
        assert (part["slot"].to_numpy() >= 0).all() and sorted(part["slot"]) == list(range(len(part)))
        for at in range(len(part) - 1):
            a, b = part.iloc[at], part.iloc[at + 1]
            if tuple(a[["doc_id", "text_crc32", "size"]]) != tuple(b[["doc_id", "text_crc32", "size"]]) and not (np.isnan(a["doc_id"]) and np.isnan(b["doc_id"]) and (a["text_crc32"], a["size"]) == (b["text_crc32"], b["size"])):
                assert a["slot"] < b["slot"]


def test_neighbours_without_ids(spark):
    r = np.random.default_rng(3)
    e = r.normal(size=(60, 8))
    e[1:6] = e[0]
    rows = [(None if k in (0, 3, 4) else k, x.tolist()) for k, x in enumerate(e)] + [(None, e[10].tolist())] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for x in neighbours.nearest(spark, df, df.filter("vec_id % 20 = 0 or vec_id in (1, 10)"), 95).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(got) == {1, 10, 20, 40}
    for q, found in got.items():
        found.sort(key=lambda f: f[0])
        want = sorted(((-float(np.dot(e[q], v)), i is None, i) for i, v in ((i, np.array(v)) for i, v in rows) if i != q), key=lambda w: (round(w[0], 9), w[1], w[2] or 0))
        assert [f[1] for f in found] == [w[2] for w in want]  # all candidates: there are fewer than were asked for
        assert np.allclose([f[2] for f in found], [-w[0] for w in want])
