"""The pipeline's stages on small tables, each on what its predecessor kept."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from usage_audit.llm import common


def corpus(spark, path):
    random.seed(8)
    vocabulary = [f"v{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(240):
        words = random.choices(vocabulary, k=random.randint(10, 90))
        if i % 5 == 0:
            words.insert(random.randrange(len(words)), "idiot")
        docs.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000 + k, docs[k][1].replace(" ", "  "), "en", "s0", 0) for k in range(1, 20)]
    docs += [(2000 + k, docs[k][1] + " tail", "en", "s1", 0) for k in range(21, 60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    given = {d[0]: d for d in corpus(spark, tmp_path)}
    docs = common.read(spark, str(tmp_path), "documents")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == columns
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    clean = [i for i, d in given.items() if "idiot" not in d[1].split()]
    assert len(set(kept[0]) ^ set(clean)) <= 0.05 * len(given)
    first = {}
    for i in kept[0]:
        first.setdefault(" ".join(given[i][1].split()), i)
    assert kept[1] == sorted(first.values())
    assert set(kept[2]) <= set(kept[1]) and not any(2000 < i and (i - 2000) in kept[2] and len(given[i][1].split()) > 30 for i in kept[2])
    assert set(range(240)) & set(kept[1]) <= set(kept[2])  # of each class the smallest stays
    assert set(kept[3]) <= set(kept[2]) and max(map(kept[3].count, set(kept[3]))) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == len(set(kept[3]))


def test_stages_take_nothing_and_oddities(spark, odd_docs, no_docs, tmp_path):
    corpus(spark, tmp_path)
    for docs in (no_docs, odd_docs):
        n = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = common.staged(stage(spark, docs, str(tmp_path)), "stage")
            assert out.columns == docs.columns
            n.append(out.count())
        assert n[0] == docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()
    kept = corpus_pipeline.drop_copies(spark, odd_docs, str(tmp_path))
    assert kept.count() == 10
    assert corpus_pipeline.drop_near_copies(spark, odd_docs, str(tmp_path)).filter(F.col("text") == "no id at all").count() == 1


def test_run(spark, tmp_path):
    corpus(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 50
