"""Line dedup against brute force."""

import random

import pytest

from usage_audit.llm import lines


def brute(rows, least_documents, least_chars):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    found = {}
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            found[k] = found.get(k, 0) + 1
    goes = lambda x: len(key(x)) >= least_chars and found[key(x)] >= least_documents
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not goes(x)]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(spark, docs, *least):
    return sorted(map(tuple, lines.drop_frequent_lines(spark, docs, *least).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


@pytest.mark.parametrize("least", [(2, 1), (3, 0), (2, 5), (10, 1)])
def test_lines_of_odd_rows(spark, odd_docs, least):
    assert got(spark, odd_docs, *least) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], *least)


@pytest.mark.parametrize("hot", [1000, 5])
def test_lines_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT_PART", hot)
    random.seed(5)
    pool = ["Licence  x", " licence  x\t", "LICENCE  X\r", "été", "ÉTÉ", "ÉtÉ ", "a", "A", "", "  ", "\x0b", "İ", "i̇", "\x1c", "one line", "x" * 300]
    rows = [(i, "\n".join(random.choice([*pool, f"own {i} {random.random()}"]) for _ in range(random.randint(1, 9)))) for i in range(150)]
    rows += [(1000 + i, "Copied\nLicence  x\nthe same in all") for i in range(200)] + [(None, "no id\nlicence  x")] * 3 + [(7, None), (7, None), (8, ""), (9, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS n", "1 AS h", "2 AS lines", "3 AS `drop`").repartition(5)
    for least in ((10, 1), (4, 3)):
        assert got(spark, docs, *least) == brute(rows, *least)


def test_a_text_of_many_lines_is_split_once(spark):
    text = "\n".join(f"line {i % 40_000}" for i in range(60_000))
    kept = got(spark, spark.createDataFrame([(1, text), (2, "line 5\nLine 6 "), (3, "line 5")], "doc_id long, text string"), 3, 1)
    assert [(d, n, lost) for d, n, lost, _ in kept] == [(1, 60_000, 2), (2, 2, 1), (3, 1, 1)]
    assert kept[1][3] == "Line 6 " and kept[2][3] == ""


def test_lines_of_nothing(spark, no_docs):
    assert got(spark, no_docs) == []
