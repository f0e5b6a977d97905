"""Phrase mining against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from usage_audit.llm import phrases as P


def pieces(text):
    for p in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
        yield [w for w in re.split("[ \t]", p) if w]


def brute(rows, most_words, least, within, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, most_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in f.items() if a >= least}
    inside, extended = set(), {}
    for (lang, w), a in found.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and 100 * a >= within * f[lang, w[i:j]]:
                    inside.add((lang, w[i:j]))
        if len(w) > 2:
            for side, rest, word in ((1, w[:-1], w[-1]), (0, w[1:], w[0])):
                extended[lang, rest, side] = min(extended.get((lang, rest, side), (0, "")), (-a, word), key=lambda x: (x[0], x[1].encode()))
    out = []
    for lang in n:
        own = []
        for (x, w), a in found.items():
            if x == lang and len(w) > 1 and (x, w) not in inside:
                score, _, left, right = min((1000000 * a * a // (f[x, w[:k]] * f[x, w[k:]]), k, f[x, w[:k]], f[x, w[k:]]) for k in range(1, len(w)))
                own.append((score, a, " ".join(w), left, right, *[v for side in (0, 1) for v in ((lambda e: (e[1], -e[0]) if e else (None, None))(extended.get((x, w, side))))]))
        own.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], score, *more) for i, (score, a, p, left, right, *more) in enumerate(own[:top], 1)]
    return sorted(out)


def got(spark, docs, **options):
    return sorted(map(tuple, P.collocations(spark, docs, **options).collect()))


def test_words(spark):
    random.seed(2)
    texts = [None, "", "A b  c. d\te,f", "x", "é É\x0bz"] + ["".join(random.choice("abcAB \t.\n!é") for _ in range(random.randint(0, 30))) for _ in range(300)]
    for part in (slice(None), slice(3, 50), slice(0, 2)):
        words, begins = P.words_of(pa.array(texts, pa.string())[part])
        want = [(w, i == 0) for t in texts[part] for p in pieces(t) for i, w in enumerate(p)]
        assert list(zip([w.decode() for w in words.to_pylist()], begins.tolist(), strict=True)) == want


@pytest.mark.parametrize("sigma,many", [(4, 1), (40, 1), (3, 1 << 40)])
def test_intervals_of_both_directions(sigma, many, monkeypatch):
    random.seed(sigma)
    text = np.array([0] + [random.randint(0, sigma) for _ in range(500)], np.int32)
    if many > 1:  # the way for more symbols than fit one integer
        monkeypatch.setattr(P, "bwt", lambda t, depth: t[np.lexsort([np.roll(t, -i) for i in range(depth)][::-1]) - 1])
    index = P.FMIndex.of(text, 4)
    rows = [sorted(range(len(t)), key=lambda i, t=t: tuple(np.roll(t, -i)[:4])) for t in (text, text[::-1])]
    p = index.words()
    for m in range(1, 5):
        want = Counter(tuple(text[i : i + m].tolist()) for i in range(len(text) - m + 1) if (text[i : i + m] > 0).all())
        assert {tuple(i): n for i, n in zip(p.ids.tolist(), p.n.tolist(), strict=True)} == dict(want)
        for ids, n, there, back in zip(p.ids, p.n, *p.first, strict=True):
            for t, order, at, said in ((text, rows[0], there, ids), (text[::-1], rows[1], back, ids[::-1])):
                assert all((np.roll(t, -order[k])[:m] == said).all() for k in range(at, at + n))
        p = index.longer(p) if m < 4 else p


@pytest.mark.parametrize("held,log2", [(1 << 22, 20), (60, 20), (60, 0)])
def test_phrases_against_brute_force(spark, monkeypatch, held, log2):
    monkeypatch.setattr(P, "HELD_WORDS", held)
    monkeypatch.setattr(P, "MOST_LOG2_WORDS", log2)
    random.seed(9)
    word = lambda: random.choice("ab aé abc Der die das QUE la\x00  x b".split(" ") + [f"w{random.randint(0, 30)}"])
    rows = [("".join(word() + random.choice([" ", " ", " ", "\t", ". ", "\n", " the same old Story, "]) for _ in range(random.randint(0, 40))), random.choice(["en", "en", "de", None, "und", ""])) for _ in range(150)]
    rows += [(None, "en"), ("", None), ("copied copied copied text", "en")] + [("a hot text; of words", "hot")] * 100
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'p' AS phrase", "1 AS n", "2 AS words").repartition(4)
    for options in ({"most_words": 3, "least": 3, "within": 50, "top": 2000}, {"most_words": 4, "least": 2, "within": 80, "top": 7}, {"most_words": 2, "least": 5, "within": 50, "top": 10}):
        assert got(spark, docs, **options) == brute(rows, **options)


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    x = spark.range(1).selectExpr(f"cast({big} as decimal(15,0)) AS x", f"cast({big + 7} as decimal(15,0)) AS y", f"cast({big + 1} as decimal(15,0)) AS z")
    assert x.selectExpr("(x * x * 1000000) div (y * z) AS score").first()["score"] == 1000000 * big * big // ((big + 7) * (big + 1))


def test_phrases_of_nothing(spark, no_docs):
    assert got(spark, no_docs) == []
