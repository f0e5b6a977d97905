"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its words; the document's is their
noisy-or, 1 - prod(1 - p). Only documents are labelled: the gradient of the document's likelihood reaches each sentence
through the noisy-or, so the sentences that explain the labels are found, and with them the offending places.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import unused
from . import common

#: At most so many labelled documents are fitted on, drawn by hash of their ids: the bound of the fit's memory and time.
FIT_DOCS = 10_000
#: At most so many features get a weight, those in MIN_DOCS documents or more that tell most about the label.
FIT_WORDS, MIN_DOCS, EVIDENCE, PREFIX = 20_000, 3, 12.0, 4
#: A document is rejected at this score.
THRESHOLD = 0.3

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def spans(text: str) -> list[tuple[int, int]]:
    """Where the sentences of `text` begin and end; none is blank."""
    return [m.span() for m in _SENTENCE.finditer(text) if not m[0].isspace()]


def sentences(text: str) -> list[str]:
    return [text[a:b] for a, b in spans(text)]


def features(sentence: str) -> set[str]:
    """The lower-cased words and, marked by *, the first PREFIX letters of the longer ones: endings vary."""
    words = set(_WORD.findall(sentence.lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


def telling(texts: list[str], y: np.ndarray) -> dict[str, int]:
    """Numbers for the features that are commoner in toxic documents: chi-square of EVIDENCE or more."""

    def counted(label: bool, among: set[str] | None = None) -> Counter:
        found: Counter = Counter()
        for i in np.flatnonzero(y == label):
            has = set().union(*map(features, sentences(texts[i])))
            found.update(has if among is None else has & among)
        return found

    toxic = {w: n for w, n in counted(True).items() if n >= MIN_DOCS}
    clean = counted(False, set(toxic))
    n, pos, names = len(y), int(y.sum()), sorted(toxic)
    a, b = np.array([toxic[w] for w in names], float), np.array([clean[w] for w in names], float)
    c, d = pos - a, n - pos - b
    chi = n * (np.abs(a * d - b * c) - n / 2).clip(0) ** 2 / np.maximum((a + b) * (c + d) * pos * (n - pos), 1)
    chi[a * d <= b * c] = 0
    order = np.lexsort((np.arange(len(names)), -chi))[:FIT_WORDS]
    return {names[i]: k for k, i in enumerate(i for i in order if chi[i] >= EVIDENCE)}


def fit_bags(texts: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4) -> dict[str, float]:
    """Feature weights, and the sentence's bias at "", fitted to document labels by Adam on the noisy-or likelihood."""
    words = telling(texts, labels)
    # one entry for each known word of each sentence; sentences with none share one that only counts
    doc_of, sizes, cols = [], [], []
    plain = np.zeros(len(texts))
    for d, text in enumerate(texts):
        for s in sentences(text):
            got = sorted(words[w] for w in features(s) & words.keys())
            if got:
                doc_of.append(d)
                sizes.append(len(got))
                cols.extend(got)
            else:
                plain[d] += 1
    doc_of, cols = np.array(doc_of, np.int64), np.array(cols, np.int64)
    starts = np.cumsum([0, *sizes])[:-1]
    sent_of = np.repeat(np.arange(len(sizes)), sizes)
    y = labels.astype(float)
    theta = np.zeros(len(words) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, rounds + 1):
        z = theta[-1] + (np.add.reduceat(theta[cols], starts) if len(starts) else np.zeros(0))
        hazard = np.bincount(doc_of, softplus(z), len(texts)) + plain * softplus(theta[-1])  # -log of prod(1 - p)
        # d loss / d hazard: 1 for a clean document, -(1 - P) / P for a toxic one
        slope = np.where(y > 0, -1 / np.expm1(np.clip(hazard, 1e-6, 50)), 1.0) / len(texts)
        by_sentence = slope[doc_of] / (1 + np.exp(-z))
        grad = np.append(np.bincount(cols, by_sentence[sent_of], len(words)) + decay * theta[:-1], by_sentence.sum() + (slope * plain).sum() / (1 + np.exp(-theta[-1])))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return {"": float(theta[-1])} | {w: float(theta[i]) for w, i in words.items()}


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> dict[str, float]:
    """Fit on at most `limit` labelled rows of `docs`; the held-out rows, crc32(doc_id) mod 4 = 2, are never read.

    Without labelled rows, or with labels of one kind only, every document scores 0.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(limit)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    # rows that repeat a doc_id could be more: then, too, the same ones are taken at every run
    sample = sample.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id", F.xxhash64("text"), "text").limit(limit)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        y = rows["toxic"].to_numpy() > 0
        got = fit_bags(rows["text"].tolist(), y) if 0 < y.sum() < len(y) else {"": -50.0}
        return pd.DataFrame({"word": list(got), "weight": list(got.values())})

    # at most `limit` rows, whatever the input: one group
    fitted = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(one, "word string, weight double")
    return {r["word"]: r["weight"] for r in fitted.toLocalIterator()} or {"": -50.0}


def held_out(doc_id):
    """Is a row held out? One without doc_id is not, but has no label either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def scored(docs: DataFrame, model: dict[str, float], name: str = "score", where: bool = False) -> DataFrame:
    """`docs` with each text's probability in column `name`; with `where`, also its likeliest sentence: from which
    character of the text (worst_start) up to which (worst_end), and its probability (worst_score).

    A null or empty text has no sentence: it scores 0, and the place is null. Equal texts score alike; of equally likely
    sentences the first is located. Columns of `docs` that are called like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {name: "double"} | ({"worst_start": "int", "worst_end": "int", "worst_score": "double"} if where else {})
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        bias = weights[""]
        words, get = weights.keys(), weights.get
        for batch in batches:
            texts = batch.column(columns.index("text")).to_pylist()
            n, first = np.zeros(len(texts)), np.full((len(texts), 2), -1)
            doc, z, place = [], [], []  # of the sentences with known features
            for i, text in enumerate(texts):
                found = spans(text) if text else []
                if found:
                    n[i] = len(found)
                    for span in found:
                        if known := words & features(text[span[0] : span[1]]):
                            doc.append(i)
                            z.append(bias + sum(map(get, sorted(known))))
                            place.append(span)
                        elif first[i, 0] < 0:
                            first[i] = span  # of the sentences without any
            doc, z, place = np.array(doc, np.int64), np.array(z), np.array(place).reshape(-1, 2)
            plain = n - np.bincount(doc, minlength=len(n))
            hazard = np.bincount(doc, np.logaddexp(0, z), len(n)) + plain * np.logaddexp(0, bias)
            out = [pa.array(-np.expm1(-hazard))]
            if where:
                top, at = np.where(n > 0, bias, -np.inf), first
                best = np.lexsort((-place[:, 0], z, doc))  # a document's best sentence is its last
                best = best[np.append(doc[best][1:] != doc[best][:-1], True)] if len(best) else best
                best = best[(z[best] > bias) | (plain[doc[best]] == 0)]
                top[doc[best]], at[doc[best]] = z[best], place[best]
                out += [pa.array(at[:, k], pa.int32(), mask=n == 0) for k in (0, 1)] + [pa.array(1 / (1 + np.exp(-top)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*columns, *added])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{c}` {kind}" for c, kind in added.items()])
    return docs.mapInArrow(run, fields)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its score and verdict, and the place and probability of its likeliest sentence."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, common.read(spark, sf_dir, "labels")), where=True)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, with their columns."""
    model = fit(docs, common.read(spark, sf_dir, "labels"))
    name = unused("toxic", docs)
    return scored(docs, model, name).filter(F.col(name) < THRESHOLD).select(docs.columns)
