"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, table, text_or_empty
from tickloom.llm.registry import query
from tickloom.llm.shingles import similar, sketch

C = F.col
#: Labelled rows the model is fitted on, at most, and words it knows, at most.
FIT_ROWS, MAX_WORDS = 8000, 50_000
#: A word is known if it is in so many of those rows and its share of toxic ones is so many standard errors off.
MIN_ROWS, MIN_Z = 6, 4.0
#: Rows that share so many per cent of their words are copies; minwise tokens looked at first.
COPY, MINIMA = 80, 64
#: A sentence offends from this score on.
OFFENDS = 0.5

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def _sentence_words(text: str) -> list[tuple[int, int, set[str]]]:
    return [(m.start(), m.end(), set(_WORD.findall(m.group().lower()))) for m in _SENTENCE.finditer(text)]


@dataclass
class SentenceModel:
    """log-odds of a sentence = bias + the weights of its distinct words; P(document) = 1 - product of (1 - p) over its sentences."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text, and (start, end, score) of the sentences that offend."""
        get, bias, clean, offending = self.weights.get, self.bias, 0.0, []
        for start, end, words in _sentence_words(text):
            z = bias + sum([w for w in map(get, words) if w is not None])
            clean -= np.log1p(np.exp(z)) if z < 30 else z
            if z >= 0:
                offending.append((start, end, float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(clean)), offending


def one_of_each(texts: list[str], labels: list[int]) -> tuple[list[str], list[int]]:
    """One of the rows that share a label and ``COPY`` per cent of their words: words of a much-copied text would look telling.

    Rows kept so far are candidates if their minwise tokens agree; the whole word sets decide.
    """
    kept = {0: [], 1: []}
    marks = {k: np.zeros((len(texts), MINIMA), np.uint16) for k in kept}
    for text, label in zip(texts, labels):
        words = np.unique(np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(_WORD.findall(text.lower()))], np.uint64))
        own, known = sketch(words)[:MINIMA].astype(np.uint16), marks[label][: len(kept[label])]
        near = np.flatnonzero((known == own).mean(1) >= COPY / 100 - 0.2) if len(known) else ()
        if not any(len(words) == len(kept[label][i][1]) == 0 or similar(words, kept[label][i][1], COPY) for i in near):
            marks[label][len(kept[label])] = own
            kept[label].append((text, words))
    return [t for k in kept for t, _ in kept[k]], [k for k in kept for _ in kept[k]]


def fit(texts: list[str], labels: list[int], rounds: int = 200, rate: float = 0.1, shrink: float = 2e-4) -> SentenceModel:
    """Maximise the documents' likelihood by gradient steps (Adam) over all of them.

    With s = softplus(z) summed over a document, log(1 - P) = -s: the gradient by a sentence's z is p for label 0 and
    -p (1 - P) / P for label 1, so the sentences that explain a label get the credit. Weights shrink towards 0 by
    their absolute size, which leaves out words that only happened to be near. Texts are split twice, so that only the
    known words' places are held.
    """
    seen, toxic = Counter(), Counter()
    for text, label in zip(texts, labels):
        words = set(_WORD.findall(text.lower()))
        seen.update(words)
        toxic.update(words if label else ())
    share = sum(labels) / max(1, len(labels))
    z = {w: (toxic[w] - n * share) / (n * share * (1 - share)) ** 0.5 for w, n in seen.items() if n >= MIN_ROWS}
    known = {w: i for i, w in enumerate(sorted((w for w in z if abs(z[w]) >= MIN_Z), key=lambda w: (-abs(z[w]), w))[:MAX_WORDS])}
    doc_of, sentence_of, feature = array("q"), array("q"), array("q")
    for d, text in enumerate(texts):
        for _, _, words in _sentence_words(text):
            own = sorted(known[w] for w in words if w in known)
            sentence_of.extend([len(doc_of)] * len(own))
            feature.extend(own)
            doc_of.append(d)
    doc_of, sentence_of, feature = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (doc_of, sentence_of, feature))
    y = np.asarray(labels, float)
    theta, bias = np.zeros(len(known)), -4.0
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for i in range(1, rounds + 1):
        z = bias + np.bincount(sentence_of, theta[feature], len(doc_of))
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(doc_of, np.logaddexp(0, z), len(y)))
        pull = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0) / max(1, len(y))
        g = p * pull[doc_of]
        grad = np.r_[np.bincount(feature, g[sentence_of], len(known)), g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        theta, bias = theta - step[:-1], bias - step[-1]
        theta = np.sign(theta) * np.maximum(np.abs(theta) - rate * shrink * 10, 0)
    return SentenceModel({w: float(theta[i]) for w, i in known.items() if theta[i]}, float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` labelled documents, the same ones at every run; one label in five is held out."""
    used = labels.where(C("toxic").isin(0, 1) & C("doc_id").isNotNull() & ~held_out(C("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = used.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.dropDuplicates(["doc_id"]).collect()  # at most FIT_ROWS texts
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_texts(docs: DataFrame, model: SentenceModel, score: str = "tox_score", spans: str = "tox_spans") -> DataFrame:
    """``docs`` with a score and the sentences that offend (``start, end, score``) of every whole text.

    ``score`` and ``spans`` name these two columns; a column of ``docs`` of that name is an error (``common.fresh`` finds a free one). Null and empty texts get the score of no sentence, which the
    model's bias gives; every row is scored on its own, so repeats and shared or null ids do not matter; an empty table gives no rows.
    """
    if {score.lower(), spans.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table already has a column {score} or {spans}")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_WORDS words
    text = fresh("__text", docs)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for frame in batches:
            found = [own.score(t or "") for t in frame[text]]
            frame[score] = [s for s, _ in found]
            frame[spans] = [[dict(zip(("start", "end", "score"), x)) for x in o] for _, o in found]
            yield frame

    row = docs.withColumn(text, text_or_empty())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in row.schema)
    return row.mapInPandas(scored, f"{schema}, `{score}` double, `{spans}` array<struct<start:int,end:int,score:double>>").drop(text)


def fit_from(docs: DataFrame, labels: DataFrame) -> SentenceModel:
    """Without labelled rows of both kinds the model knows no word and its bias follows the share of toxic rows."""
    texts, toxic = training_rows(docs, labels)
    if len(set(toxic)) < 2:
        return SentenceModel({}, -12.0)
    return fit(*one_of_each(texts, toxic))


@query("op3_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fit_from(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(C("doc_id")).alias("held_out"), C("tox_score").alias("score"),
                         (C("tox_score") >= 0.5).cast("int").alias("predicted"), F.size("tox_spans").alias("n_offending"))
