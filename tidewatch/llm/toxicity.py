"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic value of
its words' weights; the document's is their noisy-or, 1 - prod(1 - p), so one
offending sentence is enough. Only document labels are known: the weights are
learned by following the noisy-or's gradient back to the sentences. The same
scores then tell which sentences offend.

Learning reads at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean labelled
documents, those with the smallest hash of their id; scoring covers every row
and whole texts.

Defined cases: null and empty texts have no sentence and score 0; repeated rows
are scored each; labels that are null or belong to no document are not learned
from; without learnable labels every score is 0; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, documents, least_hashed, map_texts

TOXIC_ROWS, CLEAN_ROWS = 3_000, 6_000
"""Labelled documents that the weights are learned from, at most."""
LEAST_SEEN, SURE = 4, 4.0
"""A feature must occur in so many toxic documents of the sample, and so many standard deviations above chance."""
STEM = 4
"""Letters of a word that count as its stem."""
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def stem(word: str) -> str:
    return word[:STEM] + "-"


class Model:
    """Weights of words and stems, and the bias of a sentence that holds one of them; other sentences do not offend."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.bias = bias
        self.words = {f: w for f, w in weights.items() if not f.endswith("-")}
        self.stems = {f[:-1]: w for f, w in weights.items() if f.endswith("-")}

    def known(self, words: set[str]) -> bool:
        return not self.words.keys().isdisjoint(words) or not self.stems.keys().isdisjoint({w[:STEM] for w in words})

    def value(self, sentence: str) -> float | None:
        """The logit of a sentence (lower case); None if it holds nothing known."""
        words = set(WORD.findall(sentence))
        found = [self.words[w] for w in words if w in self.words] + [self.stems[s] for s in {w[:STEM] for w in words} if s in self.stems]
        return self.bias + sum(found) if found else None

    def sentences(self, text: str | None) -> Iterable[tuple[int, int, float]]:
        """(begin, end, probability) of every sentence that holds something known, in characters of the text."""
        for m in SENTENCE.finditer(text or ""):
            value = self.value(m.group().lower())
            if value is not None:
                yield m.start(), m.end(), float(1 / (1 + np.exp(-value)))

    def score(self, text: str | None) -> float:
        """Noisy-or over the sentences of a whole text."""
        low = text.lower() if text else ""
        if not self.known(set(WORD.findall(low))):
            return 0.0
        values = [v for s in SENTENCE.findall(low) if (v := self.value(s)) is not None]
        return float(-np.expm1(-np.logaddexp(0, np.array(values)).sum()))  # log(1 - p) of every sentence, summed


def sentence_features(text: str) -> list[set[str]]:
    found = [set(WORD.findall(s)) for s in SENTENCE.findall(text.lower())]
    return [words | {stem(w) for w in words} for words in found if words]


def telling(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Features that stand in toxic documents more often than chance explains, by ``SURE`` standard deviations."""
    seen, bad = Counter(), Counter()
    for text, t in zip(texts, toxic):
        mine = set().union(*sentence_features(text))
        seen.update(mine)
        if t:
            bad.update(mine)
    share = toxic.mean()
    return sorted(f for f, k in bad.items() if k >= LEAST_SEEN and k - seen[f] * share > SURE * np.sqrt(seen[f] * share * (1 - share)))


def fit(texts: list[str], toxic: np.ndarray, steps: int = 200, rate: float = 0.1, shrink: float = 1e-3) -> Model:
    """Adam steps on the noisy-or's log loss, all rows at once; weights stay at 0 or above, and each label weighs half."""
    if not len(toxic) or toxic.min() == toxic.max():
        return Model({}, -np.inf)
    names = telling(texts, toxic)
    number = {f: i for i, f in enumerate(names)}
    f, s, owner = [], [], []
    for d, text in enumerate(texts):
        for words in sentence_features(text):
            ids = [number[w] for w in words if w in number]
            if ids:
                f += ids
                s += [len(owner)] * len(ids)
                owner.append(d)
    if not owner:
        return Model({}, -np.inf)
    f, s, owner, y = np.array(f), np.array(s), np.array(owner), toxic.astype(float)
    n, m = len(y), len(owner)
    weigh = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    x = np.append(np.full(len(names), 2.0), -3.0)  # the bias comes last
    m1, m2 = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, steps + 1):
        z = x[-1] + np.bincount(s, x[f], m)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(owner, np.logaddexp(0, z), n))  # probability that no sentence offends
        back = weigh * np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        dz = back[owner] * p
        g = np.append(np.bincount(f, dz[s], len(names)), dz.sum()) + shrink * np.append(x[:-1], 0) / len(x)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        x = x - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        x[:-1] = np.maximum(x[:-1], 0)
        x[-1] = min(x[-1], -2.0)  # a sentence needs evidence
    return Model({k: float(v) for k, v in zip(names, x) if v > 0.01}, float(x[-1]))


def chosen(labels: DataFrame, label: str, key: str, folds: int) -> list[tuple]:
    """(id, label) of the labelled rows to learn from: outside the held-out fold, per label those with the smallest hash of the id."""
    rows = labels.where(F.col(key).isNotNull() & (crc_mod(F.col(key), folds) != 0)).select(
        F.col(key).alias("_id"), F.col(label).alias("_label"), F.xxhash64(F.lit(3), key).alias("_hash")).distinct()
    part = lambda value, bound: least_hashed(rows.where(F.col("_label") == value), "_hash", ["_id"], bound).collect()
    return [(r["_id"], r["_label"]) for r in part(1, TOXIC_ROWS) + part(0, CLEAN_ROWS)]


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", folds: int = 5) -> DataFrame:
    """(text, label) of the documents to learn from; texts are picked by a list of bounded size, so none of the others moves."""
    ids = docs.sparkSession.createDataFrame(chosen(labels, label, key, folds), f"_id {docs.schema[key].dataType.simpleString()}, _label int")
    return docs.where(F.col(text).isNotNull()).join(F.broadcast(ids), docs[key] == F.col("_id")).select(F.col(text).alias("text"), "_label")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", folds: int = 5) -> Model:
    """A model from the chosen labelled documents."""
    got = sorted((r["_label"], r["text"]) for r in labelled(docs, labels, label, text, key, folds).collect())
    return fit([t for _, t in got], np.array([y for y, _ in got]))


def score_texts(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    def make():
        return lambda texts: [[model.score(t) for t in texts]]

    return map_texts(docs.select(key, text), text, make, "score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def offending_sentences(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The sentences that score ``least`` or more: (key, begin, end, probability, sentence), places in characters."""
    def make():
        def work(texts):
            return [[[{"begin": b, "end": e, "probability": p, "sentence": t[b:e]} for b, e, p in model.sentences(t) if p >= least] for t in texts]]

        return work

    found = map_texts(docs.select(key, text), text, make, "found array<struct<begin:int,end:int,probability:double,sentence:string>>")
    return found.select(key, F.inline("found"))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy on held-out labels and the noisy-or itself are tested."""
    docs = documents(spark, sf)
    model = learn(docs, documents(spark, sf, "labels"))
    scored = score_texts(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
