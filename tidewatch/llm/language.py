"""Language identification as inference of a mixture.

Learning counts the letter trigrams of every labelled text outside the held-out
fold, by language, in a table of ``BUCKETS`` hashed trigrams. A document is
taken as a mixture: expectation-maximisation finds the share of each language
that explains its trigrams best. The set of languages is the one with the best
penalised likelihood: the strongest languages are admitted one by one while the
log likelihood gains more than a penalty per language that grows with the log
of the text's length. The prediction is the largest share of that set.

Counts cover all learning rows and whole texts; what reaches the driver is one
row per language and bucket.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without a language are not learned from; when nothing was learned every
text is ``und``; ties go to the language first by code points; repeated rows
count and are predicted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, documents, map_texts, pieces

BUCKETS = 1 << 15
SMOOTHING = 0.1
PENALTY = 12.0
"""Log likelihood that a further language must bring per natural log of the number of trigrams."""
LONG_RUN = 1 << 18
"""Letters of a text that are hashed in one go; longer texts go run by run."""
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter; made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str) -> np.ndarray:
    """Counts per bucket of the trigrams around letters; every other character counts as one space."""
    counts = np.zeros(BUCKETS, np.int64)
    low = text.lower()
    for at in range(0, len(low), LONG_RUN):
        # a run sees one character of each neighbour, so cutting loses no trigram
        run = f" {low}" if at == 0 else low[at - 1:]
        run = run[:LONG_RUN + 2] if at + LONG_RUN < len(low) else run + " "
        code = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        is_letter = letters()[code]
        code = np.where(is_letter, code, 32)
        mixed = (code[:-2] * 0x9E3779B97F4A7C15 + code[1:-1] * 0xC2B2AE3D27D4EB4F + code[2:] * 0x165667B19E3779F9) >> np.uint64(40)
        counts += np.bincount((mixed[is_letter[1:-1]] % BUCKETS).astype(np.int64), minlength=BUCKETS)
    return counts


def count_trigrams(rows: DataFrame, text: str, label: str) -> DataFrame:
    """(label, bucket, n) over all rows; every task sends one row per language and bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, text):
                for t, lang in zip(part.column(text).to_pylist(), part.column(label).to_pylist()):
                    counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    counts += trigrams(t)
        for lang, counts in held.items():
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit), pa.array(counts[hit])], ["label", "bucket", "n"])

    known = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, label)
    return known.mapInArrow(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Log probabilities of the buckets per language, and the inference."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + SMOOTHING
        self.probability = (smooth / smooth.sum(1, keepdims=True)).T.copy() if len(languages) else np.zeros((BUCKETS, 0))
        self.log = np.log(self.probability)

    def shares(self, p: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float]:
        """Expectation-maximisation from ``start``: shares of the columns of ``p`` and the log likelihood."""
        theta, total = start, n.sum()
        for _ in range(rounds):
            joint = p * theta
            new = (n / joint.sum(1)) @ joint / total
            still = np.abs(new - theta).max() < 1e-3
            theta = new
            if still:
                break
        return theta, float(n @ np.log(p @ theta))

    def infer(self, text: str | None) -> tuple[list[tuple[str, float]], int]:
        """The languages of a text with their shares, largest first, and the number of trigrams."""
        counts = trigrams(text) if text else None
        total = int(counts.sum()) if counts is not None else 0
        if not total or not self.languages:
            return [], total
        at = np.flatnonzero(counts)
        n, p = counts[at].astype(float), self.probability[at]
        theta, _ = self.shares(p, n, np.full(len(self.languages), 1 / len(self.languages)))
        order = np.lexsort((np.arange(len(theta)), -theta))
        alone = n @ self.log[at]
        first = int(np.lexsort((np.arange(len(alone)), -alone))[0])
        chosen, best, found = [first], float(alone[first]), np.ones(1)
        for k in order:
            if k == first:
                continue
            if theta[k] < 0.01:
                break
            trial = [*chosen, int(k)]
            shares, value = self.shares(p[:, trial], n, np.maximum(theta[trial], 0.01) / np.maximum(theta[trial], 0.01).sum())
            if value - best <= PENALTY * np.log(total + 1):
                break
            chosen, best, found = trial, value, shares
        ranked = sorted(zip([self.languages[c] for c in chosen], found.tolist()), key=lambda x: (-x[1], x[0]))
        return ranked, total


def learn(docs: DataFrame, text: str = "text", label: str = "lang") -> Mixture:
    got = count_trigrams(docs, text, label).toPandas()
    languages = sorted(got["label"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[got["label"].map({v: i for i, v in enumerate(languages)}).to_numpy(int), got["bucket"].to_numpy(int)] = got["n"].to_numpy()
    return Mixture(languages, counts)


def identify(docs: DataFrame, model: Mixture, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, languages): the largest share, and all languages of the set with their shares."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages times buckets, whatever the corpus

    def make():
        mixture = sent.value

        def work(texts):
            found = [mixture.infer(t)[0] for t in texts]
            return [[f[0][0] if f else "und" for f in found], [min(1.0, f[0][1]) if f else 0.0 for f in found],
                    [[{"lang": n, "share": s} for n, s in f] for f in found]]

        return work

    return map_texts(docs.select(key, text), text, make, "lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy on held-out labels, and mixtures against texts of known parts, are tested."""
    docs = documents(spark, sf)
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = learn(docs.where(~held_out))
    return identify(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1).select("doc_id", "held_out", "lang_pred", "score")
