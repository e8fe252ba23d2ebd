"""Quality rules as a learned decision list.

Statistics of every whole text feed conjunctions of thresholds. Sequential
covering learns them from labels: a rule grows by the condition with the best
information gain on one part of the labelled rows, is pruned on another part,
and the rows it covers are set aside before the next rule grows. The list comes
out as one Spark conditional expression, whose first matching rule decides;
texts that no rule rejects are kept.

Learning reads at most ``LABELLED`` labelled rows, those with the smallest hash
of their id; statistics and verdicts cover every row and whole texts.

Defined cases: null and empty texts have no words, all counts 0, and fail the
base rules; repeated rows are judged each; labels that are null or belong to no
document are not learned from; without labels the list is empty and the base
rules alone decide; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, documents, least_hashed, map_texts

LABELLED = 20_000
"""Labelled rows that a list is learned from, at most."""
SPACE = b" \t\n\r\x0b\f"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
MARKS = b"!?.,;:"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_marks long, n_distinct long"


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more; ``ids`` number equal words equally from 0."""
    n = len(ids)
    if n < 4:
        return 0
    width = int(ids.max()) + 1
    if width < 2_000_000:
        code = (ids[:-2] * width + ids[1:-1]) * width + ids[2:]
    else:
        pair = np.unique(ids[:-2] * width + ids[1:-1], return_inverse=True)[1]
        code = pair * width + ids[2:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    equal = ranked[1:] == ranked[:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift:n - 2 + shift] |= again
    return int(inside.sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The values of FIELDS for one whole text."""
    if not text:
        return (0,) * 9
    raw = text.encode()
    words = raw.split()
    size = lambda chars: len(raw) - len(raw.translate(None, chars))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = Counter(line for line in raw.split(b"\n") if line.strip(SPACE))
    return (len(words), len(text) - size(SPACE), size(SYMBOLS), sum(lines.values()) - len(lines), repeat_words(ids),
            size(UPPER), size(LETTERS), size(MARKS), len(number))


def quality_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    def make():
        return lambda texts: list(map(list, zip(*map(text_statistics, texts)))) if texts else [[]] * 9

    return map_texts(docs.select(key, text), text, make, FIELDS)


#: What rules may look at, each a share so that it means the same at any length.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"), "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "n_letters"),
    "mark_share": ("n_marks", "word_chars"), "word_length": ("word_chars", "n_words"), "distinct_share": ("n_distinct", "n_words"),
}


def feature(name: str) -> Column:
    part, whole = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def base_failed(least_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x >= self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = feature(self.feature)
        return x >= self.threshold if self.above else x <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(values)
    return out


def grow(values: dict[str, np.ndarray], bad: np.ndarray, cuts: int, depth: int) -> Rule:
    """Add the condition of highest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < depth and bad[inside].any() and not bad[inside].all():
        now = np.log2(bad[inside].mean())
        best, gain = None, 1e-9
        for name, x in values.items():
            own = x[inside]
            for t in np.unique(np.quantile(np.concatenate((own, own[bad[inside]])), np.linspace(0, 1, cuts), method="nearest")):
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    hit = inside & c.holds(values)
                    p = int((bad & hit).sum())
                    if p and (g := p * (np.log2(p / hit.sum()) - now)) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return tuple(rule)


def prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The leading part of a rule that is worth most on rows it did not grow on."""
    def worth(r: Rule) -> float:
        hit = covers(r, values, len(bad))
        return ((bad & hit).sum() - (~bad & hit).sum()) / hit.sum() if hit.any() else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r), len(r)), default=())


def learn_rules(values: dict[str, np.ndarray], bad: np.ndarray, rules: int = 12, precision: float = 0.98, cuts: int = 33, depth: int = 4, least: int = 5) -> list[Rule]:
    """Ordered rules that mark bad rows; a rule is kept if it is right on at least ``precision`` of the rows it covers while pruning."""
    n = len(bad)
    turn = np.arange(n) % 3 == 2  # a third prunes; rows come in hash order
    growing, pruning = ~turn, turn
    found: list[Rule] = []
    take = lambda rows: ({k: v[rows] for k, v in values.items()}, bad[rows])
    while len(found) < rules:
        g, gb = take(growing)
        v, vb = take(pruning)
        if gb.sum() < least or vb.sum() < 1:
            break
        rule = prune(grow(g, gb, cuts, depth), v, vb)
        hit = covers(rule, v, len(vb))
        if not rule or not hit.any() or vb[hit].mean() < precision:
            break
        found.append(rule)
        left = ~covers(rule, values, n)
        growing, pruning = growing & left, pruning & left
    return found


def learn_list(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", bad: int = 0, bound: int = LABELLED) -> list[Rule]:
    """A decision list from at most ``bound`` labelled rows of ``stats`` that pass the base rules."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_id"), F.col(label).alias("_label"))
    rows = stats.where(~base_failed()).join(marked, stats[key] == F.col("_id")).select(
        F.xxhash64(F.lit(5), "_id").alias("_h"), "_id", (F.col("_label") == bad).alias("_bad"), *[feature(f).alias(f) for f in FEATURES])
    got = least_hashed(rows, "_h", ["_id", *FEATURES], bound).toPandas()
    return learn_rules({f: got[f].to_numpy(float) for f in FEATURES}, got["_bad"].to_numpy(bool)) if len(got) else []


def rejected_by(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row, as one conditional expression; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Statistics and verdict of every row: base_failed, the rejecting rule's number, kept."""
    stats = cut(quality_statistics(docs, text, key))
    rules = learn_list(stats, labels, key)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rejected_by(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects, all columns kept; the list is learned from ``docs`` alone.

    The verdict is reached per row, so that rows without an id or with equal ids are judged by their own texts.
    """
    stats = cut(quality_statistics(docs, text, key))
    rules = learn_list(stats, labels, key)
    return judged_rows(docs, rules, text)


def judged_rows(docs: DataFrame, rules: list[Rule], text: str) -> DataFrame:
    """The rows that pass, judged in place."""
    names = FIELDS.replace(" long", "").split(", ")
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))

    def make():
        return lambda texts: list(map(list, zip(*map(text_statistics, texts)))) if texts else [[]] * len(names)

    stats = map_texts(inner, "_text", make, FIELDS)
    return stats.where(~base_failed() & rejected_by(rules).isNull()).select("_row.*")


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics are held against a plain reckoning, the list against held-back labels in tests."""
    return judge(documents(spark, sf), documents(spark, sf, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
