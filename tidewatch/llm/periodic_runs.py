"""Runs of words that repeat with a period, found from seeds and extended along diagonals.

A run of smallest period q agrees with itself at distance q over its length
less q. For the periods of a class (lo, lo + 1, .., 2 lo - 1) this overlap has a
guaranteed minimum k, and k is larger than the class's periods. All word k-grams
of a text are indexed, exactly, from ranks of grams of half the length and more.
Two neighbouring occurrences of a k-gram in one text whose distance is in
the class are a seed: inside a run of period q a gram that long comes back
after exactly q words, so every run holds a seed of its own period. A seed is
extended both ways along its diagonal; per distance, a table keeps the furthest
covered word, and seeds before it are passed over. Grams that occur once
cannot be part of longer repeated ones and leave the index, so a text without
repeats ends after a few steps.

Defined cases: a null or empty text has no words and no runs; a row without an
id is taken as it is, without a repeated tail; repeated rows are judged each;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, map_rows, words_of


def _repeated(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurs more than once and the ranks of their keys, by key and position."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    many = np.bincount(group, minlength=1)[group] > 1 if len(keys) else new
    return at[order][many], group[many]


class Grams:
    """Ranks of the repeated word grams of several texts laid end to end; grams never cross two texts."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray) -> None:
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.n, self.end, self.span = len(ids), starts[1:][owner], 1
        self._keep(*_repeated(owner * (int(ids.max(initial=0)) + 1) + ids, np.arange(self.n)))

    def _keep(self, at: np.ndarray, ranks: np.ndarray) -> None:
        self.rank = np.full(self.n, -1, np.int64)
        self.rank[at] = ranks
        self.at = np.sort(at)

    def joined(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """The repeated grams of ``span + shift`` words (shift up to span), by gram and position."""
        at = self.at[self.at + shift + self.span <= self.end[self.at]]
        at = at[self.rank[at + shift] >= 0]
        return _repeated(self.rank[at] * (self.n + 1) + self.rank[at + shift], at)

    def double(self) -> None:
        self._keep(*self.joined(self.span))
        self.span *= 2


def _agree(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """First position from ``at`` on, ``stop`` at most, that differs from the one ``lag`` further."""
    size = 32
    while at < stop:
        end = min(at + size, stop)
        unlike = ids[at:end] != ids[at + lag:end + lag]
        if unlike.any():
            return at + int(unlike.argmax())
        at, size = end, size * 2
    return stop


def _agree_back(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """First position of the agreeing stretch that ends before ``at``; ``stop`` at least."""
    size = 32
    while at > stop:
        begin = max(at - size, stop)
        unlike = ids[begin:at] != ids[begin + lag:at + lag]
        if unlike.any():
            return at - int(unlike[::-1].argmax())
        at, size = begin, size * 2
    return stop


def find_runs(ids: np.ndarray, starts: np.ndarray, shortest: int = 6, repeats: int = 4) -> np.ndarray:
    """All runs of length ``max(shortest, repeats * period)`` or more as rows (start, length, period), by start and period.

    ``ids`` numbers the words of texts laid end to end, text i from ``starts[i]``
    to ``starts[i + 1]``. Below three repeats a gram of the guaranteed overlap could come back within a period.
    """
    if repeats < 3:
        raise ValueError("repeats must be three or more")
    grams, found, low = Grams(ids, starts), [], 1
    longest = int(np.diff(starts).max(initial=0))
    while repeats * low <= longest:
        # the least overlap of any run of this class or a later one, so that grams only grow
        k = min(max(shortest - q, (repeats - 1) * q) for q in range(low, max(low, shortest) + 1))
        while 2 * grams.span <= k and len(grams.at):
            grams.double()
        if not len(grams.at):
            break
        at, rank = grams.joined(k - grams.span)
        lag = np.diff(at)
        seed = np.flatnonzero((rank[1:] == rank[:-1]) & (lag >= low) & (lag < 2 * low))
        order = np.lexsort((at[seed], lag[seed]))
        lags, places = lag[seed][order], at[seed][order].tolist()
        edges = np.flatnonzero(np.diff(lags, prepend=-1)).tolist() + [len(places)]
        for i, last in zip(edges, edges[1:]):
            period, covered = int(lags[i]), 0  # how far this distance's diagonals are covered
            while i < last:
                place = places[i]
                end = int(grams.end[place])
                begin = int(starts[np.searchsorted(starts, place, "right") - 1])
                right = _agree(ids, place + k, period, end - period)
                left = _agree_back(ids, place, period, max(begin, covered))
                if right - left + period >= max(shortest, repeats * period):
                    found.append((left, right - left + period, period))
                covered = right
                i = bisect_left(places, covered, i + 1, last)
        low *= 2
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def repeat_tail(words: list[bytes], h: int | None) -> list[bytes]:
    """The words, for every tenth hash with a tail that repeats its first words."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", tail_hash: str | None = None, shortest: int = 6,
                  repeats: int = 4) -> DataFrame:
    """(key, runs, collapsed): every run of each text, and the words without the repeats of any run, joined by one space.

    Of a run the first period stays. ``tail_hash`` names a column of hashes by
    which some texts get a repeated tail first.
    """
    given = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"),
                        (F.col(tail_hash) if tail_hash else F.lit(None)).cast("long").alias("_hash"))

    def make():
        def work(texts, hashes):
            words = [repeat_tail(words_of(t), h) for t, h in zip(texts, hashes)]
            known: dict[bytes, int] = {}
            starts = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
            ids = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(starts[-1]))
            runs = find_runs(ids, starts, shortest, repeats)
            of = np.searchsorted(starts, runs[:, 0], "right") - 1
            listed, collapsed = [[] for _ in words], [b" ".join(w) for w in words]
            for i, (start, length, period) in zip(of.tolist(), runs.tolist()):
                listed[i].append({"start": start - int(starts[i]), "length": length, "period": period})
            for i in set(of.tolist()):
                gone = np.zeros(len(words[i]) + 1, np.int64)
                for r in listed[i]:
                    gone[r["start"] + r["period"]] += 1
                    gone[r["start"] + r["length"]] -= 1
                collapsed[i] = b" ".join([words[i][j] for j in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()])
            return [listed, [c.decode() for c in collapsed]]

        return work

    made = map_rows(given, "_text", ["_hash"], make, "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return made.withColumnRenamed("_key", key)


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Held against all periods at all places of small texts in tests."""
    docs = documents(spark, sf).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    made = periodic_runs(docs, tail_hash="h")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["s"]).alias("start"), best["length"].alias("length"),
        (-best["p"]).alias("period"), "collapsed",
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
    ).select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
             "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))
