"""String and set similarity."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts; call it on distinct pairs."""
    match = difflib.SequenceMatcher(None)
    out, last = [], None
    for x, y in zip(a, b):
        if y != last:
            match.set_seq2(y)
            last = y
        match.set_seq1(x)
        out.append(match.ratio())
    return pd.Series(out, dtype="float64")


# Pairs whose common subsequences are found at once.
PAIRS = 2048


def _numbered(texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """Distinct texts, and the place of every text among them."""
    at = {}
    places = np.array([at.setdefault(t, len(at)) for t in texts], dtype=np.int64)
    return list(at), places


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code point, text and place in it of every letter."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return points, np.repeat(np.arange(len(texts)), sizes), np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def common_lengths(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Length of the longest common subsequence of every pair ``left[i]``, ``right[i]``.

    A bit per letter of the left text, 64 to a word; all pairs go through the
    letters of their right texts together.
    """
    if len(left) > PAIRS:
        return np.concatenate([common_lengths(left[i:i + PAIRS], right[i:i + PAIRS]) for i in range(0, len(left), PAIRS)])
    (lefts, l), (rights, r) = _numbered(left), _numbered(right)
    (points, text, place), (others, other, spot) = _letters(lefts), _letters(rights)
    known = np.array(sorted(map(ord, set("".join(lefts)))), dtype=np.int64)
    # what the left texts lack, and the end of a text, is letter 0, whose mask is empty
    number = np.zeros(max(points.max(initial=0), others.max(initial=0)) + 1, dtype=np.int64)
    number[known] = np.arange(1, len(known) + 1)
    words = max(1, -(-max(map(len, lefts), default=0) // 64))
    masks = np.zeros((len(lefts), len(known) + 1, words), dtype=np.uint64)
    np.bitwise_or.at(masks, (text, number[points], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    told = np.zeros((max(map(len, rights), default=0), len(rights)), dtype=np.int64)
    told[spot, other] = number[others]
    flat, base = masks.reshape(-1), l * (len(known) + 1) * words
    open_ = [np.full(len(left), ~np.uint64(0)) for _ in range(words)]
    for row in told:
        at, carry = base + row[r] * words, None
        for w in range(words):
            met = open_[w] & flat[at + w]
            total = open_[w] + met
            over = total < met
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            open_[w] = total | (open_[w] ^ met)
    return sum((np.bitwise_count(~o).astype(np.int64) for o in open_), np.zeros(len(left), dtype=np.int64))


def may_reach(left: Sequence[str], right: Sequence[str], least: float) -> np.ndarray:
    """Whether the ratio of each pair can be ``least`` or more: its matching blocks are a common subsequence."""
    total = np.array([len(a) + len(b) for a, b in zip(left, right)], dtype=np.int64)
    return 2.0 * common_lengths(left, right) >= least * total - 1e-6


def ratio_from(least: float) -> Callable[[Column, Column], Column]:
    """The same as ``sequence_ratio`` where it is ``least`` or more, and 0 where it surely is not."""
    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.tolist(), b.tolist()
        out, match, last = np.zeros(len(x)), difflib.SequenceMatcher(None), None
        for i in np.flatnonzero(may_reach(x, y, least)).tolist():
            if y[i] != last:
                match.set_seq2(y[i])
                last = y[i]
            match.set_seq1(x[i])
            out[i] = match.ratio()
        return pd.Series(out, dtype="float64")

    return ratio


def ratio_ceiling(len_a: Column, len_b: Column) -> Column:
    """Largest ratio two texts of these lengths can reach."""
    total = len_a + len_b
    return F.when(total > 0, 2.0 * F.least(len_a, len_b) / total).otherwise(1.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two distinct arrays; 0 when one is empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / union).otherwise(0.0)
