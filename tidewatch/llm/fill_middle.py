"""Fill-in-the-middle: texts cut in three parts, whose middle moves to the end.

A text is cut between units (letter runs and single other characters, or code
points). Cuts are needed both as bytes, to copy spans, and as code points, to
report them. An index of exceptions does the conversion: it holds only the
multibyte characters, with their positions and the bytes in excess of one that
they and those before them take. A binary search in it turns a position of one
kind into the other; in ASCII text the index is empty and both are equal.

Defined cases: a null text counts as empty and stays plain; a text with a
sentinel stays plain, so that every output can be taken apart again; a row
without an id takes the hash of the empty id; repeated rows of one id are cut
alike if their texts are equal; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, map_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


class Exceptions:
    """The multibyte characters of a UTF-8 text: byte and code-point positions, and excess bytes up to each."""

    def __init__(self, raw: bytes) -> None:
        codes = np.frombuffer(raw, np.uint8)
        self.at_byte = np.flatnonzero(codes >= 0xC0)
        first = codes[self.at_byte]
        self.excess = np.concatenate(([0], np.cumsum(1 + (first >= 0xE0) + (first >= 0xF0))))
        self.at_char = self.at_byte - self.excess[:-1]

    def byte(self, char):
        """Byte position of a code-point position (the text's length included)."""
        return char + self.excess[np.searchsorted(self.at_char, char)]

    def char(self, byte):
        """Code-point position of the byte position at which a character begins."""
        return byte - self.excess[np.searchsorted(self.at_byte, byte)]


def unit_starts(raw: bytes) -> np.ndarray:
    """Byte positions where a unit begins: a run of ASCII letters, or any other code point."""
    codes = np.frombuffer(raw, np.uint8)
    letter = LETTER[codes]
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    return np.flatnonzero(~inside & ((codes & 0xC0) != 0x80))


def cut_text(text: str, draws: tuple[int, int, int, int], plain_from: int, spm_below: int, unit: str) -> tuple:
    """(units, form, code points of prefix and middle, output) of one text."""
    raw = text.encode()
    index = Exceptions(raw)
    if unit == "char":
        n, starts = int(index.char(len(raw))), None
    else:
        starts = unit_starts(raw)
        n = len(starts)
    if not text or draws[2] % 100 >= plain_from or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    if starts is None:
        chars, (a, b) = (low, high), index.byte(np.array([low, high]))
    else:
        a, b = (int(starts[k]) if k < n else len(raw) for k in (low, high))
        chars = index.char(np.array([a, b]))
    prefix, middle, suffix = raw[:a].decode(), raw[a:b].decode(), raw[b:].decode()
    spm = draws[3] % 100 < spm_below
    parts = (SUFFIX, suffix, PREFIX, prefix) if spm else (PREFIX, prefix, SUFFIX, suffix)
    return n, "spm" if spm else "psm", int(chars[0]), int(chars[1] - chars[0]), "".join((*parts, MIDDLE, middle))


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers, the first groups of the hex SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, plain_from: int = 90, spm_below: int = 20,
                   unit: str = "token") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): every text with its middle moved to the end.

    Of 100 draws those from ``plain_from`` on leave the text plain; of the rest
    those below ``spm_below`` put the suffix first. ``unit`` is token or char.
    """
    if unit not in ("token", "char"):
        raise ValueError("unit must be token or char")
    names = ["_h1", "_h2", "_h3", "_h4"]
    drawn = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"), *[c.alias(n) for c, n in zip(draws(F.col(key), seed), names)])

    def make():
        def work(texts, *hashed):
            made = [cut_text(t, h, plain_from, spm_below, unit) for t, h in zip(texts, zip(*hashed))]
            return [list(c) for c in zip(*made)]

        return work

    fields = "n long, form string, prefix_chars long, middle_chars long, output string"
    return map_rows(drawn, "_text", names, make, fields).withColumnRenamed("_key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` cut. A sentinel begins with < and ends with >, so none arises where parts meet."""
    body = F.substring(output, 4, 2147483647)
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}"), F.split(body, f"{PREFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut between tokens, with digests of output and restored text."""
    made = fill_in_middle(documents(spark, sf))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
  FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS pre, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS mid,
    coalesce(array_to_string(u[hi + 1:], ''), '') AS suf
  FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
