"""Folding of every code point, character references and relative links."""

import sys
import unicodedata
from html import unescape
from urllib.parse import urljoin

from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import pages as P


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_fold_of_all_code_points(spark):
    points = [cp for cp in range(1, sys.maxunicode + 1) if not 0xD800 <= cp <= 0xDFFF and unicodedata.category(chr(cp)) != "Cn"]
    runs = ["".join(map(chr, points[i:i + 50])) for i in range(0, len(points), 50)]
    # private planes fold to themselves; a part of them is enough
    runs = [r for r in runs if ord(r[0]) < 0xF0000 or ord(r[0]) % 5000 < 50]
    df = spark.createDataFrame([(r,) for r in runs], "s string")
    wrong = [(r.s, r.f) for r in df.select("s", T.fold(F.col("s")).alias("f")).collect() if r.f != plain(r.s)]
    assert not wrong, wrong[:3]


def test_character_references(spark):
    cases = ["Promo&ccedil;&atilde;o &#8211; caf&eacute;", "&amp;lt; &lt; &#38;amp; &#x26;", "&euro;5 &#128;5 &hearts;&NotAName;", "&copy 2020 &am &", "&#x1F600;&#65;&#0065", "a &amp;amp; b", None]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = {r.s: r.d for r in df.select("s", P.decode_entities(F.col("s")).alias("d")).collect()}
    assert got == {c: c and unescape(c) for c in cases}
    title = spark.createDataFrame([("<title>Promo&ccedil;&atilde;o &#8211; caf&eacute;</title>",)], "h string").select(P.page_title(F.col("h"))).first()[0]
    assert title == "Promoção – café"


def test_dot_segments(spark):
    base = "https://a.example/1/2/3/4/5/6/7/page?x=1"
    hrefs = ["../../../../../../x", "../../../../../../../../x", "./y/./z", "..", "a/../b/../c?q=../r", "../", "/k", "//b.example/z", "?p=2"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    got = {r.h: r.u for r in df.select("h", P.absolute_url(F.col("b"), F.col("h")).alias("u")).collect()}
    assert got == {h: urljoin(base, h) for h in hrefs}
