"""Toxicity, language and HTML extraction: held-out accuracy, mixtures of known parts, golden pages."""

import zlib

import numpy as np
import pytest

from tidewatch.llm import html_text, language, toxicity
from .cases import edge_docs, empty_docs, prose

SMALL = "/root/testdata/sf0.01"


def toxic_docs(n=160):
    rows = []
    for i in range(n):
        lines = [prose(1000 * i + k, 12) for k in range(5)]
        if i % 4 == 0:
            lines[i % 5] += " " + ["vile", "scum"][i // 4 % 2]
        rows.append((i, ".\n".join(lines), int(i % 4 == 0)))
    return rows


def test_noisy_or_finds_the_sentence(spark):
    rows = toxic_docs()
    model = toxicity.fit([t for _, t, _ in rows[:120]], np.array([y for *_, y in rows[:120]]))
    scores = {i: model.score(t) for i, t, _ in rows}
    assert all((scores[i] >= 0.5) == bool(y) for i, _, y in rows)
    # the document's score is the noisy-or of its sentences' scores
    for i, t, _ in rows[:8]:
        assert scores[i] == pytest.approx(1 - np.prod([1 - p for *_, p in model.sentences(t)]))
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], "doc_id long, text string, score double")
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i, _, y in rows if y}
    text = {i: t for i, t, _ in rows}
    assert all(r.sentence == text[r.doc_id][r.begin:r.end] and ("vile" in r.sentence or "scum" in r.sentence) for r in found)


def test_toxicity_edges(spark):
    model = toxicity.fit(["bad word"] * 10 + ["good word"] * 10, np.array([1] * 10 + [0] * 10))
    got = {r.doc_id: r for r in toxicity.score_texts(edge_docs(spark), model).collect()}
    assert got[1].score == got[2].score == got[3].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score_texts(empty_docs(spark), model).count() == 0
    assert toxicity.fit(["x"], np.array([1])).score("x y z") == 0.0
    # rows of the held-out fold, null labels and labels without a document teach nothing
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (999, 1), (6, None)], "doc_id long, toxic int")
    docs = spark.range(40).selectExpr("id as doc_id", "cast(id as string) as text", "0 as toxic")
    used = {int(r.text) for r in toxicity.labelled(docs, labels).collect()}
    assert used == {i for i in range(40) if zlib.crc32(str(i).encode()) % 5}


def test_language_held_out(spark):
    got = language.op9_language(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    own = got[got.held_out]
    assert (own.lang == own.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_mixtures_of_known_parts(spark):
    a, b = "wolf river stone cloud ".split(), "zebra quxo fyjam "[:].split()
    docs = spark.createDataFrame([(i, " ".join(w[(i + k) % len(w)] for k in range(50)), n, 0.0) for i in range(9) for w, n in ((a, "aa"), (b, "bb"))]
                                 + [(90, None, "aa", 0.0), (91, "12 ?", "cc", 0.0), (92, "wolf", None, 0.0)], "doc_id long, text string, lang string, score double")
    model = language.learn(docs)
    assert model.languages == ["aa", "bb", "cc"] or model.languages == ["aa", "bb"]
    both = " ".join(a * 60 + b * 20)
    found, _ = model.infer(both)
    share = dict(found)
    n = {"aa": sum(map(len, a)) * 60, "bb": sum(map(len, b)) * 20}
    assert set(share) == {"aa", "bb"} and share["aa"] == pytest.approx(n["aa"] / sum(n.values()), abs=0.05)
    assert [x for x, _ in model.infer(" ".join(a * 60))[0]] == ["aa"]
    got = {r.doc_id: r for r in language.identify(edge_docs(spark), model).collect()}
    for i in (1, 2, 3, 13):
        assert got[i].lang_pred == "und" and got[i].score == 0.0
    assert language.identify(empty_docs(spark), model).count() == 0
    assert language.learn(docs.where("false")).infer("wolf")[0] == []


def test_long_texts_count_as_whole(monkeypatch):
    text = prose(5, 400)
    whole = language.trigrams(text)
    monkeypatch.setattr(language, "LONG_RUN", 100)
    assert (language.trigrams(text) == whole).all()


PARTS = "<nav><a href=/a>Home</a><a href=/b>News</a></nav><div class='ad banner'>Buy now, buy cheap, buy today!</div>"
STORY = "<h1>A title of the story</h1><p>First paragraph, long enough to count as text.</p><p>Second one &amp; its <b>bold</b> end.</p>"
CLEAN = "A title of the story First paragraph, long enough to count as text. Second one & its bold end."


@pytest.mark.parametrize("page, want", [
    (f"<html><head><title>T</title><script>var t='</p>';</script></head><body>{PARTS}<article>{STORY}</article><footer>&copy; me</footer></body></html>", CLEAN),
    (f"<body>{PARTS}<div id=main-text>{STORY}</div><div id=comments><p>Great story, thanks a lot for it!</p></div></body>", CLEAN),
    (f"<body><header><h2>Site name and motto</h2></header><main>{STORY}</main><aside>More of this</aside><form>Search <input></form></body>", CLEAN),
    (f"<body><article>{STORY.replace('</p>', '')}<section class=comments><p>me too</section></article>", CLEAN),
    ("<p class=ad>Cheap offers<p>Real text &#8211; with\n\n white&nbsp;space.", "Real text – with white space."),
    ("<table><tr><td>a1<td>b1<tr><td>c1</table>", "a1 b1 c1"),
    ("<div style='display:none'>hidden</div><div>shown <a href='x>y'>here</a></div>", "shown here"),
    ("one<br>two<!-- no --> <![CDATA[x]]>three", "one two three"),
    ("just text &am", "just text &am"), ("", ""), (None, ""), ("<p>", ""), ("<", "<"), ("</div></p>x", "x"), ("<a href=\"open>x", "x"),
])
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_extract(spark):
    rows = [(1, "u", f"<article>{STORY}</article>", "t", 1), (1, "u", f"<article>{STORY}</article>", "t", 1), (2, None, None, None, 2), (None, "v", "", "x", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [(0, "v", "", 0), (1, "u", CLEAN, len(CLEAN)), (1, "u", CLEAN, len(CLEAN)), (2, "", "", 0)]
    assert html_text.extract(pages.where("false")).count() == 0


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "core text" + "</div>" * 3000
    assert html_text.main_text(deep) == "core text"
    long = "<article>" + "".join(f"<p>paragraph number {i} of the page.</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(long).count("paragraph") == 20_000


TALE = "<h1>Title of it</h1>" + "".join(f"<p>Sentence number {i} of the story goes on with words, and some more.</p>" for i in range(5))
TALE_TEXT = "Title of it " + " ".join(f"Sentence number {i} of the story goes on with words, and some more." for i in range(5))


@pytest.mark.parametrize("page", [
    "<body><div class='content has-sidebar'>{}</div></body>", "<body><div class='layout related-right'>{}<div class=related><a href=x>other news</a></div></div></body>",
    "<body><form id=aspnetForm><nav><a href=x>menu</a></nav>{}</form></body>", "<body><div class=ad>buy this now<article>{}</article></body>",
    "<body><nav><a href=1>a</a></nav><div class=ad><div class=text>{}</div></body>", "<body><div class='article promo'>{}</div><div class=footer>small</div></body>",
    "<body><article>{}</article><section class=comments>" + "<p>A reader says a lot about this, at great length, and then more of it.</p>" * 9 + "</section></body>"])
def test_odd_wrappers_keep_the_article(page):
    assert html_text.main_text("<html>" + page.format(TALE)) == TALE_TEXT


def test_density_decides(monkeypatch):
    """Nothing on the page names its parts; without densities the text is another."""
    links = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(20))
    page = f"<body><div><ul>{links}</ul></div><div><div>{TALE}</div></div><div><ul>{links}</ul></div></body>"
    assert html_text.main_text(page) == TALE_TEXT
    whole = html_text.measure

    def flat(root):
        nodes = whole(root)
        for n in nodes:
            n.density = n.total = 0.0
        return nodes

    monkeypatch.setattr(html_text, "measure", flat)
    assert html_text.main_text(page) != TALE_TEXT


def test_given_pages_against_their_own_layout():
    """The tables' pages hold one article element; a plain reading of it gives the same texts."""
    import html as entities
    import re

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        inner = re.search(r"(?s)<article>(.*)</article>", page)[1]
        parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)
        plain = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert html_text.main_text(page) == " ".join(x for x in plain if x)


def test_hostile_markup_takes_linear_time():
    import time

    for page in ("<b>" * 300_000, "<i>" * 20_000 + "</b>" * 200_000, "<a " * 300_000, "<div>" * 150_000 + "x", "<ul><li>" * 60_000 + "</b>" * 60_000, "</script" * 99_000, '<a "' * 250_000):
        start = time.time()
        html_text.main_text(page)
        assert time.time() - start < 10
