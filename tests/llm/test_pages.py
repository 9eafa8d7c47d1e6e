import html
import re
import time

import numpy as np
import pytest

from freshet.llm import htmltext, langid
from tests.llm import brute


def test_pages_give_their_articles(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract(pages).collect()}
    for p in pages.collect():
        a = p.html[p.html.index("<article>") + 9 :].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", a))
        want = " ".join(x for x in blocks if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p>short", "short"),
        ("a < b <p", "a < b"),
        ("<script>x</script><!-- y --><p>a&nbsp;&amp;&eacute;</p>", "a &é"),
        ("<article><p>One</p><aside>x</aside><p>T<b>w</b>o</p><section class='comments'><p>nice</p></section></article>", "One Two"),
        ("<nav>" + "menu " * 50 + "</nav><main><p>Text</p></main><footer>f</footer>", "Text"),
        ("<div id=content><p>" + "word " * 30 + "</p></div><div class='sidebar'>" + "side " * 30 + "</div>", ("word " * 30).strip()),
        ("<article><p>one</p><div><form>f</form></div><div class='ad'><div>in</div>out</div><p>two</p></article>", "one two"),
        ("<script>never closed", ""),
        ("<style>p{}</style><article><h1>Title</h1><p>x</p>", "Title x"),
    ],
)
def test_main_text(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>one</p><svg width='9'/><p>two</p></article>", "one two"),
        ("<svg/><article><p>one</p></article><svg><title>t</title><text>x</text></svg><p>out", "one"),
        ("<article><p>one</p><svg><g><text>x</text></g></svg><p>two</p></article>", "one two"),
        ("<object data='a'><article><p>one</p></article>", "one"),
        ("<select><option></option><article><p>one</p><select><option>x</option></select><p>two</p></article>", "one two"),
        ("<article><p>one</p><iframe src='a'/><p>two</p><textarea>x</textarea><p>three</p><noscript><p>four</p></article>", "one two three four"),
        ("<article><textarea><p>one</p><textarea>x</textarea></article>", "one"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>x=2</annotation></math> holds</p></article>", "so x=2 holds"),
        ("<article><p>one</p><object><object>x</object>y</object><p>two</p></article>", "one two"),
        ("<article><p>one</p></article><style>p{}", "one"),
    ],
)
def test_elements_without_text_take_no_text_with_them(page, want):
    assert htmltext.main_text(page) == want


def test_left_out_lines_inside_unmarked_text_drop_nothing():
    ad, long = "<div class='ad'>buy</div>", "word " * 40
    page = f"<h1>A heading of some letters</h1>{ad * 2}<p>{long}</p><p>{long}</p>{ad * 3}<p>The end</p>"
    assert htmltext.main_text(page) == f"A heading of some letters {long}{long}The end"


LINKS = "".join(f"<li><a href='/{k}'>Somewhere else {k}</a></li>" for k in range(6))


@pytest.mark.parametrize(
    "page, want",
    [
        # a marked article: the window takes a run of links out, wherever it stands, and keeps one or two with the text
        (f"<article><h1>Head</h1><p>One</p><ul>{LINKS}</ul><p>Two</p></article>", "Head One Two"),
        ("<article><p>One</p><p><a href='/'>a link</a></p><p>Two</p><p><a href='/'>last</a></p></article>", "One a link Two last"),
        (f"<article><h2><a href='/x'>Head</a></h2><p>One, see <a href='/y'>there</a></p>{LINKS}</article>", "Head One, see there"),
        # an unmarked page: links weigh nothing, the text surges and dives
        (f"<ul>{LINKS}</ul><p>{'word ' * 30}</p><p>{'more ' * 30}</p><ul>{LINKS}</ul>", ("word " * 30 + "more " * 30).strip()),
        # a mark that the densest window speaks against: the teaser isn't the text
        (f"<article><p>Read on</p></article><div><p>{'word ' * 90}</p><p>{'more ' * 90}</p></div>", "Read on " + ("word " * 90 + "more " * 90).strip()),
        (f"<article><p>{'word ' * 20}</p></article><div><p>{'other ' * 20}</p></div>", ("word " * 20).strip()),
        # names: a paragraph may be called what only a box is left out for
        ("<article><p class='share'>Shares fell.</p><div class='share'><a href='/'>f</a></div><p class='ad'>buy</p></article>", "Shares fell."),
        # a page of links alone
        ("<p><a href='/'>" + "only links " * 10 + "</a></p>", ("only links " * 10).strip()),
    ],
)
def test_the_window_decides(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title='a>b'>x</p>", "x"),
        ("<p title=it's>x</p><p>it's y</p>", "x it's y"),
        ("<p title='never closed>x</p><p>y</p>", "x y"),
        ("<article><p>x</p><a", "x"),
        ("1 <2 and a <", "1 <2 and a <"),
        ("x<!-- <p>no</p> -->y<!doctype z><?w?>z", "xyz"),
        ("a<script>var b = '</p>'</script>b", "a b"),
        ("x<!-- runs on <p>y", "x"),
    ],
)
def test_tags_are_scanned(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize("part", ["<a", "<a ", '<a ="', '<a =">"', "<script ", "<textarea ", "<!-- ", "<", "&", "<div class='x'>", "<noscript>x</noscript>", "<p a='", "<div a=b aaaa", "<b ='>' \"", "</", "<i>"])
def test_cost_is_linear_in_a_page_of_a_megabyte(part):
    start = time.process_time()
    htmltext.main_text("<div " + part * (1_000_000 // len(part)) + ">")
    htmltext.main_text(part * (1_000_000 // len(part)) + "x")
    assert time.process_time() - start < 6


def test_many_unclosed_elements_stay_linear():
    page = "".join(f"<{x}>a " for x in ("textarea", "iframe", "svg", "object", "select") for _ in range(20_000))
    assert htmltext.main_text(page).count("a") == 100_000


def test_surge_and_dive():
    assert htmltext.surges([0, 5, 0, 0, 0, 80, 3, 0, 9, 0, 0, 0, 7], 60) == [(5, 9)]
    assert htmltext.surges([], 1) == []


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>" * 50_000 + "t", "x")], "page_id long, url string, html string, text string")
    got = htmltext.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(r.n_chars for r in got.collect()) == [0, 0, 1]
    assert htmltext.extract(df.limit(0)).count() == 0
    named = htmltext.extract(df.selectExpr("cast(page_id as string) as page_id", "7 as url", "html", "text"))
    assert named.dtypes[:2] == [("page_id", "string"), ("url", "int")] and {r.page_id for r in named.collect()} == {"1", None}


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs.filter("doc_id % 4 <> 0"))


def test_held_out_accuracy_of_the_text_model(docs, model):
    rows = docs.filter("doc_id % 4 = 0 and n_chars > 60").collect()
    langs, logp = model
    right = sum(langs[int(np.argmax(langid.posterior(logp, r.text)))] == r.lang for r in rows)
    assert right >= 0.97 * len(rows)


def test_evidence_is_fused(spark, model):
    german = "die schule ist in der stadt und das haus steht auf dem berg mit einer tür und ich bin nicht da " * 3
    page = lambda lang, text: f"<html lang='{lang}'><body><p>{text}</p></body></html>"
    rows = [(k, f"https://www.a.example.de/{k}", page("de", german)) for k in range(30)]
    rows += [(100, "https://www.a.example.de/x", "<html><body></body></html>"), (101, None, None), (102, "::bad::", ""), (0, "https://www.a.example.de/0", page("de", german))]
    got = langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[0].lang == by[0].text_lang and by[0].declared == "de"
    assert by[100].lang == by[0].lang  # no text: its host's pages decide
    assert by[101].host == "" and 0 < by[101].confidence <= 1
    assert langid.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))


def test_fused_evidence_against_brute_force(spark, data, model):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    langs, logp = model
    rows = []
    for r in pages.collect():
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", r.url or "")
        host = found[1].lower() if found else ""
        declared = langid._LANG.search(r.html or "")
        rows.append((r.page_id, host, host.rsplit(".", 1)[-1], declared[1].lower()[:2] if declared else None, langid.posterior(logp, htmltext.main_text(r.html)).tolist()))
    want = brute.language(rows, langs, langid.PRIOR_PAGES, langid.MILLION)
    got = langid.identify(pages, model).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.lang == want[r.page_id][0] and abs(r.confidence - want[r.page_id][1]) < 2e-6


def test_odd_pages_have_a_language(spark, model):
    german = "die schule ist in der stadt und das haus steht auf dem berg " * 4
    rows = [("a", "http://h.de/1", f"<p>{german}", "x", "y", "z", "t"), ("a", "http://h.de/1", f"<p>{german}", "x", "y", "z", "t"), (None, None, None, None, None, None, None)]
    rows += [("long", "http://h.de/2", "<p>" + german * 2000, None, None, None, None), ("blank", "http://h.de/3", " ", None, None, None, None)]
    got = langid.identify(spark.createDataFrame(rows, "page_id string, url string, html string, lang string, host string, declared string, text string"), model).collect()
    assert len(got) == 5 and {r.lang for r in got if r.host == "h.de"} == {"de"} and len({(r.lang, r.confidence) for r in got if r.page_id == "a"}) == 1
