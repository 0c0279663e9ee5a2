import html as entities
import re
import time

import pandas as pd

from pkgloom.llm import html_extraction


def plain(page):
    """The article of the given pages, which know p, b, br and h1 only."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
    return "\n".join(t for t in (" ".join(entities.unescape(p).split()) for p in parts) if t)


def test_given_pages(spark, data):
    pages = pd.read_parquet(f"{data}/pages.parquet")
    got = html_extraction.extract(spark.read.parquet(f"{data}/pages.parquet")).toPandas().set_index("page_id")
    for r in pages.itertuples():
        assert got.loc[r.page_id].text == plain(r.html)
        assert got.loc[r.page_id].n_chars == len(got.loc[r.page_id].text)


def test_boilerplate_and_templates(spark):
    unique = lambda i: f"<p>Own words of page {i}, nothing else has them &amp; that's it.</p>"
    page = lambda i: (
        f"<html><head><title>t</title><script>var x='</p><p>no';</script></head><body><header>Site</header><div class='cookie-notice'>Cookies!</div>"
        f"<div class=top><p>Welcome to the example site</p></div><div><h2>Head {i}</h2>{unique(i)}<ul><li>one {i}<li>two&nbsp;  {i}</ul></div>"
        "<section id=comments><p>First!</p></section><form><p>Search</p></form><footer>bye</footer>"
    )
    rows = [(i, "http://a.example/x", page(i)) for i in range(10)] + [(10, None, None), (11, "http://b.example", ""), (12, "http://b.example", "plain <b>text</b>"), (13, "http://c.example", page(13))]
    got = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Head 3\nOwn words of page 3, nothing else has them & that's it.\none 3\ntwo 3"
    assert got[13].text.startswith("Welcome to the example site\nHead 13")  # one page is no template
    assert (got[10].text, got[10].n_chars, got[11].text, got[12].text) == ("", 0, "", "plain text")


def test_copies_of_one_article_stay(spark):
    rows = [(i, "http://a.example/x", "<body><div><div><p>The same article everywhere.</p></div></div></body>") for i in range(30)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"The same article everywhere."} and len(got) == 30


def test_unmarked_block_on_few_pages_of_a_large_host(spark):
    promo = "<div class=box><p>Try our new plan</p></div>"
    page = lambda i: f"<body><div><p>Own words of page {i}</p></div>{promo if i % 40 == 0 or i == 1 else ''}{'<div><p>Only four times</p></div>' if i % 100 == 7 else ''}</body>"
    rows = [(i, "http://large.example/x", page(i)) for i in range(400)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {t for i, t in got.items() if i % 100 == 7} == {f"Own words of page {i}\nOnly four times" for i in (7, 107, 207, 307)}
    assert all(t == f"Own words of page {i}" for i, t in got.items() if i % 100 != 7)


def test_empty_table(spark):
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_within_the_article_and_clashing_columns(spark):
    page = "<body><div class=header>Site</div><article><div class='header'><h1>Title</h1></div><p>Body <math>x</math></p><p>a &lt; b < c</p><div class='related'>More of it</div><div class='comments'>First!</div><aside>Side</aside></article></body>"
    rows = spark.createDataFrame([(1, "http://a.example/", page), (1, "http://a.example/", page), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS uid", "3 AS blocks", "4 AS text", "5 AS content")
    got = html_extraction.extract(rows).collect()
    assert [r.text for r in got if r.page_id] == ["Title\nBody x\na < b < c\nMore of it"] * 2 and len(got) == 3


def test_broken_pages_take_time_in_proportion():
    begin = time.time()
    for page in ('<a "' * 100_000, "<a '" * 100_000 + ">", "<" * 300_000, "<!-- " * 100_000, "</" * 200_000, "</" * 200_000 + ">", "<p>" * 100_000 + "x"):
        html_extraction.blocks_of(page)
    assert html_extraction.blocks_of('<p>one</p><p class="x>two</p><p>three</p>')[0][0][0] == "one"
    assert time.time() - begin < 20
