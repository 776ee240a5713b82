"""Elements of pages, article containers, links and their patterns, disclosure tables, feed entries, files."""

import pytest
from pyspark.sql import functions as F

from quotemill.plans import pages, registry, text
from tests.oracle import connection, same

LONG = "word " * 12


def page(spark, *html, url="https://www.news.vn/kinh-doanh/a.htm"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id long, url string, html string")


def elements(spark, html, name):
    got = pages.with_elements(page(spark, html)).select(F.explode(F.transform("elements", lambda e: e.withField("text", pages.text_of(e)))).alias("e")).where(F.col("e.name") == name).select("e.*")
    return sorted(got.collect(), key=lambda e: e["at"])


def test_paragraphs_end_where_html_ends_them(spark):
    html = "<div class='x y z'><p>one <b>bold<br><p>two &amp; <script>no</script>three<ul><li>a<li><a href=u>b</a></ul></div></span>"
    assert [e["text"] for e in elements(spark, html, "p")] == ["one bold", "two & three"]
    assert [e["chain"] for e in elements(spark, html, "a")] == ["ul li a[href]"]
    box = elements(spark, html, "div")[0]
    assert (box["chain"], box["paragraphs"], box["long"]) == ("div.x.y", 2, 0)


@pytest.mark.parametrize("html", [None, "", "<", "</p></div>", "text", "<table><tr><td>", "<p" * 500, "<div>" * 3000 + "x"])
def test_broken_pages(spark, html):
    p = page(spark, html)
    assert text.page_article(p).count() == 1 and pages.page_links(p).count() == 0 and pages.disclosure_rows(p).count() == 0
    assert tuple(pages.link_patterns(p).first()) == (0, pages.ANY_LINK, 0)


def test_body_of_the_best_container(spark):
    lead = f"<p>{LONG}</p>"
    side = f"<div class='sidebar'>{lead * 9}</div>"
    links = f"<section>{''.join(f'<p><a href=#>{LONG}</a></p>' for _ in range(3))}</section>"
    html = f"<body>{side}{links}<div id='c'>{lead * 3}<p>short</p></div></body>"
    body = lambda h: text.page_article(page(spark, h)).first()["body_text"]
    assert body(html) == " ".join([LONG.strip()] * 3 + ["short"])
    assert body(f"<div>{lead * 4}</div><article>{lead * 2}</article>") == " ".join([LONG.strip()] * 2)
    assert body('<script type="application/ld+json">{"@type": "Article", "articleBody": "told \\"so\\""}</script>' + html) == 'told "so"'
    assert body("<p>one</p><p>two</p>") == "one\ntwo"


def test_links_of_one_host(spark):
    html = (
        "<a href='/x.htm?utm_a=1'>four</a><a href='../co-phieu/b/'>" + "t" * 200 + "</a><a href='//news.vn/c'>a long enough text</a><a href='https://other.vn/d'>a long enough text</a>"
        "<a href='/login'>a long enough text</a><a href='javascript:f()'>a long enough text</a><a href='/x.htm'>again, and a much longer text</a><a>no address here</a><a href='e'></a>"
    )
    got = [(r["href"], round(r["score"], 1), r["rank"]) for r in pages.page_links(page(spark, html)).orderBy("rank").collect()]
    assert got == [("https://www.news.vn/co-phieu/b", 15.0, 1), ("https://www.news.vn/x.htm", 4.4, 2), ("https://news.vn/c", 1.8, 3)]  # "htm" is a section's word too
    assert len(pages.page_links(page(spark, html), 1).collect()) == 1


@pytest.mark.parametrize("href,wanted", [("b", "https://h.vn/a/b"), ("./b?c#d", "https://h.vn/a/b?c#d"), ("../../b", "https://h.vn/b"), ("?q", "https://h.vn/a/i?q"), ("/b/../c/", "https://h.vn/c/"), ("//x.vn/y", "https://x.vn/y"), ("mailto:a@b", "mailto:a@b"), ("http://z/..", "http://z/..")])
def test_absolute_url(spark, href, wanted):
    assert spark.range(1).select(pages.absolute_url(F.lit("https://h.vn/a/i?p"), F.lit(href))).first()[0] == wanted


def test_most_frequent_link_pattern(spark):
    one = lambda cls, i: f"<div class='{cls}'><h3><a href='/n{i}.htm'>a long enough text</a></h3></div>"
    html = one("lead", 0) + one("item big", 1) + one("item big", 2) + "<ul>" + "".join(f"<li><a href='/m{i}'>short</a></li>" for i in range(9)) + "</ul>"
    got = {r["page_id"]: (r["pattern"], r["n"]) for r in pages.link_patterns(page(spark, html, one("b", 1) + one("a", 2), "<a href='/x'>y</a>")).collect()}
    assert got == {0: ("div.item.big h3 a[href]", 2), 1: ("div.b h3 a[href]", 1), 2: (pages.ANY_LINK, 0)}


def test_disclosure_rows(spark):
    html = """<table><thead><tr><th>x<th><a class=hrefViewDetail onclick="ViewDetailArticlesByID(9)">Head</a></thead>
      <tr><td>1<td>02/03/2024 10:11<td class="SYMBOL"><a href="/s">abc</a><td><a class="hrefViewDetail" onclick="return funcViewDetailArticlesByID( 11 , 2)">Report &amp; more</a></td></tr>
      <tr><td>3/4/2024<td>FPT</td><td><a onclick="ViewDetailArticlesByID(12)">Second</a></td><td><a class="icon-FileAttach" onclick="ShowFileAttach(13,1)"></a></tr>
      <tr data-id="14"><td><a class="x hrefViewDetail">Third</a></tr><tr><td><a class="hrefViewDetail">No number</a></tr><tr data-id="15"><td>no title</tr></table>"""
    assert {(r["ticker"], r["title"], r["article_id"], r["file_attach"], r["published_at"]) for r in pages.disclosure_rows(page(spark, html)).collect()} == {("ABC", "Report & more", 11, 2, "02/03/2024 10:11"), ("FPT", "Second", 13, 1, "3/4/2024"), ("", "Third", 14, 0, "")}


def test_feed_entries(spark):
    rows = [("https://f.vn/rss", 1, None, "Cổ phiếu FPT  tăng", "https://a.vn/1/?utm_x=1", "2024-01-02T03:04:05+07:00"), ("https://f.vn/rss", 2, "t", "h", "", None), ("https://f.vn/rss", 3, "past the cap", None, "https://a.vn/3", None)]
    d = spark.createDataFrame(rows, "feed string, ord int, title string, headline string, link string, updated string")
    got = text.feed_entries(d, "feed", "ord", 2, codes=spark.createDataFrame([("FPT",)], "code string")).withColumn("published_at", F.col("published_at").cast("timestamp_ntz").cast("string")).collect()
    assert [(r["source"], r["title"], r["url"], r["published_at"], r["ticker"]) for r in got] == [("rss_f.vn", "Cổ phiếu FPT tăng", "https://a.vn/1", "2024-01-01 20:04:05", "FPT")]


# --- selectors

HTML = """<body><nav id=top class="menu wide"><ul><li><a href="/a.chn">one</a><li><a href='/b'>two <b>bold</b></a></ul></nav>
  <article class="fck_detail item" data-x="p-1"><header><h1 class="title-detail">A  title</h1><p class=lead>L</p></header><div><p>first<p>second<div><p lang=en-GB>third</p></div></div></article>
  <div class="item"><p>outside</p><a name=none>anchor</a></div></body>"""


@pytest.mark.parametrize("css, wanted", [
    ("p", ["L", "first", "second", "third", "outside"]), ("article p", ["L", "first", "second", "third"]), ("article > div > p", ["first", "second"]), ("article>div p", ["first", "second", "third"]), ("div div p", ["third"]),
    (".item p", ["L", "first", "second", "third", "outside"]), ("div.item > p", ["outside"]), ("nav#top.menu.wide a", ["one", "two bold"]), ("#top li > a", ["one", "two bold"]), ("a[href]", ["one", "two bold"]),
    ("a[href$='.chn'], a[name=none]", ["one", "anchor"]), ('h1, article[data-x^="p-"] header p , .nothing', ["A title", "L"]), ("[class~=wide] [href*=b]", ["two bold"]), ("p[lang|=en]", ["third"]), ("* > b", ["bold"]),
    ("article.fck_detail.item h1.title-detail", ["A title"]), ("section p", []), ("a[href^='']", []), ("p,p", ["L", "first", "second", "third", "outside"]),
])
def test_selectors(spark, css, wanted):
    d = pages.with_elements(page(spark, HTML, None))
    got = d.select("page_id", F.transform(pages.select(F.col("elements"), css), pages.text_of).alias("t"), pages.one_text(css).alias("one"), pages.all_texts(css).alias("all")).orderBy("page_id").collect()
    assert (got[0]["t"], got[0]["one"], got[0]["all"]) == (wanted, wanted[0] if wanted else None, " ".join(wanted)) and (got[1]["t"], got[1]["one"]) == ([], None)


@pytest.mark.parametrize("css", ["", " ", "p,", ",p", "p >> a", "a:hover", "p[", "p+a", "ab*"])
def test_selectors_that_cannot_be_read(css):
    with pytest.raises(ValueError):
        pages.parsed_selector(css)


def test_long_and_deep_pages_take_linear_time(spark):
    """Texts of nested elements are spans, and what a page leaves open is looked for once."""
    import time

    for html in ("<table>" + "<tr><td>word <table>" * 8000, "<a href=x>t" * 20_000, '<a "' * 50_000, "<!--" * 50_000, "<p" * 50_000, "<script>" * 20_000, "<div>" * 20_000 + "x"):
        began = time.perf_counter()
        parsed = pages._Pass().run(html)
        assert time.perf_counter() - began < 1.5 and sum(len(w) + 1 for w in parsed.words) <= len(html)
    nested = page(spark, "<table>" + "<tr><td>word <table>" * 8000)
    began = time.perf_counter()
    assert pages.disclosure_rows(nested).count() == 0 and time.perf_counter() - began < 20


# --- articles by JSON-LD, meta tags, selectors

def article(spark, html):
    return text.page_article(page(spark, html)).withColumn("published_at", F.col("published_at").cast("timestamp_ntz").cast("string")).first()


def ld(content):
    return f'<script type="application/ld+json">{content}</script>'


def test_json_ld_objects(spark):
    graph = ld('{"@graph": [{"@type": "Organization", "name": "Org"}, {"@type": ["Thing", "NewsArticle"], "headline": " A \\"told\\" title ", "abstract": "short", "articleBody": "<p>body &amp; more</p>", "datePublished": "2024-01-02T03:04:05+07:00"}]}')
    got = article(spark, "<h1>the page's own title</h1>" + ld("not json") + graph)
    assert (got["title"], got["summary"], got["body_text"], got["published_at"]) == ('A "told" title', "short", "body & more", "2024-01-01 20:04:05")
    assert article(spark, ld('[{"@type": "Person", "name": "x"}, {"type": "BlogPosting", "name": "named", "text": "told"}]'))["title"] == "named"
    other = article(spark, ld('{"@type": "WebPage", "headline": "no article", "articleBody": "no"}') + ld('{"@type": "Article"}') + "<h1>a long enough title</h1><p>one</p>")
    assert (other["title"], other["body_text"]) == ("a long enough title", "one")


def test_titles_summaries_and_dates_in_their_order(spark):
    sapo = "a summary of twenty letters or more"
    got = article(spark, f"<title>Page title - Site | News</title><h1>short</h1><article><h1>In the article</h1><header><p>{sapo}</p></header></article><h2 class='sapo'>too short</h2><div class='sapo'>{sapo}!</div><span class='date'>Thứ hai, 2/3/2024, 10:11</span>")
    assert (got["title"], got["summary"], got["published_at"]) == ("In the article", sapo, "2024-03-02 03:11:00")
    assert article(spark, "<title>Page title - Site | News</title><h1>short</h1>")["title"] == "Page title"
    assert article(spark, "<title>Short - a long enough site</title>")["title"] is None
    got = article(spark, "<meta name='og:title' content=' by  name '><meta property='twitter:title' content='by property'><meta name=description content='told &amp; short'><h1 class='title-detail'>on the page</h1><time>no date</time><time datetime='2024-05-06T07:08:09+00:00'></time>")
    assert (got["title"], got["summary"], got["published_at"]) == ("by name", "told & short", "2024-05-06 07:08:09")
    assert article(spark, "<meta property='og:title' content=' '><h1 class='title'>" + "t" * 8 + "</h1>")["title"] == "t" * 8


def test_fields_by_selector_and_both(spark):
    css = {"title": "h1.title-detail", "summary": "p.none", "body": "article > div > p", "published_at": ".item p"}
    one = lambda mode, **more: text.page_fields(page(spark, HTML), css, mode, **more).first()
    assert tuple(one("css"))[1:] == ("A title", None, "first second", None)
    lead = HTML.replace("<p class=lead>L</p>", "<p class=lead>a lead of twenty letters or more</p><span class=date>1/2/2024 00:30</span>")
    both = text.page_fields(page(spark, lead), css, "hybrid").withColumn("published_at", F.col("published_at").cast("timestamp_ntz").cast("string")).first()
    assert tuple(both)[1:] == ("A title", "a lead of twenty letters or more", "first second", "2024-01-31 17:30:00")
    assert one("heuristic")["title"] is None  # seven letters
    named = spark.createDataFrame([(0, "the link's text")], "page_id int, title string")
    assert text.page_fields(page(spark, HTML), css | {"title": "h6"}, "css", named).first()["title"] == "the link's text"


def test_references_cut_off(spark, tmp_path):
    """A title that is cut off inside a reference: a character in HTML, its letters in the SQL of ``page_field_merge``."""
    cut = "<html><head><title>over eight letters &amp;&quot; &amp</title></head><body><nav><ul><li><a href=\"/a\">A &amp; b</a></li></ul></nav><article><h1>with &amp; a heading</h1></article></body></html>"
    page(spark, cut, cut, cut.replace("&amp</title>", "&am</title>"), cut.replace("&amp</title>", "&amp; &amp;amp</title>")).write.parquet(str(tmp_path / "pages.parquet"))
    of_page = spark.read.parquet(str(tmp_path / "pages.parquet")).withColumn("html", F.regexp_replace("html", "<h1>.*</h1>", ""))
    assert {r["title"] for r in text.page_fields(of_page, {}).where("page_id = 0").collect()} == {'over eight letters &" &'}
    files = connection(str(tmp_path))
    files.execute(f"create or replace view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    same(registry.queries()["page_field_merge"](spark, str(tmp_path)), files, registry.oracle_sql()["page_field_merge"])


def test_lists_lead_to_articles(spark):
    lists = spark.createDataFrame([(1, "https://n.vn/l/", "<h3><a href='/a?utm_source=x'>A</a></h3><h3><a href='../b'>B</a></h3><h3><a href='/a'>again</a></h3><h3><a href=/c></a></h3><a href='/d'>no heading</a><h3><a href=/e>past the cap</a></h3>")], "list_id int, url string, html string")
    d = spark.createDataFrame([(i, f"https://n.vn/{c}", h) for i, (c, h) in enumerate([("a", "<h1>title of a</h1><p>body</p>"), ("b", "<h1>no text, no date</h1>"), ("c", "<p>c</p>"), ("d", "<p>d</p>"), ("e", "<p>e</p>"), ("a", "<p>twice</p>")])], "page_id int, url string, html string")
    got = text.listed_articles(lists, d, "h3 a", {"title": "h2"}, 4).collect()
    assert [(r["list_id"], r["page_id"], r["title"], r["body_text"]) for r in got] == [(1, 0, "title of a", "body")]
    dated = d.withColumn("html", F.concat("html", F.lit("<time datetime='2024-01-01T00:00:00Z'></time>")))
    assert sorted(r["page_id"] for r in text.listed_articles(lists, dated, "h3 a", {}, 9).collect()) == [0, 1, 4]
