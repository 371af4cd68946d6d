import datetime as dt
import html as stdlib_html

import pytest
from pyspark.sql import functions as F

from zeitton.functions import html as markup
from zeitton.operators import articles, listings

DAY = dt.date(2024, 12, 1)


def wrapper(body, css="copytext-element-wrapper__vertical-only"):
    return f'<div class="{css}">{body}</div>'


TEASER = """
    <a class="teaser-right__link" href="/inland/a-100.html">
      <div class="teaser-right__date">01.12.2024 • 09:05 Uhr</div>
      <span class="teaser-right__labeltopline">Context</span>
      <span class="teaser-right__headline">A <b>bold</b> &amp; short title</span>
      <p class="teaser-right__shorttext">Summary.</p></a>"""


def page(*wrappers, head='<h2 class="archive__headline">01. Dezember 2024</h2>', content='id="content"'):
    return f"<html><body>{head}<div {content}>{''.join(wrappers)}</div></body></html>"


def teasers(spark, html):
    df = spark.createDataFrame([(DAY, 3, html)], "day date, page int, html string")
    return [r.asDict() for r in listings.extract_teasers(df).orderBy("position").collect()]


def status(spark, html):
    df = spark.createDataFrame([(DAY, 3, html)], "day date, page int, html string")
    return listings.page_status(df).first()


SKIP = [wrapper("one"), wrapper("two")]


def test_teaser_fields(spark):
    (row,) = teasers(spark, page(*SKIP, wrapper(TEASER)))
    assert row == {
        "date_api": "2024-12-01", "page_api": 3, "date": "01.12.2024 • 09:05 Uhr",
        "headline": "Abold& short title", "short_headline": "Context", "short_text": "Summary.",
        "link": "/inland/a-100.html", "position": 0,
    }


@pytest.mark.parametrize("count", [0, 1, 2, 3, 5])
def test_first_two_wrappers_are_skipped(spark, count):
    html = page(*(wrapper(TEASER) for _ in range(count)))
    assert len(teasers(spark, html)) == max(count - 2, 0)
    assert status(spark, html).n_links == max(count - 2, 0)


def test_missing_parts(spark):
    (row,) = teasers(spark, page(*SKIP, wrapper("nothing")))
    assert (row["link"], row["headline"], row["short_headline"], row["short_text"]) == ("", "", "", "")
    assert row["date"] == "2024-12-01"
    (row,) = teasers(spark, page(*SKIP, wrapper('<div class="teaser-right__date"> </div><a class="teaser-right__link">x</a>')))
    assert row["date"] == "2024-12-01" and row["link"] == ""


def test_no_content(spark):
    html = page(*SKIP, wrapper(TEASER), content='id="contents"')
    assert teasers(spark, html) == []
    assert status(spark, html).n_links == 0
    assert status(spark, None).error


def test_attribute_forms(spark):
    body = "<A HREF='/x?a=1&amp;b=2' class='foo teaser-right__link bar'>t</A><span class=teaser-right__headline>H</span>"
    other = wrapper('<a class="teaser-right__linked" href="/no">t</a>' + body, "x copytext-element-wrapper__vertical-only y")
    (row,) = teasers(spark, page(*SKIP, other, content="data-id='z' id='content'"))
    assert row["link"] == "/x?a=1&b=2" and row["headline"] == "H"


def test_nested_markup(spark):
    """Fields come from the wrapper's own subtree; nested wrappers count on their own."""
    inner = wrapper('<span class="teaser-right__headline">in <span>deep</span> er</span>')
    html = page(*SKIP, wrapper("<div>" + inner + "</div>"), wrapper("<div>empty</div>"))
    html += '<span class="teaser-right__headline">after</span>' + wrapper(TEASER)
    assert [r["headline"] for r in teasers(spark, html)] == ["indeeper", "indeeper", ""]


def test_hidden_parts_do_not_count(spark):
    noise = "<!-- <div> --><script>var a='</div><div>';</script><style>div{}</style>"
    body = noise + '<span class="teaser-right__headline">a<!-- c --> b</span>'
    (row,) = teasers(spark, page(*SKIP, wrapper(body)))
    assert row["headline"] == "ab"


@pytest.mark.parametrize(
    ("head", "flag"),
    [
        ('<h2 class="archive__headline">01. Dezember 2024</h2>', False),
        ('<h2 class="archive__headline">Dezember 2022</h2>', True),
        ('<h1 class="x archive__headline"> <b>Dezember</b> 2022</h1>', True),
        ('<h2 class="archive__headline"> </h2>', False),
        ("<h2>Dezember 2022</h2>", False),
    ],
)
def test_monthly_summary(spark, head, flag):
    assert status(spark, page(*SKIP, wrapper(TEASER), head=head)).monthly_summary is flag


def test_entities(spark):
    texts = ["&amp;lt;", "&#8222;x&ldquo;", "&#x1F600;", "&nbsp;a&nbsp;", "&unbekannt;", "a & b", "&uuml;&szlig;", "&amp"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", markup.decode_entities(F.col("t")).alias("d")).collect():
        assert row.d == stdlib_html.unescape(row.t)


def test_text_that_is_no_tag(spark):
    df = spark.createDataFrame([("x <b>1</b> < 2",)], "t string")
    assert df.select(markup.visible_text(markup.tokens(F.col("t")))).first()[0] == "x1< 2"


NEWS = '{"@type":"NewsArticle","articleBody":"%s","datePublished":"p","dateModified":"m"}'


def script(content, kind='type="application/ld+json"'):
    return f"<script {kind}>{content}</script>"


@pytest.mark.parametrize(
    ("blocks", "body", "date"),
    [
        ([NEWS % "o"], "o", "m"),
        (['[{"@type":"X"},' + NEWS % "a" + "," + NEWS % "b" + "]"], "a", "p"),
        (["[" + NEWS % "a" + "]", "[" + NEWS % "b" + "]"], "b", "p"),
        (["[" + NEWS % "a" + "]", NEWS % "o"], "o", "m"),
        ([NEWS % "o", NEWS % "q"], "o", "m"),
        ([NEWS % "o", "[" + NEWS % "a" + "]"], "o", "m"),
        (["{bad", NEWS % "o"], "o", "m"),
        (["", "5", '"x"', '{"@type":"Other"}', "[1]"], None, None),
        ([], None, None),
    ],
)
def test_article_choice(spark, blocks, body, date):
    html = "<html>" + "".join(script(b) for b in blocks) + script("{}", 'type="text/javascript"') + "</html>"
    df = spark.createDataFrame([("/a", html)], "link string, html string")
    row = articles.extract_articles(df).first()
    assert (row.articleBody, row.datePublished, row.has_article) == (body, date, body is not None)


def article(spark, text):
    html = script('{"@type":"NewsArticle"' + text + "}", "data-x=1 type='application/ld+json'")
    df = spark.createDataFrame([("/a", html)], "link string, html string")
    return articles.extract_articles(df).first()


def test_article_defaults_and_shapes(spark):
    row = article(spark, "")
    assert (row.articleBody, row.datePublished, row.author, row.description, row.taglist) == ("", "", "", "", [])
    row = article(spark, ',"author":"Ann","keywords":"one"')
    assert (row.author, row.author_names, row.taglist) == ("Ann", ["Ann"], ["one"])
    row = article(spark, ',"author":{"name":"Ann"},"keywords":["a","b"]')
    assert (row.author_names, row.taglist) == (["Ann"], ["a", "b"])
    row = article(spark, ',"author":[{"name":"Ann"},"Bob",{"x":1}],"keywords":null')
    assert (row.author_names, row.taglist) == (["Ann", "Bob"], [])


@pytest.mark.parametrize(
    ("span", "label"),
    [
        ('<span class="label label--standard-primary"> Krieg &amp; <i>Frieden</i> </span>', "Krieg &Frieden"),
        ('<span class="label">no</span>', ""),
        ('<span class="label label--standard-primary extra">no</span>', ""),
        ("", ""),
    ],
)
def test_label(spark, span, label):
    df = spark.createDataFrame([("/a", f"<p>{span}</p>")], "link string, html string")
    assert articles.extract_articles(df).first().label == label


def test_join_and_status(spark):
    listing = spark.createDataFrame([("/a", "1"), ("/a", "2"), ("/b", "3"), ("", "4"), ("/c", "5")], "link string, h string")
    pages = spark.createDataFrame(
        [("/a", "<p>"), ("/a", script(NEWS % "o")), ("/b", None), ("", "<p>"), ("/c", "<p>")], "link string, html string"
    )
    joined = articles.with_articles(listing, articles.extract_articles(pages))
    assert sorted((r.h, r.articleBody) for r in joined.collect()) == [("1", "o"), ("2", "o"), ("5", None)]
    assert {r.status: r.n for r in articles.fetch_status(pages).collect()} == {"article": 1, "no_article": 3, "failed": 1}


def test_depths_across_blocks(spark):
    import itertools
    import random

    rng = random.Random(2)
    cases = [[], [1], [1, -2]] + [[rng.choice((1, -1)) * (i + 1) for i in range(n)] for n in (63, 64, 65, 128, 300)]
    df = spark.createDataFrame([(c,) for c in cases], "m array<int>")
    for row in df.select("m", markup.depths(F.col("m")).alias("d")).collect():
        assert row.d == list(itertools.accumulate(1 if m > 0 else -1 for m in row.m))


def test_brackets_and_tags_inside_values(spark):
    body = (
        '<a title="x > y <b>" class="teaser-right__link" data-q=\'1 > 0\' href="/q?a=1&amp;b=<2>">'
        '<span data-x="</span>" class="teaser-right__headline">1 &lt; 2 > 0</span></a>'
    )
    (row,) = teasers(spark, page(*SKIP, wrapper(body)))
    assert (row["link"], row["headline"]) == ("/q?a=1&b=<2>", "1 < 2 > 0")
    flagged = page(*SKIP, wrapper(body), head='<h2 title="a > b" class="archive__headline">Dezember</h2>')
    assert status(spark, flagged).monthly_summary


def test_commented_scripts_do_not_count(spark):
    html = "<!-- " + script(NEWS % "old") + " -->" + script(NEWS % "<!-- kept -->")
    df = spark.createDataFrame([("/a", html)], "link string, html string")
    assert articles.extract_articles(df).first().articleBody == "<!-- kept -->"


def test_nested_and_unclosed_wrappers(spark):
    nested = wrapper("<div>x</div>" + wrapper(TEASER) + "<div><div>y</div></div>")
    assert [r["link"] for r in teasers(spark, page(*SKIP, nested, wrapper("z")))] == ["/inland/a-100.html"] * 2 + [""]
    html = page(*SKIP, wrapper("one"))[: -len("</div></div></body></html>")] + TEASER
    assert [r["link"] for r in teasers(spark, html)] == ["/inland/a-100.html"]


def test_many_teasers_on_a_page(spark):
    one = wrapper('<div><a class="teaser-right__link" href="/a"></a></div>')
    assert len(teasers(spark, page(*SKIP, one * 3000))) == 3000


def test_bare_brackets_stay_in_their_text(spark):
    """A ``<`` that begins no tag leaves its text node whole, blanks around it included."""
    texts = {
        "<p> 5 < 6 and 7 > 3 </p>": "5 < 6 and 7 > 3", "a <b>c</b> <": "ac<", "x<1<y>z": "x<1z", "< <i> t </i>": "<t",
        "1 &lt; 2 <br> 3 <3": "1 < 23 <3", "<": "<", "": "", "no tag": "no tag", "<i>a</i > b": "ab",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", markup.visible_text(markup.tokens(F.col("t"))).alias("x")).collect()
    assert {r.t: r.x for r in found} == texts
    (row,) = teasers(spark, page(*SKIP, wrapper('<p class="teaser-right__shorttext"> if 1 < 2 <b>then</b> 3 <4 </p>')))
    assert row["short_text"] == "if 1 < 2then3 <4"


def test_fields_inside_one_another(spark):
    body = (
        '<p class="teaser-right__shorttext">a<span class="teaser-right__headline">b<span>c</span>d</span>e'
        '<span class="teaser-right__headline">second</span><span class="teaser-right__labeltopline">f</p>g</span>h'
    )
    (row,) = teasers(spark, page(*SKIP, wrapper(body)))
    assert (row["headline"], row["short_text"], row["short_headline"]) == ("bcd", "abcdesecondf", "fg")
    (row,) = teasers(spark, page(*SKIP, wrapper('<span class="teaser-right__headline">open <i>to the end')))
    assert row["headline"] == "opento the end"
