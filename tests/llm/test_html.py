from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.llm.html_consensus import extract, extract_pages, host_paths, parse, votes_of

PAGES = "page_id bigint, url string, html string"


def page(body, cls="post-12"):
    return (
        "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>Menu one</a></li></ul></nav><div class='ad'>Buy this now, it is cheap and very good for you.</div>"
        f"<div class='{cls}'>{body}</div><div class='sidebar'><p>Other things to read, in some length, on the side.</p></div>"
        "<div id='comments'><p>A reader says a lot about it all, longer than the text itself, on and on and on.</p></div>"
        "<form><p>Your mail address please</p></form><footer>&copy; somebody</footer></body></html>"
    )


def test_blocks_references_and_white_space():
    html = page("<h1>Head&nbsp;line</h1><p>First &lt;b&gt;\n  bold <b>text</b><br>goes &#233;on<p>Second <a href=x>link</a> text<ul><li>one<li>two</ul>tail")
    assert extract(html, None) == "Head line\nFirst <b> bold text goes éon\nSecond link text\none\ntwo\ntail"


def test_unclosed_and_odd_markup():
    assert extract("plain words", None) == "plain words"
    assert extract("a < b and <p>c", None) == "a < b and\nc"
    assert extract("<body><article><p><b>one<p>two</article><footer>no", None) == "one\ntwo"
    assert extract("<p>x<!-- <p>hidden --> y<script>unclosed <p>no", None) == "x y"
    assert extract("<div>" * 700 + "<nav>menu</nav><p>deep text</p>", None) == "deep text"
    assert extract("", None) == ""


def test_wrappers_that_only_name_a_sidebar_are_kept():
    assert extract("<body><div class='with-sidebar'><p>text stays</p></div></body>", None) == "text stays"


def test_paths_are_generalised():
    paths = {node.path for node, _, _ in parse(page("<p>x</p>", "b2 post-77"))[1]}
    assert ">body>div.b#.post-#" in paths
    assert votes_of(page("<p>some text that is here</p>"))[0][0] == ">body>div.post-#"


def test_the_host_decides(spark):
    body = "<p>" + "main text of the page " * 10 + "</p>"
    odd = page("<p>short</p>").replace("<nav>", "<div class='extra'><p>" + "text that is no part of the main one " * 10 + "</p></div><nav>")
    rows = [(i, f"http://Host.example/{i}", page(body, f"post-{i}")) for i in range(5)] + [(9, "http://host.example/odd", odd), (10, "http://alone.example/", odd)]
    pages = spark.createDataFrame(rows, PAGES)
    assert {r.host: r.path for r in host_paths(pages).collect()}["host.example"] == ">body>div.post-#"
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    assert got[9] == "short"  # alone it would have been the other container
    assert got[10].startswith("text that is no part")


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, "http://a.example/", None), (2, None, "<p>x y</p>"), (None, "odd", ""), (4, "http://a.example/", page("<p>z</p>")), (4, "http://a.example/", page("<p>z</p>"))]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("x"), "salt": F.lit(3), "path": F.lit(1), "text": F.lit("t")})
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(pages).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "x y", 3), (4, "z", 1), (4, "z", 1)]
    assert extract_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_very_long_page():
    body = "".join(f"<p>paragraph {i} of the text</p>" for i in range(20_000))
    assert extract(page(body), None).count("\n") == 19_999


LONG = "<p>" + "long text of the section " * 40 + "</p>"


def taken(spark, *bodies):
    rows = [(i, f"http://nested.example/{i}", page(b)) for i, b in enumerate(bodies)]
    return [r.text for r in extract_pages(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]


def test_title_and_lead_outside_the_section_stay(spark):
    article = f"<article><h1>Title</h1><p>Lead</p><section>{LONG}</section></article>"
    for text in [extract(page(article), None), *taken(spark, article, article)]:
        assert text.startswith("Title\nLead\nlong text")
    headed = f"<div class='entry'><h1>Title</h1><div class='entry-text'>{LONG}</div></div>"
    for text in [extract(page(headed), None), *taken(spark, headed, headed)]:
        assert text.startswith("Title\nlong text")


def test_one_page_with_a_lead_where_others_have_none(spark):
    plain = f"<article><section>{LONG}</section></article>"
    texts = taken(spark, plain, plain, plain, plain.replace("<section>", "<p>Lead</p><section>"))
    assert texts[3].startswith("Lead\nlong text")
    assert all(t.startswith("long text") for t in texts[:3])


def test_articles_split_over_several_classes_stay_whole(spark):
    def split(k):
        part = lambda name, n: f"<div class='{name}'><p>{name} " + "of the text " * n + "</p></div>"
        return part("intro", 10) + part("body", 20 + k) + part("outro", 10)

    for text in [extract(page(split(0)), None), *taken(spark, split(1), split(2))]:
        assert [line.split()[0] for line in text.split("\n")] == ["intro", "body", "outro"]


def test_menus_and_short_notes_beside_the_text_stay_out(spark):
    body = f"<div class='text'>{LONG}</div>"
    links = "<div class='list'>" + "".join(f"<a href='/{i}'>another page to look at</a> " for i in range(40)) + "</div>"
    for text in taken(spark, body + links, body + links, body + "<div class='line'>a slogan</div>"):
        assert text.startswith("long text") and "another" not in text and "slogan" not in text


def test_class_words_inside_an_article_do_not_decide(spark):
    article = "<article><h1>T</h1><p>First words.</p><div class='share-prices'><p>Prices rose again.</p></div><p class='search-method'>We searched by hand.</p><section class='related-work'><h2>Related work</h2><p>Others did too.</p></section>{}</article>"
    odd = "<div class='related-posts'><ul><li><a href='/1'>Another post</a></li><li><a href='/2'>One more</a></li></ul></div><ul class='share-links'><li><a href='/s'>Share it</a></li></ul><div class='share'>Tell others</div><div class='comments'><p>A reader's word</p></div>"
    expected = "T\nFirst words.\nPrices rose again.\nWe searched by hand.\nRelated work\nOthers did too."
    pages = [f"<html><body><nav><a href='/'>home</a></nav>{article.format(odd)}<footer>foot</footer></body></html>"] * 3
    assert extract(pages[0], None) == expected
    frame = spark.createDataFrame([(i, f"http://marks.example/{i}", p) for i, p in enumerate(pages)], PAGES)
    assert [r.text for r in extract_pages(frame).collect()] == [expected] * 3


def test_a_short_conclusion_beside_the_body_stays(spark):
    body = "<div class='body'>" + "<p>" + "words of the long body " * 12 + "</p>" * 4 + "</div><div class='outro'><p>So much for that.</p></div>"
    pages = [f"<html><body><nav>menu</nav>{body}<footer>foot</footer></body></html>"] * 5
    frame = spark.createDataFrame([(i, f"http://outro.example/{i}", p) for i, p in enumerate(pages)], PAGES)
    assert all(r.text.endswith("So much for that.") and r.text.startswith("words of") for r in extract_pages(frame).collect())
