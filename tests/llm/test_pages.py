"""Main text of pages."""

import html as entities
import re

import pytest

from riskspark.llm.html_text import blocks_of, extract, main_text

PROSE = ("This is the first paragraph of the text and it is long enough to be read as prose, with many of the words "
         "that are found in all of the texts of the world, so that it is good.")


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &lt;b&gt;  text", "plain <b> text"), ("<p>a<p>b<br>c", "a b c"),
    ("<p>un<b>clo</b>sed <i>x", "unclosed x"), ("a<!-- x", "a"), ("a <div", "a"), ("<p>1 < 2 & 3 &amp; 4</p>", "1 < 2 & 3 & 4"),
    ("<script>var t='</p>';if(a<b)x()</script><p>x</p><style>p{}</style>", "x"), ("<title>t</title><body>x", "x"),
    ("<textarea>t<p>u</textarea><p>x", "x"), ("<p>caf&eacute; &#233; &#xe9; &nbsp; z", "café é é z"),
    ("<SCRIPT>x</SCRIPT><P>y</P>", "y"), ("<p title='a>b'>x</p>", "x"), ("<p title=\"a>x</p>", "x"),
])
def test_small_pages(page, text):
    assert main_text(page) == text


def test_article_is_kept_whole_and_the_rest_goes():
    article = f"<h1>Title</h1><p>{PROSE}</p><p>a | b | c</p><ul><li>one</li><li>two</li></ul><p>Short.</p>"
    page = (f"<html><head><title>T</title></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='ad'>{PROSE}"
            f"</div><div class=\"cookie-notice\">{PROSE}</div><article>{article}<form><input>{PROSE}</form><aside>{PROSE}</aside>"
            f"</article><div id=comments><article class=comment>{PROSE}</article></div><footer>{PROSE}</footer></body></html>")
    assert main_text(page) == f"Title {PROSE} a | b | c one two Short."


def test_without_an_article_density_decides_and_short_blocks_inherit():
    page = (f"<div><a href=/>Home</a> <a href=/x>About us</a></div><div id=x><h2>Title</h2><p>{PROSE}</p><p>Short.</p>"
            f"<p>{PROSE}</p></div><div class=sidebar>{PROSE}</div><ul><li><a href=/1>More news</a><li><a href=/2>Yet more</a></ul>")
    assert main_text(page) == f"Title {PROSE} Short. {PROSE}"


ARTICLE = f"<h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p>"
AROUND = f"<nav><a href=/>Home</a></nav><div class=sidebar>{PROSE}</div><footer>{PROSE}</footer>"


@pytest.mark.parametrize("page", [
    f"<html class=no-ads><body class='single has-sidebar'>{AROUND}<article>{ARTICLE}</article></body>",
    f"<body class='login menu'>{AROUND}<div>{ARTICLE}</div></body>",
    f"<body><div class='layout-sidebar-right'>{AROUND}<article>{ARTICLE}</article></div></body>",
    f"<body><div class='wrapper sidebar-right'>{AROUND}<div>{ARTICLE}</div></div></body>",
    f"<body>{AROUND}<article class='post comments-open'>{ARTICLE}</article></body>",
    f"<body>{AROUND}<article class='post share'>{ARTICLE}</article></body>",
    f"<body><div id=page class=nav-open>{AROUND}<div>{ARTICLE}</div></div></body>",
    f"<body><form id=f action=/><div>{AROUND}{ARTICLE}</div></form></body>",
    f"<body><form><div class=widget>{AROUND}<article class='post social'>{ARTICLE}</article></div></form></body>",
])
def test_marks_on_what_wraps_the_text_do_not_drop_it(page):
    assert main_text(page) == f"Title {PROSE} Short. {PROSE}"


@pytest.mark.parametrize("around", [
    f"<div id=comments>{f'<article class=comment><h1>x</h1><p>{PROSE}</p></article>' * 9}</div>",
    f"<div class='post-comments'>{f'<article><p>{PROSE}</p></article>' * 30}</div>",
    f"<div class='sidebar-right'><h1>More</h1>{f'<p>{PROSE}</p>' * 9}</div>",
    f"<form><p>{PROSE}</p></form>", f"<div class=wrapper hidden>{f'<p>{PROSE}</p>' * 9}</div>",
])
@pytest.mark.parametrize("text", ["<article>{}</article>", "<div>{}</div>"])
def test_long_surroundings_still_go(around, text):
    assert main_text(f"<body>{text.format(ARTICLE)}{around}</body>") == f"Title {PROSE} Short. {PROSE}"
    assert main_text(f"<body><div class=layout-sidebar>{around}{text.format(ARTICLE)}</div></body>") == f"Title {PROSE} Short. {PROSE}"


TEASER = f"<article class=teaser><h3><a href=/x>More</a></h3><p>{PROSE}</p></article>"


@pytest.mark.parametrize("page", [
    f"<body>{AROUND}<main>{ARTICLE}</main><section>{TEASER * 5}</section></body>",
    f"<body>{AROUND}<main>{ARTICLE}<section>{TEASER * 5}</section></main></body>",
    f"<body><section>{TEASER * 5}</section><main>{ARTICLE}</main></body>",
    f"<body><main>{ARTICLE}<article><p>Short teaser.</p></article></main></body>",
    f"<body><main><article><p>A</p></article><div>{ARTICLE}</div></main></body>",
])
def test_main_with_teasers_keeps_the_text_and_not_the_teasers(page):
    assert main_text(page) == f"Title {PROSE} Short. {PROSE}"


@pytest.mark.parametrize("page", [
    f"<main><p>Short words above.</p><article>{ARTICLE}</article><p>And below.</p></main>",
    f"<main>{AROUND}<article>{ARTICLE}</article></main>{TEASER.replace('teaser', 'comment')}",
])
def test_article_in_main_keeps_its_text(page):
    assert main_text(page) == f"Title {PROSE} Short. {PROSE}"


@pytest.mark.parametrize("name", ["social-history", "legal-analysis", "menu", "search-methods"])
def test_sections_named_after_their_subject_stay(name):
    section = f"<section class={name}><h2>Part</h2><p>{PROSE}</p></section>"
    assert main_text(f"<article>{ARTICLE}{section}</article>") == f"Title {PROSE} Short. {PROSE} Part {PROSE}"
    links = f"<div class={name}><a href=/1>{PROSE}</a></div><div class={name}>Share this</div><div class=ad>{PROSE}</div>"
    assert main_text(f"<article>{ARTICLE}{links}</article>") == f"Title {PROSE} Short. {PROSE}"
    assert main_text(f"<article>{ARTICLE}</article>{section}") == f"Title {PROSE} Short. {PROSE}"


def test_article_without_stop_words_is_kept():
    assert main_text("<nav>the of and</nav><article><p>xx | yy | zz</p></article>") == "xx | yy | zz"


def test_torn_and_deep_markup_takes_linear_time():
    assert main_text("<div class='a" * 20_000) == ""
    assert main_text("<b>" * 100_000 + "x") == "x"
    assert len(blocks_of("<p>y" * 50_000)) == 50_000


def test_given_pages_equal_their_article(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    out = extract(pages.withColumnRenamed("url", "text"), "html")
    assert out.columns == ["page_id", "html", "text", "n_chars"]
    for found in out.collect():
        article = re.search(r"<article>(.*)</article>", found.html, re.S)[1]
        article = re.sub(r"</?b>", "", article)
        expected = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert (found.text, found.n_chars) == (expected, len(expected))


def test_odd_rows_stay_one_for_one(odd, empty):
    out = extract(odd.withColumnRenamed("text", "html"))
    assert out.count() == odd.count() and out.where("html IS NULL AND text <> ''").count() == 0
    assert extract(empty.withColumnRenamed("text", "html")).collect() == []
