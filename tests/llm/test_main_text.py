import html.parser
import time

import pytest

from loomdoc.llm import htmlmain

CFG = htmlmain.Config()
PROSE = "Words of prose that go on for long enough to be the text of an article, in full sentences. " * 3


@pytest.mark.parametrize("unit", ["<script ", "<a ", '<a "', '<a ">" ', "<a '\">", '<p class="', "<!--x ", "<!", "<div>", "<span class=ad>", "</section><div>", "<script></script ", "<div class=x><p class=y>"])
def test_broken_pages_take_linear_time(unit):
    page = f"<body><article><p>{PROSE}</article>" + unit * (1_000_000 // len(unit))
    start = time.monotonic()
    found = htmlmain.Page(page)
    assert found.text(None, CFG).startswith(PROSE.strip())
    assert time.monotonic() - start < 20
    assert sum(map(len, found.path)) < 500 * 1_000_000


def test_end_tags_of_other_names_take_linear_time():
    start = time.monotonic()
    for a, b in (("<div>", "</section>"), ("<span class=ad>", "</b>"), ("<span class=ad>", "</span>")):
        htmlmain.Page(a * 50_000 + b * 50_000)
    assert time.monotonic() - start < 20


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a <b title='x > y'>b</b> c", "a b c"),
        ('one <b title="x>two</b> three', "one two three"),
        ("one <b 'x>two <i>three", "one two three"),
        ("one <!-- two > -->three", "one three"),
        ("one <!-- two <p> three", "one"),
        ("one <script>two</scrip></SCRIPT >three", "one three"),
        ("one <script>two", "one"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("one <b two", "one <b two"),
    ],
)
def test_tags(text, want):
    assert " ".join(t for _, t, _ in htmlmain.Page(text).blocks) == want


@pytest.mark.parametrize(
    ("piece", "kept"),
    [
        ("<p class=share-price>The price of a share fell by ten.</p>", True),
        ("<p id=social-history>Their history is told here.</p>", True),
        ("<div class='search-results-study'><p>The study searched for results.</p></div>", True),
        ("<p>It cost <span class=share-price>12.50</span> then.</p>", True),
        ("<div class=share-links><a href=a>One</a> <a href=b>Two</a></div>", False),
        ("<ul class='related-posts'><li><a href=a>Another post</a><li><a href=b>And one more</a></ul>", False),
        ("<p>Well. <a class=share-link href=x>Tell it</a></p>", None),
        ("<p class=share>Tell it</p>", False),
        ("<p class=cookie-hint>We keep cookies.</p>", False),
    ],
)
def test_names_that_are_words_of_prose_do_not_decide(piece, kept):
    text = htmlmain.Page(f"<html><body><main><p>{PROSE}</p>{piece}<p>The end.</p></main></body></html>").text(None, CFG)
    parts: list[str] = []
    parser = html.parser.HTMLParser()
    parser.handle_data = parts.append
    parser.feed(piece)
    inside = {True: " ".join("".join(parts).split()), False: "", None: "Well."}[kept]
    assert text == " ".join(f"{PROSE} {inside} The end.".split())


def test_named_paragraphs_of_a_host(spark):
    page = "<html><body><main><p>{0}</p><p class=share-price>The price of {0} fell.</p><p class=related-note>Read our magazine, each week.</p></main></body></html>"
    rows = [(i, f"http://h/{i}", page.format(f"Number {i} of the pages. {PROSE}")) for i in range(20)]
    for r in htmlmain.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert "The price of Number" in r.text and "magazine" not in r.text
