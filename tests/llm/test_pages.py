"""Pages whose authors leave out end tags, use formulas or write telling words into attributes."""

import time

import pytest

from lakeloom.llm import html_extraction


def texts(page):
    return [b[3] for b in html_extraction.blocks_of(page)]


def test_head_without_end_tag():
    body = "<body><article><h1>Tea</h1><p>One two.</p></article>"
    assert texts("<html><head><title>t</title>" + body) == texts("<html><head><title>t</title><style>p{}</style></head>" + body) == ["Tea", "One two."]


@pytest.mark.parametrize("tag", sorted(html_extraction.PAIRED))
def test_elements_without_end_tag(tag):
    assert texts(f"<p>One</p><{tag} id='x'><p>Two</p>") == ["One", "Two"]
    assert texts(f"<p>One</p><{tag}><p>Two</p><{tag}>gone</{tag}><p>Three</p>") == ["One", "Two", "Three"]
    assert texts(f"<p>One</p><{tag}>gone<{tag}>gone</{tag}>gone<!-- <{tag}> --></{tag.upper()} ><p>Two</p>") == ["One", "Two"]
    assert texts(f"<p>One</p><{tag}/><p>Two</p>") == ["One", "Two"]


@pytest.mark.parametrize("tag", sorted(html_extraction.TO_END))
def test_elements_that_run_to_the_end(tag):
    assert texts(f"<p>One</p><{tag}>gone<p>gone</p>") == ["One"] and texts(f"<p>One</p><{tag}><p>gone</{tag}><p>Two") == ["One", "Two"]


def test_formulas_are_text():
    assert texts("<p>So <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds.</p>") == ["So x = 2 holds."]


def test_many_unclosed_elements():
    assert len(texts("<svg><p>x</p>" * 20_000)) == 20_000


def test_pages_reach_the_result(spark):
    rows = [(1, "u", "<html><head><title>t</title><body><nav><a href='/'>Home</a></nav><article><h1>Tea</h1><p>It holds that <math><mi>a</mi></math> is even, as shown.</p></article>")]
    (got,) = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert got.text == "Tea\n\nIt holds that a is even, as shown."


def test_hidden_is_an_attribute():
    seen = ["data-title='The hidden river'", 'aria-label="our hidden valley"', 'class="md hidden lg"', 'class="hidden"', 'style="display:block"', 'style="x-display:none"', 'aria-hidden="false"', "data-hidden=true", 'title="display:none"', "style='display:none; display:flex'", "title='a aria-hidden=true'", "", 'alt="hidden"']
    gone = ["hidden", 'class="a" hidden', "HIDDEN=''", 'hidden="until-found"', "aria-hidden=true", 'ARIA-HIDDEN = "True"', 'style="color:red; display : none"', "style=display:none", "style='display:none!important'", "id=x hidden/"]
    assert [html_extraction.hidden(" " + a) for a in seen] == [False] * len(seen) and [html_extraction.hidden(" " + a) for a in gone] == [True] * len(gone)


def test_hidden_blocks_reach_the_field(spark):
    blocks = html_extraction.blocks_of("<article hidden><p>One</p></article><div class='hidden'><p>Two</p></div>")
    assert [b[3] for b in blocks] == ["One", "Two"]
    assert [f"class:{html_extraction.HIDDEN}" in f for f in html_extraction.features_of(blocks)] == [True, False]
    prose = "The river runs through the valley, as it always did. Nobody knows its source."
    pages = [f'<nav><a href="/">Home</a></nav><article data-title="The hidden river"><h1>Tea</h1><p>{prose}</p></article>', f'<article><h1>Tea</h1><p>{prose}</p></article><div class="modal" aria-hidden="true"><p>Subscribe to us</p></div>']
    got = html_extraction.extract_text(spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")).collect()
    assert [x.text for x in got] == [f"Tea\n\n{prose}"] * 2
    field = html_extraction.train(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "html")
    assert field.weights[field.index[f"class:{html_extraction.HIDDEN}"]] < 0


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p>a</p><script src="a.js"/>window.x = 1; load(all);</script><p>b', ["a", "b"]),
        ("<p>a</p><style media=all/>p {..}</style><p>b", ["a", "b"]),
        ("<script async src=https://cdn.example/x/>track(1);</script><p>b", ["b"]),
        ("<p>a</p><textarea/>gone</textarea><p>b", ["a", "b"]),
        ("<p>a<iframe src=x/>gone</iframe>b<p>c", ["a b", "c"]),
        ("<p>a<svg/>b<svg class=a/>gone</svg>c", ["a b c"]),
        ("<p>a<!-- x --!>b</p><p>c</p>", ["ab", "c"]),
        ("<p>a<!-->b<!--->c<!---->d<!----!>e<!-- -- > -->f</p>", ["abcdef"]),
        ('<script><!-- document.write("<script>x</script>"); --></script><p>b', ["b"]),
        ("<script><!-- x <script> </script><p>b", ["b"]),
        ("<script>if (a<!--b) {}</script><p>b<script><!-- <script></script><p>c", ["b", "c"]),
        ("<SCRIPT>'</scripts>'</ScRiPt\n a='>'><p>b", ["b"]),
        ("<style>x</style/><p>b", ["b"]),
        ("<p>x <a href=http://e.x/y/>link</a> z", ["x link z"]),
        ('<p title=a"b>x</p><p a=b"c>d" e>f', ["x", 'd" e>f']),
        ("<p a = \"x>y\" b>z<p a=''b=\"c>\">w", ["z", "w"]),
    ],
)
def test_tokenizer_states(page, want):
    """Raw text, values and comments end where HTML says that they do."""
    assert texts(page) == want


def test_scripts_with_slashes_reach_no_result(spark):
    script = '<script src="a.js"/>window.x = 1; load(all);</script><style media=all/>p {..}</style><script async src=https://cdn.example/x/>track(1);</script>'
    rows = [(1, "u", f"<body>{script}<article><h1>Tea</h1>{script}<p>The river runs<!-- x --!> through the valley, as it always did.</p>{script}</article>")]
    (got,) = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert got.text == "Tea\n\nThe river runs through the valley, as it always did."


def test_broken_tags():
    assert texts('<p class="x>Two</p>') == ["Two"] and texts("<p title=it's>One</p><p>Two's</p>") == ["One", "Two's"]
    assert texts('<p class="a > b" id=\'">\'>One</p>') == ["One"] and texts("<p>1 < 2 and 3 > 2</p><p>a<b") == ["1 < 2 and 3 > 2", "a<b"]
    assert texts("<p>One<![CDATA[ gone <p> ]]> two</p><!-- <p>gone --><p>Three<!-- gone") == ["One two", "Three"]
    assert texts("<p>One <! p> two<?x y?></p><![CDATA[ <p>Three") == ["One two", "Three"]


@pytest.mark.parametrize("piece", ["<a ", "<a", "<a '", '<a ">" ', "<a x='>' ", "<a x=\"'\" ", "<![CDATA[ >", "<!", "<iframe ", "<svg x='", "<!--", "<p class=x", "<div>x", "<div class=a>x", "<p>x<li>", "<script", "&", "= ", "class ", "<script><!--<script></script>", "<script><!--", "<!--!>", "<!-- --", "<p a=/", "<p a='b'/ ", "<p =", '<p "x>', "<title>", "</script", "<p a=b/>"])
def test_hostile_pages_take_linear_time(piece):
    """A megabyte of each; repeats of the whole with an end that tags could wait for."""
    began = time.process_time()
    for page in (piece * (1_000_000 // len(piece)), piece * (200_000 // len(piece)) + ">", "<p " + piece * (200_000 // len(piece)) + "'\">x"):
        html_extraction.blocks_of(page)
    assert time.process_time() - began < 30


def test_deep_pages():
    found = html_extraction.blocks_of("<article>" + "<div><p>x" * 3000 + "</div>" * 3000 + "<p>y</article><p>z")
    assert [b[3] for b in found] == ["x"] * 3000 + ["y", "z"] and "article" in found[-2][1] and "article" not in found[-1][1]


def test_odd_tables(spark):
    """Empty tables, repeated rows, nulls, and columns named like the operator's own."""
    schema = "page_id long, url string, html string, id long, text string, n_chars long"
    assert not html_extraction.extract_text(spark.createDataFrame([], schema)).collect()
    rows = [(1, "u", "<article><p>One two.</p></article>", 5, "other", 0)] * 2 + [(None, None, None, None, None, None), (2, "u", "", 1, "x", 1)]
    got = html_extraction.extract_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((x.page_id or 0, x.text, x.n_chars) for x in got.collect()) == [(0, "", 0), (1, "One two.", 8), (1, "One two.", 8), (2, "", 0)]
