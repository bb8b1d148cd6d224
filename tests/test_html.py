import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewarden.functions.text import collapse_py, fields
from sitewarden.sources.html import canonical, extract, parse, resolve
from sitewarden.sources.spans import QUOTABLE, Spans

URL = "https://a.example/dir/page"


def test_implied_structure():
    page = parse("<title>T</title><p>one<p>two<ul><li>a<li>b</ul>")
    head, body = page.root.children
    assert page.text(head) == "T"
    assert [n.tag for n in body.children] == ["p", "p", "ul"]
    assert page.text(body) == "onetwoab"


def test_text_has_no_separators_and_entities_are_decoded():
    f = extract("<body><ul><li>a</li><li>b</li></ul><!-- c -->d&amp;e</body>", URL)
    assert f["body_words"] == 1
    assert f["prose_words"] == 1


def test_truncated_page_and_script_traps():
    f = extract('<html><head><script>var t="</p>";</script><title>x</title></head><body><b><p>one two', URL)
    assert (f["title_head_first"], f["body_words"]) == ("x", 2)


def test_links_are_resolved_once():
    f = extract("<a href='../x/'>1</a><a href='/x'>2</a><a href='#f'>3</a><a href='mailto:a@b'>4</a><a href='//b.example/y' rel='nofollow'>5</a>", URL)
    assert [(a["url"], a["resolved"], a["external"], a["nofollow"]) for a in f["anchors"]] == [
        ("https://a.example/x", "https://a.example/x/", False, False),
        ("https://b.example/y", "https://b.example/y", True, True),
    ]
    assert resolve(URL, "http://[bad") is None
    assert canonical("HTTP://A.example:80/p/", False) == "http://a.example/p"


def test_questions_count_element_siblings_only():
    f = extract("<h2>What?</h2>bare<p>one two</p><h3>No</h3><p>x</p>", URL)
    assert f["questions"] == [{"text": "What?", "answer_words": 2}]


def test_structured_data():
    f = extract('<script type="application/ld+json">[{"@type":["Product","X"],"name":""},{"@graph":[{"@type":"Event","name":"e","startDate":"d"}]}]</script><script type="application/ld+json">{</script>', URL)
    assert f["jsonld_types"] == ["Product", "X", "Event"]
    assert f["jsonld_missing"] == [{"type": "Product", "missing": ["name"]}]
    assert (f["jsonld_blocks"], f["jsonld_errors"]) == (2, 1)


def test_empty_page():
    f = extract("", URL)
    assert f["body_words"] == 0 and f["content_hash"] is None and f["anchors"] == []


def test_deep_pages_take_linear_time():
    def seconds(n):
        deep = "<div><p>x" * n + "<a href=/b>t</a>" + "<h2>Why?</h2><p>So.</p>" * (n // 10) + '<script type="application/ld+json">' + "[" * n + "</script>"
        began = time.process_time()
        got = extract(deep, "https://a.example/")
        assert len(got["questions"]) == n // 10 and got["anchors"] and got["jsonld_errors"] == 1
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.1)


def test_text_without_scripts():
    page = parse("<body>a<code>b<pre>c</pre></code>d<style>e</style>f")
    assert page.text_without(page.root, frozenset(("code", "pre", "style"))) == "adf"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1 2,.$%\n\xa0é€_", max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=6))
def test_counts_over_slices(text, slices):
    """Words and data points of any slices, overlapping or not, are those of the text they make."""
    slices = [(min(a, b, len(text)), min(max(a, b), len(text))) for a, b in slices]
    made, spans = "".join(text[a:b] for a, b in slices), Spans(text)
    assert spans.joined_words(slices) == len(fields(made))
    assert spans.joined_points(slices) == len(QUOTABLE.findall(collapse_py(made)))
    assert [spans.words(a, b) for a, b in slices] == [len(fields(text[a:b])) for a, b in slices]


NESTED = {
    "li": "<ul><li>some words here 12 of 5 % ", "h2": "<div><h2>What?</h2>so ", "bare h2": "<h2>What is it?", "blockquote": "<blockquote><p>it is 7 $ 3 ", "a": "<a href=/{i}>text ", "table": "<table><tr><td>cell 1,000 ",
    "question list": "<ul><li><h3>Why?</h3><p>for 1 ", "links in blocks": "<div><a href=/{i}>go</a> ", "div": "<div class=breadcrumb><b>x ",
}


@pytest.mark.parametrize("kind", NESTED)
def test_deep_pages_of_a_megabyte(kind):
    unit = NESTED[kind]
    n = (1 << 20) // len(unit)
    html = "".join(unit.replace("{i}", str(i)) for i in range(n))
    began = time.process_time()
    f = extract(html, "https://a.example/")
    assert time.process_time() - began < 6 and f["body_words"] >= n / 2  # a second or two on a free core


def test_nested_items_count_at_each_level():
    """The texts of nested items are counted once a level, as they are when each is taken by itself."""
    rng = random.Random(2)
    for _ in range(50):
        html = "".join(rng.choice(["<ul>", "<li>", "<p>", "</li>", "</ul>", "1,5 ", "word", " ", "$3", "%", "<b>9</b>"]) for _ in range(60))
        page = parse(html)
        prose = "".join(map(page.text, page.get("p", "li")))
        f = extract(html, URL)
        assert (f["prose_words"], f["data_points"]) == (len(fields(prose)), len(QUOTABLE.findall(collapse_py(prose))))


def test_links_and_headings_close_each_other():
    f = extract("<a href=/1>one <b>two <a href=/2>three</a></b><h2>first<h3>second</h3>", URL)
    assert [(a["href"], a["anchor"]) for a in f["anchors"]] == [("/1", "one two"), ("/2", "three")]
    assert [(h["level"], h["text"]) for h in f["headings"]] == [(2, "first"), (3, "second")]
