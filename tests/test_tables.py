"""Queries over tables that hold what the driver's smallest ones lack."""

import gc
import random
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitewarden.operators import robots
from sitewarden.plans import registry
from sitewarden.sources.html import CHUNK, extract, in_chunks

_PAGE = '<!DOCTYPE html><html lang="en"><head><title>{}</title></head><body><a href="{}">x</a><p>text</p></body></html>'


@pytest.fixture
def table(spark, tmp_path):
    def write(*pages):
        spark.createDataFrame(list(pages), "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
        return str(tmp_path)

    return write


def test_issue_diff_of_pages_that_share_a_url(spark, table):
    page = lambda i: (i, f"https://h.example/{i}", _PAGE.format("t", "/A_b"))
    got = registry.queries()["issue_diff"](spark, table(page(0), page(1), page(2), page(3))).collect()
    assert sorted((r.bucket, r.code) for r in got) == sorted((b, c) for b in ("new", "new", "persisting", "resolved") for c in ("url-underscore", "url-uppercase"))


def test_page_diff_of_pages_that_share_a_url(spark, table):
    got = registry.queries()["page_diff"](spark, table((0, "u", ""), (1, "u", ""), (2, "u", ""), (3, "u", ""), (5, "v", ""))).collect()
    assert sorted(tuple(r) for r in got) == [("added", "u"), ("added", "u"), ("removed", "u")]


def test_title_with_references_cut_short(spark, table):
    titles = ["fish &amp; chips", "fish &amp; chips&amp", "fish &quot", "a&ampb and &am", "a & b &copy;"]
    rows = [(i, f"https://h.example/{i}", _PAGE.format(t, "/")) for i, t in enumerate(titles)]
    got = {r.page_id: r.title_length for r in registry.queries()["seo_title_band"](spark, table(*rows)).collect()}
    assert got == {0: 12, 1: 16, 2: 10, 3: 14, 4: 7}
    assert extract(_PAGE.format("chips&amp", "/"), "https://h.example/")["title_head_first"] == "chips&"  # HTML's reading stays


def test_robots_verdicts_by_joins(spark):
    """What ``allowed`` says of a path and its host's rules, without pairing each path with each rule."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    rule = lambda: f"{rng.choice(['Allow', 'Disallow'])}: " + "*".join(word(rng.randint(0, 3)) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "$"])
    body = lambda n: "\n".join(f"User-agent: {a}\n" + "\n".join(rule() for _ in range(n)) for a in ("*", "bot", "botany"))
    files = [("http", "h", 200, body(60)), ("http", "few", 200, body(3)), ("https", "h", 200, "User-agent: other\nDisallow: /"), ("http", "down", 503, ""), ("http", "none", 404, ""), ("http", "star", 200, "User-agent: *\nDisallow: *\nAllow: $")]
    known = robots.with_rules(spark.createDataFrame(files, "scheme string, host string, status int, body string"))
    paths = spark.createDataFrame([(p,) for p in {"/" + word(rng.randint(0, 7)) for _ in range(300)} | {""}], "path string")
    for agent in ("bot/1", "BotAny", "else"):
        each = paths.crossJoin(known.select("scheme", "host", F.struct(*known.columns).alias("r")))
        want = {(r.scheme, r.host, r.path): r.ok for r in each.select("scheme", "host", "path", robots.allowed(F.col("path"), F.lit(agent)).alias("ok")).collect()}
        asked = each.select("scheme", "host", "path")
        got = robots.verdicts(asked.unionAll(asked), known, agent).collect()
        assert len(got) == len(want) and {(r.scheme, r.host, r.path): r.ok for r in got} == want


def test_groups_of_a_robots_file(spark):
    """Groups as they are written, and a file of many rules read without copying what is read so far for each line."""
    body = "Disallow: /early\nUser-agent: A\nCrawl-delay: 1\nuser-agent: b # c\nAllow:\nDisallow: /x:y\nSitemap: s\nallow: /z\n\nUser-agent:\nUser-agent: c\r\nDisallow: /q"
    known = robots.with_rules(spark.createDataFrame([("http", "h", 200, body)], "scheme string, host string, status int, body string"))
    got = [(r.agent, r.allow, r.head) for r in known.collect()[0].rules]
    assert sorted(got) == [("", False, "/q"), ("a", False, "/x:y"), ("a", True, "/z"), ("b", False, "/x:y"), ("b", True, "/z"), ("c", False, "/q")]
    assert "aggregate(" not in known._jdf.queryExecution().optimizedPlan().toString()


def test_few_pages_are_objects_at_once():
    class Row(dict):
        pass

    held, count = [], [0]

    def rows():
        for i in range(10 * CHUNK + 1):
            row = Row(a=i)
            held.append(weakref.ref(row))
            count.append(sum(x() is not None for x in held))
            yield row

    got = in_chunks(rows(), pa.struct([("a", pa.int64())]))
    assert got.field("a").to_pylist() == list(range(10 * CHUNK + 1)) and max(count) <= 2 * CHUNK


def test_a_page_goes_with_its_last_reference():
    """Trees are not left to the collector, which comes late when few objects stay."""
    from sitewarden.sources import html

    gc.collect()
    gc.disable()
    try:
        for _ in range(3):
            extract(_PAGE.format("t", "/") * 3, "https://h.example/")
        assert not [x for x in gc.get_objects() if isinstance(x, html.Node)]
    finally:
        gc.enable()


def test_pages_are_parsed_once(spark, table):
    """Rules across pages share one HTML pass."""
    rows = [(i, f"https://h.example.org/{i}", _PAGE.format("t", "/")) for i in range(8)]
    for name in ("duplicate_groups", "content_thin_low", "site_tree", "site_audited"):
        plan = registry.queries()[name](spark, table(*rows))._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan, name
