from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitewarden.operators import rules
from sitewarden.operators.catalog import CATALOG
from sitewarden.plans import audit, fixtures, registry
from sitewarden.plans.expected import EXPECTED


@pytest.fixture(scope="module")
def found(spark):
    return registry._fixture_issues(spark).collect()


def test_fixture_crawl(found):
    assert Counter((i.analyzer, i.code, i.severity, i.url) for i in found) == Counter(EXPECTED)


def test_every_code_has_an_entry(found):
    """Building an issue looks its code up, so an unknown code can't even be planned."""
    assert {i.code for i in found} <= set(CATALOG)
    with pytest.raises(KeyError):
        rules.issue("seo", "info", "no-such-code")


def test_order_of_pages_does_not_matter(spark, found):
    options = audit.Options(enabled=["links", "hreflang", "duplicates", "wordpress"], seed=fixtures.SEED)
    mixed = audit.prepare(fixtures.pages(spark).repartition(5, F.rand(1))).persist()
    got = Counter((i.code, i.url, i.data) for i in audit.audit(mixed, options).collect())
    assert got == Counter((i.code, i.url, i.data) for i in found if i.analyzer in options.enabled)


def test_selection():
    assert audit.select(audit.Options(enabled=["seo", "links", "nothing"], disabled=["seo"])) == (["links"], [])
    names, skipped = audit.select(audit.Options(strip_query=True))
    assert skipped == ["utm", "landing", "wordpress"] and "seo" in names


def test_not_collected_without_rendering(spark):
    plain = audit.prepare(fixtures.pages(spark).where("page_seq < 4"))
    codes = {i.code for i in audit.audit(plain, audit.Options(enabled=["perf", "datalayer"], seed="s")).collect()}
    assert {"perf-cwv-not-collected", "datalayer-not-collected", "perf-response-time"} <= codes


def _html(spark, html, **columns):
    row = fixtures.pages(spark).where("page_seq = 12").withColumn("html", F.lit(html)).withColumn("status_code", F.lit(200))
    for k, v in columns.items():
        row = row.withColumn(k, v)
    return audit.prepare(row)


@pytest.mark.parametrize("n, code", [(9, "seo-short-title"), (10, None), (60, None), (61, "seo-long-title"), (0, "seo-missing-title")])
def test_title_bands_count_characters(spark, n, code):
    rows = audit.audit(_html(spark, f"<title>{'ü' * n}</title>"), audit.Options(enabled=["seo"])).collect()
    assert {r.code for r in rows if "title" in r.code} == ({code} if code else set())


def test_wordpress_probes(spark):
    from sitewarden.operators.crawl_rules import wordpress_probes

    probes = spark.createDataFrame(
        [
            ("xmlrpc", "s/xmlrpc.php", 405, "u", "XML-RPC server accepts POST requests only."),
            ("users", "s/u", 200, "u", '[{"slug": "ann", "id": 1}, {"id": 2}]'),
            ("author", "s/a", 200, "https://x/author/ann/", ""),
            ("uploads", "s/p", 200, "u", "<title>Index of /wp-content</title>"),
            ("readme", "s/r", 200, "u", "WordPress Version 6.4.2"),
        ],
        "probe string, url string, status_code int, final_url string, body string",
    )
    rows = wordpress_probes(probes, "s").collect()
    got = {r.code: r.data for r in rows}
    assert {r.code: r.url for r in rows}["wp-xmlrpc-enabled"] == "s/xmlrpc.php"
    assert len(got) == 5 and "ann" in got["wp-user-enumeration-rest"] and "6.4.2" in got["wp-readme-exposed"]


def test_entry_has_queries_and_sql():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 50
