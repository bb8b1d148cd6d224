"""Pages made to show one code each, and what the rules must say of them.

Every case has a host named after its code, with a page just inside the rule
(``/hit``) and, where there is an edge, one just outside (``/miss``). Expected
rows are written down from the rules' definitions, never from a run.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl_rules, robots, sitemaps
from ..sources import schema
from . import audit

_RENDER = dict(implemented=True, note="", raw_fallback=False, rendered_bytes=900, raw_bytes=900, lcp_ms=1.0, fcp_ms=1.0, cls=0.01, tbt_ms=1.0, ttfb_ms=1.0, data_layer_present=True, data_layer=['{"event":"page_view"}'], requests=[])
_WORDS = " ".join(["word"] * 130)
_GTM = "<script src='https://www.googletagmanager.com/gtm.js?id=GTM-AB1'></script>"


def _html(title: str = "A title of good length", description: str = "d" * 80, head: str = "", body: str = f"<h1>Head</h1><p>{_WORDS}</p>", lang: str = "en") -> str:
    described = f'<meta name="description" content="{description}">' if description else ""
    return f'<!doctype html><html lang="{lang}"><head><title>{title}</title><meta charset="utf-8">{described}{head}</head><body>{body}</body></html>'


def _head(**tags: str) -> str:
    return _html(head="".join(tags.values()))


_LINKS = '<link rel="canonical" href="https://a.example/">'
_LD = '<script type="application/ld+json">{}</script>'
_ARTICLE = f"<h1>News</h1><article><p>{' '.join(['word'] * 320)}</p></article>"
_BY = '<meta property="article:author" content="Ann">'


def _sale(keys: dict) -> list[str]:
    return ['{"event":"page_view"}', json.dumps({"event": "purchase"} | keys)]


_FULL = {"transaction_id": "T1", "value": 9.5, "currency": "EUR", "items": [{"item_id": "1"}]}

#: code, severity, data of the hit, the hit, the miss: fields of ``schema.PAGES`` that differ from a good page; ``path`` goes before the query.
PAGES: list[tuple] = [
    ("seo-short-meta-description", "info", {"length": 49}, {"html": _html(description="é" * 49)}, {"html": _html(description="é" * 50)}),
    ("seo-long-meta-description", "info", {"length": 161}, {"html": _html(description="é" * 161)}, {"html": _html(description="é" * 160)}),
    ("seo-x-robots-noindex", "warning", {"x_robots_tag": "NoIndex"}, {"headers": {"X-Robots-Tag": ["NoIndex"]}}, {"headers": {"X-Robots-Tag": ["nofollow"]}}),
    ("seo-x-robots-nofollow", "info", {"x_robots_tag": "nofollow"}, {"headers": {"X-Robots-Tag": ["nofollow"]}}, {"headers": {"X-Robots-Tag": ["noindex"]}}),
    ("seo-meta-refresh", "warning", {"content": "0;url=/x"}, {"html": _head(a='<meta http-equiv="refresh" content="0;url=/x">')}, {"html": _head(a='<meta http-equiv="refresh" content=" ">')}),
    ("seo-multiple-canonical", "warning", None, {"html": _head(a=_LINKS, b=_LINKS)}, {"html": _head(a=_LINKS)}),
    ("http-redirect-chain", "warning", {"hops": 2, "chain": ["https://http-redirect-chain.example/hit", "https://b.example/", "https://c.example/"]},
     {"redirects": [("https://http-redirect-chain.example/hit", "https://b.example/", 301), ("https://b.example/", "https://c.example/", 302)]}, {"redirects": [("https://a.example/", "https://c.example/", 301)]}),
    ("http-redirect-loop", "error", {"chain": ["https://http-redirect-loop.example/hit", "https://b.example/", "https://http-redirect-loop.example/hit"]},
     {"redirects": [("https://http-redirect-loop.example/hit", "https://b.example/", 301), ("https://b.example/", "https://http-redirect-loop.example/hit", 302)]}, {}),
    ("http-slow-response", "warning", {"duration_ms": 2001}, {"duration_ms": 2001}, {"duration_ms": 2000}),
    ("http-server-error", "error", {"status": 500}, {"status_code": 500}, {"status_code": 499}),
    ("http-client-error", "error", {"status": 404, "found_on": "https://from.example/"}, {"status_code": 404, "referrer": "https://from.example/"}, {"status_code": 399}),
    ("structured-product-candidate", "warning", {"signal": "$19.99"}, {"html": _html(body="<p>Only $19.99, add to cart</p>")}, {"html": _html(head=_LD.format('{"@type":"Product"}'), body="<p>Only $19.99, add to cart</p>")}),
    ("landing-keyword-mismatch", "warning", {"campaign_terms": ["red", "shoes"], "matched": [], "missing": ["red", "shoes"], "coverage": 0.0}, {"path": "?utm_term=red+shoes"}, {"path": "?utm_term=good+shoes"}),
    ("landing-keyword-weak", "info", {"campaign_terms": ["title", "red", "blue"], "matched": ["title"], "missing": ["red", "blue"], "coverage": 0.33}, {"path": "?utm_term=title+red+blue"}, {"path": "?utm_term=title+red"}),
    ("landing-keyword-aligned", "info", {"campaign_terms": ["title", "red"], "matched": ["title"], "missing": ["red"], "coverage": 0.5}, {"path": "?utm_campaign=title-red"}, {"path": "?utm_campaign=title+red+blue"}),
    ("http-body-truncated", "warning", None, {"truncated": True}, {}),
    ("perf-cwv-render-failed", "info", {"note": "timeout"}, {"render": _RENDER | {"implemented": False, "note": "timeout"}}, {"render": _RENDER | {"implemented": False}}),
    ("perf-render-incomplete", "warning", {"rendered_bytes": 10, "raw_bytes": 900}, {"render": _RENDER | {"raw_fallback": True, "rendered_bytes": 10}}, {}),
    *(
        (f"perf-{name}-{kind}", severity, {f"value{unit}": over, f"threshold{unit}": float(limit)}, {"render": _RENDER | {f"{name}{unit}": over}}, {"render": _RENDER | {f"{name}{unit}": float(limit)}})
        for name, kind, severity, over, limit, unit in [
            ("lcp", "needs-improvement", "warning", 2501.0, 2500, "_ms"), ("lcp", "poor", "error", 4001.0, 4000, "_ms"), ("fcp", "needs-improvement", "warning", 1801.0, 1800, "_ms"), ("fcp", "poor", "error", 3001.0, 3000, "_ms"),
            ("cls", "needs-improvement", "warning", 0.11, 0.1, ""), ("cls", "poor", "error", 0.26, 0.25, ""), ("tbt", "needs-improvement", "warning", 201.0, 200, "_ms"), ("tbt", "poor", "error", 601.0, 600, "_ms"),
            ("ttfb", "needs-improvement", "warning", 801.0, 800, "_ms"), ("ttfb", "poor", "error", 1801.0, 1800, "_ms"),
        ]
    ),
    ("aeo-answer-schema", "info", {"types": ["FAQPage", "Question"]}, {"html": _head(a=_LD.format('{"@type":"FAQPage","mainEntity":[{"@type":"Question"}]}'))}, {"html": _head(a=_LD.format('{"@type":"Product"}'))}),
    ("geo-missing-author", "info", None, {"html": _html(body=_ARTICLE)}, {"html": _html(head=_BY, body=_ARTICLE)}),
    ("geo-missing-date", "info", None, {"html": _html(head=_BY, body=_ARTICLE)}, {"html": _html(head=_BY, body=_ARTICLE + '<time datetime="2024-01-01">then</time>')}),
    ("geo-js-dependent-content", "info", {"rendered_words": 320, "raw_words": 1}, {"html": _html(body=_ARTICLE), "raw_html": "<p>wait</p>"}, {"html": _html(body=_ARTICLE), "raw_html": _html(body=_ARTICLE)}),
    ("landing-noindex", "error", {"robots": "NOINDEX"}, {"path": "?utm_medium=cpc", "html": _head(a='<meta name="robots" content="NOINDEX">')}, {"path": "?utm_medium=cpc"}),
    ("landing-missing-title", "warning", None, {"path": "?utm_medium=cpc", "html": _html(title=" ")}, {"path": "?utm_medium=cpc"}),
    ("landing-missing-h1", "warning", None, {"path": "?utm_medium=cpc", "html": _html(body=f"<p>{_WORDS}</p>")}, {"path": "?utm_medium=cpc"}),
    ("landing-missing-description", "info", None, {"path": "?utm_medium=cpc", "html": _html(description="")}, {"path": "?utm_medium=cpc"}),
    ("datalayer-empty", "warning", None, {"html": _head(a=_GTM), "render": _RENDER | {"data_layer": [], "data_layer_present": False}}, {"html": _head(a=_GTM)}),
    ("datalayer-page-view-missing", "warning", None, {"html": _head(a=_GTM), "render": _RENDER | {"data_layer": ['{"event":"click"}']}}, {"html": _head(a=_GTM), "render": _RENDER | {"data_layer": ['{"event":"gtm.js"}']}}),
    ("datalayer-ecommerce-event-invalid", "warning", {"event": "purchase", "missing": ["currency", "items"]}, {"html": _head(a=_GTM), "render": _RENDER | {"data_layer": _sale({"transaction_id": "T1", "value": 9.5})}}, {"html": _head(a=_GTM), "render": _RENDER | {"data_layer": _sale(_FULL)}}),
]


def _row(n: int, url: str, given: dict) -> dict:
    path = given.get("path", "")
    at = url + path
    return dict(
        page_seq=n, requested_url=at, final_url=at, status_code=200, headers=None, content_type="text/html", html=_html(), raw_html=None, redirects=[], depth=0, referrer="",
        duration_ms=0, err="", truncated=False, render=_RENDER,
    ) | {k: v for k, v in given.items() if k != "path"}


def _pages(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.name for c in spark.createDataFrame([], schema.PAGES).schema]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema.PAGES)


def page_cases(spark: SparkSession) -> DataFrame:
    """``code, url, severity, data`` of what each case page is made for."""
    rows = []
    for code, _, _, hit, miss in PAGES:
        rows += [_row(len(rows) + i, f"https://{code}.example/{name}", given) for i, (name, given) in enumerate((("hit", hit), ("miss", miss)))]
    made = audit.prepare(_pages(spark, rows))
    found = audit.audit(made, audit.Options(enabled=["seo", "redirects", "perf", "structured", "aeo", "geo", "landing", "datalayer"], seed="https://seed.example/"))
    return found.where(U.hostname(F.col("url")) == F.concat("code", F.lit(".example"))).select("code", "url", "severity", "data")


def _json(data: dict | None) -> str | None:
    return json.dumps(data, separators=(",", ":"), sort_keys=True, ensure_ascii=False) if data else None


def expected_pages() -> list[tuple]:
    return [(code, f"https://{code}.example/hit{hit.get('path', '')}", severity, _json(data)) for code, severity, data, hit, _ in PAGES]


# --- sites: what needs more than one page -----------------------------------

_SEED = "https://site.example/"
_PLUGINS = [f"plugin-{i}" for i in range(9)] + ["polylang"]
_WP = _html(
    head="".join(f'<link rel="stylesheet" href="/wp-content/plugins/{p}/a.css">' for p in _PLUGINS)
    + '<script src="/wp-includes/js/wp-emoji-release.min.js"></script><script src="/wp-includes/js/jquery/jquery-migrate.min.js"></script><!-- Yoast SEO --><!-- Rank Math -->',
    body=f"<h1>Hello</h1><p>Just another WordPress site {_WORDS}</p>",
)
_SOME = {"html": _html(body=f"<h1>Hello</h1><p>{_WORDS}</p>")}

#: Site, analyzers, pages (path, fields), codes that are asked for, expected rows (code, URL, severity, data).
SITES: list[tuple] = [
    ("plain", ["perf", "datalayer"], [("", {"render": None, "duration_ms": 7}), ("slow", {"render": None, "duration_ms": 0})], ["perf-response-time", "perf-cwv-not-collected", "datalayer-not-collected"],
     [("perf-response-time", _SEED, "info", {"duration_ms": 7}), ("perf-cwv-not-collected", _SEED, "info", None), ("datalayer-not-collected", _SEED, "info", None)]),
    ("wordpress", ["wordpress"], [("", {"html": _WP}), ("?attachment_id=7", {}), ("?s=word", {}), ("2024/05/", {}), ("author/ann/", {}), ("2024/05/x", {}), ("?p=4", {}), ("?s=kept", {"headers": {"x-robots-tag": ["noindex"]}})],
     ["wp-emoji-enabled", "wp-jquery-migrate", "wp-many-plugin-assets", "wp-default-tagline", "wp-multiple-seo-plugins", "wp-i18n-no-hreflang", "wp-multilingual-detected", "wp-no-seo-plugin",
      "wp-indexable-attachment", "wp-indexable-search", "wp-indexable-author-archive", "wp-indexable-date-archive", "wp-ugly-permalink"],
     [("wp-emoji-enabled", _SEED, "info", None), ("wp-jquery-migrate", _SEED, "info", None), ("wp-many-plugin-assets", _SEED, "warning", {"plugins": sorted(_PLUGINS), "plugin_count": 10}), ("wp-default-tagline", _SEED, "warning", None),
      ("wp-multiple-seo-plugins", _SEED, "warning", {"plugins": ["Rank Math", "Yoast SEO"]}), ("wp-multilingual-detected", _SEED, "info", {"plugins": ["Polylang"]}), ("wp-i18n-no-hreflang", _SEED, "warning", {"plugins": ["Polylang"]}),
      ("wp-indexable-attachment", _SEED + "?attachment_id=7", "warning", {"id": "7"}), ("wp-indexable-search", _SEED + "?s=word", "warning", None), ("wp-indexable-author-archive", _SEED + "author/ann/", "info", None),
      ("wp-indexable-date-archive", _SEED + "2024/05/", "info", None), ("wp-ugly-permalink", _SEED + "?p=4", "info", {"param": "p"})]),
    ("nine plugins", ["wordpress"], [("", {"html": _WP.replace("/wp-content/plugins/plugin-0/a.css", "/a.css")})], ["wp-many-plugin-assets"], []),
    ("amp", ["amp"], [("", {"html": _head(a='<link rel="amphtml" href="https://site.example/lost">')}), ("lost", {"status_code": 404}), ("good", {"html": _head(a='<link rel="amphtml" href="https://site.example/">')})],
     ["amp-broken-amphtml", "amp-amphtml-linked"], [("amp-broken-amphtml", _SEED, "warning", {"target": "https://site.example/lost"}), ("amp-amphtml-linked", _SEED + "good", "info", {"target": "https://site.example/"})]),
    ("links", ["links"], [("", {"html": _html(body='<a href="/lost">Lost</a><a href="/old">Old</a><a href="/b"></a><a href="https://out.example/" rel="nofollow">Out</a>')}), ("lost", {"status_code": 410}), ("old", {"final_url": _SEED + "new", "redirects": [(_SEED + "old", _SEED + "new", 301)]}), ("b", {"html": _html(body='<a href="/">Home</a>')})],
     ["link-broken", "link-to-redirect", "link-empty-anchor", "link-summary", "link-inbound"],
     [("link-broken", _SEED, "error", {"target": _SEED + "lost", "status": 410, "anchor": "Lost"}), ("link-to-redirect", _SEED, "warning", {"target": _SEED + "old", "final": _SEED + "new"}), ("link-empty-anchor", _SEED, "info", {"count": 1}),
      ("link-summary", _SEED, "info", {"total": 4, "external": 1, "nofollow": 1}), ("link-summary", _SEED + "b", "info", {"total": 1, "external": 0, "nofollow": 0}), ("link-inbound", _SEED, "info", {"count": 1, "anchors": ["Home"]}),
      ("link-inbound", _SEED + "b", "info", {"count": 1, "anchors": []}), ("link-inbound", _SEED + "new", "info", {"count": 1, "anchors": ["Old"]})]),
]


def site_cases(spark: SparkSession) -> DataFrame:
    """``site, code, url, severity, data`` of the codes that each site is made for."""
    out = None
    for name, analyzers, pages, codes, _ in SITES:
        rows = [_row(i, _SEED + path, _SOME | given) for i, (path, given) in enumerate(pages)]
        found = audit.audit(audit.prepare(_pages(spark, rows)), audit.Options(enabled=analyzers, seed=_SEED))
        found = found.where(F.col("code").isin(codes)).select(F.lit(name).alias("site"), "code", "url", "severity", "data")
        out = found if out is None else out.unionAll(found)
    return out


def expected_sites() -> list[tuple]:
    return [(name, code, url, severity, _json(data)) for name, *_, rows in SITES for code, url, severity, data in rows]


# --- files beside the pages -------------------------------------------------

_MAP = b"<urlset><url><loc>https://site.example/</loc></url></urlset>"
#: Probe, path, status, final URL, body, expected code and data.
PROBES: list[tuple] = [
    ("xmlrpc", "xmlrpc.php", 405, "", "XML-RPC server accepts POST requests only.", "wp-xmlrpc-enabled", None),
    ("users", "wp-json/wp/v2/users", 200, "", '[{"slug":"ann","id":1},{"id":2}]', "wp-user-enumeration-rest", {"usernames": ["ann"], "count": 1}),
    ("author", "?author=1", 200, _SEED + "author/ann/", "", "wp-user-enumeration-author", {"username": "ann"}),
    ("uploads", "wp-content/uploads/", 200, "", "<title>Index of /wp-content</title>", "wp-directory-listing", None),
    ("readme", "readme.html", 200, "", "WordPress<br> Version 6.4.2", "wp-readme-exposed", {"version": "6.4.2"}),
    ("xmlrpc", "lost/xmlrpc.php", 404, "", "XML-RPC", None, None),
    ("users", "shut/users", 200, "", "[]", None, None),
    ("uploads", "shut/uploads/", 403, "", "Index of", None, None),
]
#: Status, content type, body, final URL, whether it counts as a content map.
LLMS: list[tuple] = [
    (200, "text/plain", "# Notes", _SEED + "llms.txt", True), (404, "text/plain", "# Notes", _SEED + "llms.txt", False), (200, "text/html", "# Notes", _SEED + "llms.txt", False), (200, "application/xhtml+xml", "# Notes", _SEED + "llms.txt", False),
    (200, "", " <!DOCTYPE html>", _SEED + "llms.txt", False), (200, "", "<?xml version='1.0'?>", _SEED + "llms.txt", False), (200, "", "", _SEED + "llms.txt", False), (200, "text/plain", "# Notes", _SEED, False),
]
#: Name, responses (URL, status, truncated, declared, body), expected codes and URLs.
MAPS: list[tuple] = [
    ("none", [(_SEED + "sitemap.xml", 404, False, False, b"lost")], [("sitemap-missing", _SEED)]),
    ("lost", [(_SEED + "sitemap.xml", 404, False, True, b"lost"), (_SEED + "empty.xml", 200, False, True, b"")], [("sitemap-missing", _SEED)]),
    ("cut", [(_SEED + "sitemap.xml", 200, True, True, b"<urlset><url><loc>")], [("sitemap-truncated", _SEED + "sitemap.xml")]),
    ("broken", [(_SEED + "sitemap.xml", 200, False, True, b"<html>soft 404</html>"), (_SEED + "s.xml", 200, False, False, b"<html>guessed</html>")], [("sitemap-invalid", _SEED + "sitemap.xml"), ("sitemap-missing", _SEED)]),
    ("good", [(_SEED + "sitemap.xml", 200, False, True, _MAP)], [("sitemap-coverage", _SEED)]),
]


def file_cases(spark: SparkSession) -> DataFrame:
    """``kind, code, url, data`` of probes, content maps and sitemaps."""
    probes = spark.createDataFrame([(p, _SEED + at, status, final or _SEED + at, body) for p, at, status, final, body, *_ in PROBES], "probe string, url string, status_code int, final_url string, body string")
    out = crawl_rules.wordpress_probes(probes, _SEED).select(F.lit("probe").alias("kind"), "code", "url", "data")
    for n, (status, kind, body, final, _) in enumerate(LLMS):
        one = spark.createDataFrame([(_SEED + "llms.txt", final, status, kind, body)], "url string, final_url string, status int, content_type string, body string")
        out = out.unionAll(robots.llms_txt(one, _SEED).select(F.lit(f"llms {n}").alias("kind"), "code", "url", "data"))
    pages = audit.prepare(_pages(spark, [_row(0, _SEED, _SOME)]))
    for name, rows, _ in MAPS:
        maps = spark.createDataFrame(rows, "url string, status int, truncated boolean, declared boolean, body binary")
        out = out.unionAll(sitemaps.sitemap_issues(pages, maps, _SEED).select(F.lit(f"map {name}").alias("kind"), "code", "url", F.lit(None).cast("string").alias("data")))
    return out


def expected_files() -> list[tuple]:
    out = [("probe", code, _SEED + at, _json(data)) for _, at, *_, code, data in PROBES if code]
    out += [(f"llms {n}", "geo-llms-txt" if ok else "geo-no-llms-txt", _SEED + "llms.txt", None) for n, (*_, ok) in enumerate(LLMS)]
    return out + [(f"map {name}", code, url, None) for name, _, rows in MAPS for code, url in rows]
