"""A small invented crawl that shows what the driver's pages never contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import schema

SEED = "https://shop.example/"
_HEAD = '<meta charset="utf-8"><meta name="viewport" content="width=device-width"><meta property="og:title" content="x">'
_D = "A description that is long enough to be neither short nor missing, and short enough to fit."


def _page(title: str, body: str, head: str = "", lang: str = "en", amp: str = "") -> str:
    return f'<!doctype html><html lang="{lang}" {amp}><head><title>{title}</title>{_HEAD}<meta name="description" content="{_D} {title}">{head}</head><body>{body}</body></html>'


def _words(n: int, word: str = "word") -> str:
    return " ".join([word] * n)


_TAGS = (
    "<script src='https://www.googletagmanager.com/gtag/js?id=G-ABCD12'></script><script>dataLayer.push({});</script>"
    "<script>window.dataLayer = window.dataLayer || []; gtag('config', 'G-ABCD12'); gtag('config', 'AW-77'); gtag('consent', 'default', {});</script>"
)
_GTM = "<script src='https://www.googletagmanager.com/gtm.js?id=GTM-AB1'></script><script>ga('create','UA-12-1'); x='G-WXYZ9'; y='UA-13-1'; fbq('init', '123456789')</script>"
_HREF = '<link rel="alternate" hreflang="en" href="https://shop.example/en"><link rel="alternate" hreflang="de" href="https://shop.example/de">'
_LD = '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Product","name":" "},{"@type":"Event","name":"x"}]}</script>'

#: seq, requested, final, status, headers, html, redirects, err, duration, render
PAGES: list[tuple] = [
    (
        1, SEED, SEED, 200, {"Strict-Transport-Security": ["max-age=1"], "Content-Security-Policy": ["x"], "X-Content-Type-Options": ["nosniff"]},
        _page("Welcome to the shop", f"<h1>Welcome</h1><p>{_words(150)}</p><a href='/old'>Old</a><a href='/gone'>Gone</a><a href='/en'></a><a href='/de?utm_source=a&UTM_Medium=b'>DE</a>"
              "<a href='https://other.example/?utm_source=a&utm_source=b&utm_medium=&utm_campaign=c' rel='nofollow'>Out</a><img src='a.png'><img src='b.png' alt='' width='1' height='1'>"
              "<form action='http://shop.example/post'></form><img src='http://cdn.example/x.png' alt=''>",
              '<link rel="canonical" href="https://shop.example/"><link rel="next" href="/gone"><link rel="amphtml" href="/amp">'),
        [], "", 2500, None,
    ),
    (2, "https://shop.example/old", "https://shop.example/new", 200, {}, _page("Welcome to the shop", f"<h1>N</h1><h3>Skip</h3><h2></h2><p>{_words(150)}</p>", "<meta name='robots' content='noindex, nofollow'>"),
     [("https://shop.example/old", "https://shop.example/new", 301)], "", 10, None),
    (3, "https://shop.example/gone", "https://shop.example/gone", 404, None, "<html><body>gone</body></html>", [], "", 10, None),
    (4, "https://shop.example/loop", "https://shop.example/loop", 0, None, "", [("https://shop.example/loop", "https://shop.example/b", 302), ("https://shop.example/b", "https://shop.example/loop", 302)], "too many redirects", 10, None),
    (5, "https://shop.example/err", "https://shop.example/err", 0, None, "", [], "timeout", 10, None),
    (6, "https://shop.example/en", "https://shop.example/en", 200, None, _page("English version", f"<h1>How do I pay?</h1><h2>What is it?</h2><p>{_words(70)}</p><h2>Why buy</h2><p>x</p><h2>Ready?</h2><main>{_words(310)}</main>", _HREF), [], "", 10, None),
    (7, "https://shop.example/de", "https://shop.example/de", 200, None, _page("Deutsche Fassung", f"<h1>DE</h1><article>{_words(160)} $19.99 buy now<time datetime='2024-01-01'></time></article>", '<link rel="alternate" hreflang="english" href="https://shop.example/fr">' + _LD, "de"), [], "", 10, None),
    (8, "https://shop.example/tags", "https://shop.example/tags", 200, None, _page("Tagged page one", f"<h1>T</h1><p>{_words(120)}</p>{_TAGS}"), [], "", 10,
     (True, "", False, 1000, 1000, 3000.0, 3500.0, 0.3, 100.0, 900.0, True,
      ['{"event":"purchase","ecommerce":{"transaction_id":"T1","value":"9","currency":"eur","items":[]}}', '{"event":"purchase","transaction_id":"T1","value":5,"currency":"EUR","items":[{"id":1}]}', '{"0":"event","1":"sign_up","2":{"email":"someone@mail.example"}}', '{"0":"config","1":"G-ABCD12"}', "[1]"],
      ["https://www.google-analytics.com/g/collect?v=2"])),
    (9, "https://shop.example/gtm", "https://shop.example/gtm", 200, None, _page("Tagged page two", f"<h1>T</h1><p>{_words(20)}</p>{_GTM}"), [], "", 10, None),
    (10, "https://shop.example/wall", "https://shop.example/wall", 403, None, "<html><head><title>Just a moment...</title></head><body><div class='cf-turnstile'></div></body></html>", [], "", 10, None),
    (11, "https://shop.example/form", "https://shop.example/form", 200, None, _page("Contact form here", f"<h1>F</h1><div class='g-recaptcha'></div><p>{_words(300)}</p><iframe src='https://www.youtube.com/embed/1'></iframe><nav class='breadcrumb'><a href='/'>a</a><a href='/b'>b</a></nav>", "<script type='application/ld+json'>{bad</script>"), [], "", 10, None),
    (12, "https://shop.example/amp", "https://shop.example/amp", 200, None, _page("The AMP version", f"<h1>A</h1><p>{_words(130)}</p>", amp="⚡"), [], "", 10, None),
    (13, "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer", 200, {}, _page("Red things", f"<h1>Red shoes</h1><p>{_words(130, 'x1')}</p>", "<meta name='generator' content='WordPress 6.4'><link rel='stylesheet' href='/wp-content/plugins/polylang/a.css'>"), [], "", 10, None),
    (14, "https://shop.example/?p=7&lang=fr", "https://shop.example/?p=7&lang=fr", 200, None, _page("A plain permalink", f"<h1>P</h1><p>{_words(120)} [acf field='x']</p>"), [], "", 10, None),
    (15, "https://shop.example/author/ann/", "https://shop.example/author/ann/", 200, None, _page("Posts by Ann here", f"<h1>P</h1><p>{_words(120)}</p>"), [], "", 10, None),
    (16, "https://shop.example/server", "https://shop.example/server", 500, None, "", [], "", 10, None),
]

ROBOTS: list[tuple] = [
    ("https", "shop.example", 200, "User-agent: *\nDisallow: /gone\nAllow: /gone/ok\nDisallow: /*.pdf$\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nSitemap: https://shop.example/sitemap.xml\n"),
    ("https", "none.example", 404, ""),
    ("https", "bare.example", 200, "User-agent: *\nAllow: /\n"),
    ("https", "down.example", 503, ""),
]
SITEMAPS: list[tuple] = [
    ("https://shop.example/sitemap.xml", 200, False, True, b"<?xml version='1.0'?><sitemapindex><sitemap><loc>https://shop.example/s1.xml</loc></sitemap></sitemapindex>"),
    ("https://shop.example/sitemap_index.xml", 200, False, False, b"<html>nothing</html>"),
    ("https://shop.example/s1.xml", 200, False, None, b"<urlset xmlns='x'><url><loc>https://shop.example/</loc></url><url><loc>https://shop.example/missing?a=1&amp;b=2</loc></url></urlset>"),
    ("https://shop.example/broken.xml", 200, False, True, b"<html>soft 404</html>"),
]
RULES: list[tuple] = [
    ("/old", "/new", "FALSE", "FALSE"),
    ("/tags", "/new", "FALSE", "FALSE"),
    ("/tags", "/new", "TRUE", "FALSE"),
    ("/err", "/new", "FALSE", "FALSE"),
    ("/old", "/gone", "FALSE", "FALSE"),
    ("/x(?P<a>.*)", "/y", "FALSE", "FALSE"),
    ("/out", "https://elsewhere.example/", "FALSE", "FALSE"),
    ("/sub", "https://www.shop.example/a", "FALSE", "TRUE"),
]
#: A link graph of paths for the crawl loop: page, link.
GRAPH = [("/", "/a"), ("/", "/b"), ("/a", "/c"), ("/b", "/c"), ("/b", "/d"), ("/c", "/e"), ("/d", "/"), ("/e", "/f"), ("/e", "https://out.example/z")]


def pages(spark: SparkSession) -> DataFrame:
    rows = [
        (n, asked, got, status, headers, "text/html", html, None, [dict(zip(("from", "to", "status"), r, strict=True)) for r in hops], 0, SEED if n > 1 else "", ms, err, False, render)
        for n, asked, got, status, headers, html, hops, err, ms, render in PAGES
    ]
    return spark.createDataFrame(rows, schema.PAGES)


def robots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROBOTS, schema.ROBOTS)


def sitemaps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITEMAPS, "url string, status int, truncated boolean, declared boolean, body binary")


def redirect_rules(spark: SparkSession) -> DataFrame:
    rows = [(a, b, "301", "static", str(i), "FALSE", "FALSE", slash, off, "") for i, (a, b, off, slash) in enumerate(RULES)]
    return spark.createDataFrame(rows, schema.REDIRECT_RULES)
