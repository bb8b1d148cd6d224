"""Explicit schemas of crawl tables; nothing is inferred."""

from __future__ import annotations

PAGES = """
page_seq long, requested_url string, final_url string, status_code int,
headers map<string, array<string>>, content_type string, html string, raw_html string,
redirects array<struct<`from`: string, `to`: string, status: int>>,
depth int, referrer string, duration_ms long, err string, truncated boolean,
render struct<implemented: boolean, note: string, raw_fallback: boolean, rendered_bytes: int, raw_bytes: int,
  lcp_ms: double, fcp_ms: double, cls: double, tbt_ms: double, ttfb_ms: double,
  data_layer_present: boolean, data_layer: array<string>, requests: array<string>>
"""
ISSUES = "analyzer string, url string, severity string, code string, message string, data string"
ROBOTS = "scheme string, host string, status int, body string"
REDIRECT_RULES = (
    "`Original URL` string, `Redirect to` string, `Redirect type` string, `Redirect style` string, `Priority` string, "
    "`Match query strings` string, `Ignore trailing slash` string, `Ignore protocol` string, `Disable if page exists` string, `Note` string"
)
FEATURES = """
title_head_first string, title_head_all string, title_any_first string,
metas array<struct<name: string, property: string, http_equiv: string, charset: boolean, content: string, in_head: boolean>>,
links array<struct<rel: string, href: string, hreflang: string, in_head: boolean>>,
headings array<struct<level: int, text: string, labelled: boolean>>,
questions array<struct<text: string, answer_words: int>>,
html_lang string, html_amp boolean,
anchors array<struct<url: string, resolved: string, href: string, anchor: string, rel: string, nofollow: boolean, external: boolean>>,
imgs array<struct<src: string, alt: boolean, width: boolean, height: boolean>>,
script_srcs array<string>, inline_scripts array<string>, head_scripts array<string>, noscripts array<string>,
subresources array<string>, form_actions array<string>, iframe_srcs array<string>, video_src string,
body_words int, body_bytes int, content_hash string, acf_snippet string, price string, has_cart boolean, microdata boolean,
prose_words int, data_points int, main_count int, article_count int, article_words int, main_words int, main_has_list boolean, lead_words int,
has_author_mark boolean, has_date_mark boolean, breadcrumb_links int,
jsonld_blocks int, jsonld_errors int, jsonld_types array<string>, answer_types array<string>, article_types array<string>,
jsonld_keys array<string>, jsonld_missing array<struct<type: string, missing: array<string>>>,
assets string
"""
