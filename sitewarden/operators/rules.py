"""Per-page rules: features in, one array of issues out.

Every analyzer is a function from the columns of ``with_features`` to an array
of issue structs. All selected arrays are concatenated and exploded once, so a
crawl is scanned once however many rules run, and all rules stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import signatures as S
from .catalog import CATALOG

f = lambda name: F.col(f"f.{name}")
GATE = lambda: F.col("is_html") & (F.col("status_code") == 200)
ISSUE = "struct<analyzer: string, url: string, severity: string, code: string, message: string, data: string>"


def issue(analyzer: str, severity: str, code: str, when: Column | None = None, /, url: Column | None = None, **data: Column) -> Column:
    """An issue struct, null where ``when`` isn't true; ``data`` becomes JSON with sorted keys, nulls left out."""
    packed = F.to_json(F.struct(*(data[k].alias(k) for k in sorted(data)))) if data else F.lit(None).cast("string")
    made = F.struct(
        F.lit(analyzer).alias("analyzer"),
        (F.col("final_url") if url is None else url).alias("url"),
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        F.lit(CATALOG[code][0]).alias("message"),
        packed.alias("data"),
    )
    return made if when is None else F.when(F.coalesce(when, F.lit(False)), made)


def found(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda i: i.isNotNull())


def gated(issues: Column, gate: Column | None = None) -> Column:
    return F.when(F.coalesce(GATE() if gate is None else gate, F.lit(False)), issues).otherwise(F.array().cast(f"array<{ISSUE}>"))


def header(name: str) -> Column:
    """The first value of a header, by name without case; null if absent or headers are unknown."""
    return F.get(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == name.lower())), 0)[0]


def meta(name: str, in_head: bool = True) -> Column:
    """Content of the named meta tag, the exact name first, then without case; empty if there is none."""
    own = F.filter(f("metas"), lambda m: m["in_head"] | F.lit(not in_head))
    exact = F.get(F.filter(own, lambda m: m["name"] == name), 0)["content"]
    loose = F.get(F.filter(own, lambda m: F.lower(m["name"]) == name), 0)["content"]
    return T.strip(F.coalesce(exact, loose, F.lit("")))


def link_hrefs(rel: str) -> Column:
    own = F.filter(f("links"), lambda x: (x["rel"] == rel) & x["in_head"])
    return F.transform(own, lambda x: F.coalesce(x["href"], F.lit("")))


def seo() -> Column:
    i = lambda *a, **k: issue("seo", *a, **k)
    title, description = T.strip(f("title_head_first")), meta("description")
    n, d = F.char_length(title), F.char_length(description)
    robots, x_robots = F.lower(meta("robots")), F.lower(F.coalesce(header("x-robots-tag"), F.lit("")))
    refresh = F.get(F.filter(f("metas"), lambda m: m["in_head"] & (F.lower(m["http_equiv"]) == "refresh") & ~T.blank(m["content"])), 0)["content"]
    canon = link_hrefs("canonical")
    first = T.strip(F.coalesce(F.get(canon, 0), F.lit("")))
    h1 = F.size(F.filter(f("headings"), lambda h: h["level"] == 1))
    heads = f("headings")
    empty = F.transform(
        F.filter(heads, lambda h: T.blank(h["text"]) & ~h["labelled"]),
        lambda h: issue("seo", "warning", "seo-empty-heading", tag=F.concat(F.lit("h"), h["level"].cast("string"))),
    )
    skipped = F.filter(
        F.transform(
            heads,
            lambda h, p: issue(
                "seo", "info", "seo-skipped-heading-level", (p > 0) & (h["level"] > F.get(heads, p - 1)["level"] + 1), to=h["level"], **{"from": F.get(heads, p - 1)["level"]}
            ),
        ),
        lambda x: x.isNotNull(),
    )
    has = lambda test: F.exists(f("metas"), lambda m: m["in_head"] & F.coalesce(test(m), F.lit(False)))
    single = found(
        i("error", "seo-missing-title", n == 0),
        i("warning", "seo-short-title", (n > 0) & (n < 10), length=n, title=title),
        i("warning", "seo-long-title", n > 60, length=n, title=title),
        i("warning", "seo-missing-meta-description", d == 0),
        i("info", "seo-short-meta-description", (d > 0) & (d < 50), length=d),
        i("info", "seo-long-meta-description", d > 160, length=d),
        i("warning", "seo-meta-noindex", robots.contains("noindex"), robots=meta("robots")),
        i("info", "seo-meta-nofollow", robots.contains("nofollow"), robots=meta("robots")),
        i("warning", "seo-x-robots-noindex", x_robots.contains("noindex"), x_robots_tag=header("x-robots-tag")),
        i("info", "seo-x-robots-nofollow", x_robots.contains("nofollow"), x_robots_tag=header("x-robots-tag")),
        i("warning", "seo-meta-refresh", refresh.isNotNull(), content=refresh),
        i("warning", "seo-multiple-canonical", (first != "") & (F.size(canon) > 1)),
        i("info", "seo-missing-canonical", first == ""),
        i("warning", "seo-missing-h1", h1 == 0),
        i("info", "seo-multiple-h1", h1 > 1, count=h1),
        i("info", "seo-missing-lang", T.blank(f("html_lang"))),
        i("info", "seo-missing-viewport", ~has(lambda m: (F.lower(m["name"]) == "viewport") & m["content"].isNotNull())),
        i("info", "seo-missing-charset", ~has(lambda m: m["charset"] | ((F.lower(m["http_equiv"]) == "content-type") & m["content"].isNotNull()))),
        i("info", "seo-missing-opengraph", ~has(lambda m: m["property"].startswith("og:"))),
    )
    return gated(F.concat(single, empty, skipped))


def redirects() -> Column:
    i = lambda *a, **k: issue("redirects", *a, url=F.col("requested_url"), **k)
    hops = F.coalesce(F.size("redirects"), F.lit(0))
    chain = F.concat(F.array(F.trim("requested_url")), F.transform(F.coalesce("redirects", F.expr("array()").cast("array<struct<`from`: string, `to`: string, status: int>>")), lambda r: F.trim(r["to"])))
    loop = (hops > 0) & (F.size(F.array_distinct(chain)) < F.size(chain))
    failed = (F.coalesce("err", F.lit("")) != "") & ~loop
    on = F.when(F.col("referrer") != "", F.col("referrer"))
    status = F.col("status_code")
    bad = F.slice(F.filter(f("subresources"), lambda s: s.rlike(r"^\s*(?i)http://")), 1, 5)
    return found(
        i("error", "http-redirect-loop", loop, chain=chain),
        i("warning", "http-redirect-chain", ~loop & (hops > 1), hops=hops, chain=chain),
        i("info", "http-redirect", ~loop & (hops == 1), to=F.col("final_url"), status=F.get("redirects", 0)["status"]),
        i("error", "http-fetch-error", failed, found_on=on, error=F.col("err")),
        i("error", "http-server-error", ~failed & (status >= 500), status=status, found_on=on),
        i("error", "http-client-error", ~failed & (status >= 400) & (status < 500), status=status, found_on=on),
        i("warning", "http-body-truncated", ~failed & F.col("truncated")),
        i("warning", "http-slow-response", ~failed & (F.col("duration_ms") > 2000), duration_ms=F.col("duration_ms")),
        i("warning", "http-mixed-content", ~failed & F.col("is_html") & F.col("final_url").startswith("https://") & (F.size(bad) > 0), count=F.size(bad), examples=bad),
    )


def images() -> Column:
    bare = F.filter(f("imgs"), lambda x: ~x["alt"])
    loose = F.size(F.filter(f("imgs"), lambda x: ~x["width"] | ~x["height"]))
    return gated(
        found(
            issue("images", "warning", "img-missing-alt", F.size(bare) > 0, count=F.size(bare), sample=F.slice(F.transform(bare, lambda x: x["src"]), 1, 5)),
            issue("images", "info", "img-missing-dimensions", loose > 0, count=loose),
        )
    )


def urls() -> Column:
    u, p = F.col("final_url"), U.decoded_path(F.col("final_url"))
    i = lambda code, when, **k: issue("urls", "info", code, when, url=u, **k)
    return gated(
        found(
            i("url-uppercase", p != F.lower(p)),
            i("url-underscore", p.contains("_")),
            i("url-non-ascii", F.octet_length(u) != F.char_length(u)),
            i("url-too-long", F.octet_length(u) > 115, length=F.octet_length(u)),
        ),
        F.coalesce(u, F.lit("")) != "",
    )


def security() -> Column:
    known, https = F.col("headers").isNotNull(), F.lower(F.col("final_url")).startswith("https://")
    action = F.get(F.filter(f("form_actions"), lambda a: a.startswith("http://")), 0)
    return gated(
        found(
            issue("security", "warning", "security-missing-hsts", known & https & T.blank(header("strict-transport-security"))),
            issue("security", "info", "security-missing-csp", known & T.blank(header("content-security-policy"))),
            issue("security", "info", "security-missing-x-content-type-options", known & ~F.lower(F.coalesce(header("x-content-type-options"), F.lit(""))).contains("nosniff")),
            issue("security", "warning", "security-insecure-form", https & action.isNotNull(), action=action),
        )
    )


def perf() -> Column:
    """Page rules; what depends on the whole crawl (``any_rendered``) is a column of the row."""
    r = lambda name: F.col(f"render.{name}")
    i = lambda *a, **k: issue("perf", *a, **k)
    done = F.coalesce(r("implemented"), F.lit(False))
    rendered = F.col("any_rendered")
    out = [
        i("info", "perf-response-time", ~rendered & (F.col("status_code") == 200) & (F.col("duration_ms") > 0), duration_ms=F.col("duration_ms")),
        i("info", "perf-cwv-render-failed", rendered & GATE() & F.col("render").isNotNull() & ~done & (r("note") != ""), note=r("note")),
        i("warning", "perf-render-incomplete", rendered & GATE() & r("raw_fallback"), rendered_bytes=r("rendered_bytes"), raw_bytes=r("raw_bytes")),
        i("info", "perf-cwv-measured", GATE() & done, lcp_ms=r("lcp_ms"), fcp_ms=r("fcp_ms"), cls=r("cls"), tbt_ms=r("tbt_ms"), ttfb_ms=r("ttfb_ms")),
    ]
    for name, good, fair in S.VITALS:
        value = r(name if name == "cls" else f"{name}_ms")
        keys = ("value", "threshold") if name == "cls" else ("value_ms", "threshold_ms")
        ok = GATE() & done & (value > 0)
        out.append(i("warning", f"perf-{name}-needs-improvement", ok & (value > good) & (value <= fair), **{keys[0]: value, keys[1]: F.lit(good)}))
        out.append(i("error", f"perf-{name}-poor", ok & (value > fair), **{keys[0]: value, keys[1]: F.lit(fair)}))
    return found(*out)


def botwall() -> Column:
    values = F.transform(F.coalesce(F.map_entries("headers"), F.expr("array()").cast("array<struct<key: string, value: array<string>>>")), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    hay = F.lower(F.concat_ws(" ", F.coalesce("html", F.lit("")), values, F.col("render.requests")))
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, m)).alias("markers"), F.lit(w).alias("wall")) for n, m, w in S.WALLS))
    # the text is put into a lambda variable, so that it is built once and searched by every marker
    hits = F.transform(
        F.array(hay),
        lambda h: F.filter(
            F.transform(table, lambda t: F.struct(t["name"].alias("name"), t["wall"].alias("wall"), F.get(F.filter(t["markers"], lambda m: F.contains(h, m)), 0).alias("signal"))),
            lambda t: t["signal"].isNotNull(),
        ),
    )[0]
    title = F.lower(T.strip(F.coalesce(f("title_any_first"), F.lit(""))))
    hint = F.exists(F.array(*map(F.lit, S.WALL_TITLES)), lambda x: F.contains(title, x))
    blocking = F.col("status_code").isin(S.WALL_STATUSES)
    size = F.coalesce(f("body_bytes"), F.octet_length(F.coalesce("html", F.lit(""))))

    def judged(h: Column) -> Column:
        rest = F.sort_array(F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x: x["name"]))
        first = F.get(h, 0)["name"]
        provider = F.when(F.size(h) > 1, F.concat(first, F.lit(" (+ "), F.array_join(rest, ", "), F.lit(")"))).otherwise(first)
        wall, none = F.exists(h, lambda x: x["wall"]), F.size(h) == 0
        sure = ~none & (wall | blocking | hint | (size < S.THIN_BYTES))
        signals = F.when(none, F.array(F.concat(F.lit("title: "), title))).otherwise(F.transform(h, lambda x: x["signal"]))
        return found(
            issue("botwall", "warning", "botwall-challenge", sure | (none & blocking & hint), provider=F.when(none, "Unknown").otherwise(provider), signals=signals, status=F.col("status_code")),
            issue("botwall", "info", "botwall-captcha-widget", ~none & ~sure, provider=provider, providers=F.transform(h, lambda x: x["name"]), signals=signals),
        )

    return gated(F.transform(F.array(hits), judged)[0], F.coalesce("html", F.lit("")) != "")


def tracking() -> Column:
    blob = F.concat_ws("\n", f("script_srcs"), f("inline_scripts"), f("noscripts"), F.transform(f("imgs"), lambda x: x["src"]))

    def judged(b: Column) -> Column:
        low, seen = F.lower(b), []
        for tag, family, signals, pattern in S.TAGS:
            regex = pattern.format(B=T.B)
            ids = F.array_distinct(F.regexp_extract_all(b, F.lit(regex), F.lit(1 if "([" in pattern else 0))) if pattern else F.array().cast("array<string>")
            hit = F.size(ids) > 0
            for s in signals:
                hit = hit | F.contains(low, F.lit(s))
            seen.append(F.when(hit, F.struct(F.lit(tag).alias("tag"), ids.alias("ids"), F.lit(family).alias("family"))))
        return F.transform(F.array(F.array_compact(F.array(*seen))), reported)[0]

    def reported(tags: Column) -> Column:
        of = lambda k: F.get(F.filter(tags, lambda t: t["family"] == k), 0)
        many = F.transform(
            F.filter(tags, lambda t: F.size(t["ids"]) > 1),
            lambda t: issue("tracking", "warning", "tracking-duplicate-tag", tag=t["tag"], ids=t["ids"], count=F.size(t["ids"])),
        )
        shown = F.transform(tags, lambda t: F.struct(t["ids"].alias("ids"), t["tag"].alias("tag")))
        return F.concat(
            found(
                issue("tracking", "info", "tracking-none", F.size(tags) == 0),
                issue("tracking", "info", "tracking-tags", F.size(tags) > 0, tags=shown),
                issue("tracking", "info", "tracking-mixed-ga-versions", of("ua").isNotNull() & of("ga4").isNotNull(), ua_ids=of("ua")["ids"], ga4_ids=of("ga4")["ids"]),
            ),
            many,
        )

    return gated(F.transform(F.array(blob), judged)[0])


def structured() -> Column:
    i = lambda *a, **k: issue("structured", *a, **k)
    types, none = f("jsonld_types"), f("jsonld_blocks") == 0
    has = lambda *t: F.arrays_overlap(types, F.array(*map(F.lit, t)))
    signal = F.when(f("microdata"), "microdata").when(f("price").isNotNull() & f("has_cart"), f("price"))
    invalid = F.transform(F.sequence(F.lit(1), F.greatest(f("jsonld_errors"), F.lit(1))), lambda _: i("warning", "structured-invalid-jsonld", f("jsonld_errors") > 0))
    missing = F.transform(f("jsonld_missing"), lambda m: i("warning", "structured-missing-required", type=m["type"], missing=m["missing"]))
    video = F.coalesce(f("video_src"), F.get(F.filter(f("iframe_srcs"), lambda s: s.rlike(S.VIDEO_HOSTS)), 0))
    return gated(
        F.concat(
            found(
                i("warning", "structured-breadcrumb-candidate", ~has("BreadcrumbList") & (f("breadcrumb_links") > 0), links=f("breadcrumb_links")),
                i("warning", "structured-product-candidate", ~has("Product", "Offer") & signal.isNotNull(), signal=signal),
                i(
                    "warning",
                    "structured-article-candidate",
                    ~has("Article", "NewsArticle", "BlogPosting", "TechArticle", "Report") & (f("article_words") >= 150) & (f("has_author_mark") | f("has_date_mark")),
                    words=f("article_words"),
                ),
                i("warning", "structured-video-candidate", ~has("VideoObject") & video.isNotNull(), src=video),
                i("info", "structured-none", none),
                i("info", "structured-data", ~none & (F.size(types) > 0), types=types),
            ),
            F.filter(invalid, lambda x: x.isNotNull()),
            missing,
        )
    )


def aeo(answer_lead: bool = False) -> Column:
    i = lambda *a, **k: issue("aeo", *a, **k)
    answered, asked = F.size(f("answer_types")) > 0, F.size(f("questions"))
    long = F.transform(
        F.filter(f("questions"), lambda q: q["answer_words"] > 60),
        lambda q: i("info", "aeo-answer-too-long", question=q["text"], answer_words=q["answer_words"]),
    )
    h1 = F.get(F.filter(f("headings"), lambda h: h["level"] == 1), 0)["text"]
    rules = [
        i("info", "aeo-answer-schema", answered, types=f("answer_types")),
        i("warning", "aeo-faq-candidate", ~answered & (asked >= 3), questions=asked),
        i("info", "aeo-no-list-format", (f("main_words") >= 300) & ~f("main_has_list"), words=f("main_words")),
    ]
    if answer_lead:
        rules.append(i("info", "aeo-no-answer-lead", T.is_question(h1) & ((f("lead_words") == 0) | (f("lead_words") > 60)), title=T.collapse(h1), lead_words=f("lead_words")))
    return gated(F.concat(found(*rules), long))


def geo(quotable: bool = False) -> Column:
    i = lambda *a, **k: issue("geo", *a, **k)
    article = (f("article_count") > 0) | (F.size(f("article_types")) > 0)
    key = lambda *k: F.arrays_overlap(f("jsonld_keys"), F.array(*map(F.lit, k)))
    words, raw = f("prose_words"), F.col("raw_prose_words")
    rules = [
        i("info", "geo-missing-author", article & ~(key("author") | f("has_author_mark") | (meta("author", False) != ""))),
        i("info", "geo-missing-date", article & ~(key("datePublished", "dateModified") | f("has_date_mark"))),
        i("info", "geo-no-main-landmark", (f("main_count") == 0) & (words >= 300), words=words),
        i("info", "geo-js-dependent-content", (words >= 300) & raw.isNotNull() & (raw < 0.5 * words), rendered_words=words, raw_words=raw),
    ]
    if quotable:
        rules.append(i("info", "geo-low-quotable-density", (words >= 300) & (f("data_points") * 100 < 0.5 * words), words=words, data_points=f("data_points")))
    return gated(found(*rules))


def utm_of(url: Column) -> Column:
    """``present, empty, duplicate, casing``: what campaign parameters a URL carries, sorted."""
    keys = F.array(*map(F.lit, S.UTM_KEYS))
    pairs = F.filter(U.query_pairs(url), lambda p: F.array_contains(keys, F.lower(p["key"])))

    def judged(ps: Column) -> Column:
        of = lambda k: F.filter(ps, lambda p: F.lower(p["key"]) == k)
        firsts = lambda k: F.transform(F.array_distinct(F.transform(of(k), lambda p: p["key"])), lambda raw: F.get(F.filter(ps, lambda p: p["key"] == raw), 0)["value"])
        present = F.filter(keys, lambda k: F.size(of(k)) > 0)
        return F.struct(
            present.alias("present"),
            F.sort_array(F.filter(present, lambda k: ~F.exists(firsts(k), lambda v: ~T.blank(v)))).alias("empty"),
            F.sort_array(F.filter(keys, lambda k: F.size(of(k)) > 1)).alias("duplicate"),
            F.sort_array(F.array_distinct(F.filter(F.transform(ps, lambda p: p["key"]), lambda k: k != F.lower(k)))).alias("casing"),
        )

    return F.transform(F.array(pairs), judged)[0]


def utm() -> Column:
    i = lambda *a, **k: issue("utm", *a, **k)
    need = F.array(*map(F.lit, S.UTM_REQUIRED))
    marked = F.transform(f("anchors"), lambda a: F.struct(a.alias("a"), utm_of(a["resolved"]).alias("u")))

    def judged(links: Column) -> Column:
        tagged = F.filter(links, lambda x: F.size(x["u"]["present"]) > 0)
        out = F.size(F.filter(tagged, lambda x: x["a"]["external"]))

        def one(x: Column) -> Column:
            a, u = x["a"], x["u"]
            missing = F.array_except(need, u["present"])
            return found(
                i("info", "utm-internal-tagged", ~a["external"], target=a["resolved"]),
                i("warning", "utm-partial-tagging", F.arrays_overlap(need, u["present"]) & (F.size(missing) > 0), target=a["resolved"], present=u["present"], missing=missing, anchor=a["anchor"]),
                i("warning", "utm-empty-value", F.size(u["empty"]) > 0, target=a["resolved"], keys=u["empty"]),
                i("warning", "utm-duplicate-param", F.size(u["duplicate"]) > 0, target=a["resolved"], keys=u["duplicate"]),
                i("info", "utm-inconsistent-casing", F.size(u["casing"]) > 0, target=a["resolved"], keys=u["casing"]),
            )

        total = i("info", "utm-summary", F.size(links) > 0, total_links=F.size(links), tagged_links=F.size(tagged), external_tagged=out, internal_tagged=F.size(tagged) - out)
        return F.concat(F.flatten(F.transform(tagged, one)), found(total))

    return gated(F.transform(F.array(marked), judged)[0], F.col("f").isNotNull())


def wordpress_page() -> Column:
    """Page rules, for crawls where WordPress was detected (``is_wordpress`` on the row)."""
    i = lambda *a, **k: issue("wordpress", *a, **k)
    url = F.col("final_url")
    q = U.query_pairs(url)
    v = lambda k: U.first_value(q, k)
    subtag = lambda c: F.regexp_extract(F.lower(T.strip(c)), "^[^-_]*", 0)
    plain = F.when(v("p") != "", "p").when(v("page_id") != "", "page_id").when(v("cat") != "", "cat")
    own, asked = subtag(f("html_lang")), F.lower(v("lang"))
    canon = T.strip(F.coalesce(F.get(F.filter(f("links"), lambda x: x["rel"] == "canonical"), 0)["href"], F.lit("")))
    full = F.when(canon.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), canon).when(canon.startswith("//"), F.concat(U.scheme(url), F.lit(":"), canon)).otherwise(F.concat(U.scheme(url), F.lit("://"), U.host(url), canon))
    bare = lambda c: F.regexp_replace(U.decoded_path(c), "/+$", "")
    elsewhere = (canon != "") & ((U.host(full) != U.host(url)) | (bare(full) != bare(url)) | (U.query(full) != U.query(url)))
    noindex = F.lower(meta("robots", False)).contains("noindex") | F.lower(F.coalesce(header("x-robots-tag"), F.lit(""))).contains("noindex")
    path = U.decoded_path(url)
    kind = (
        F.when(noindex | elsewhere, None)
        .when(v("attachment_id") != "", "attachment")
        .when(v("s") != "", "search")
        .when(path.rlike("^/author/[^/]+/?"), "author-archive")
        .when(path.rlike(r"^/[0-9]{4}(/[0-9]{2}(/[0-9]{2})?)?/?$"), "date-archive")
    )
    return gated(
        found(
            i("info", "wp-ugly-permalink", plain.isNotNull(), param=plain),
            i("info", "wp-i18n-lang-query-param", asked != "", lang=asked),
            i("warning", "wp-html-lang-mismatch", (asked != "") & (own != "") & (own != subtag(asked)), html_lang=own, url_lang=subtag(asked)),
            i("warning", "wp-acf-leaked-markup", f("acf_snippet") != "", snippet=f("acf_snippet")),
            i("warning", "wp-indexable-attachment", kind == "attachment", id=v("attachment_id")),
            i("warning", "wp-indexable-search", kind == "search"),
            i("info", "wp-indexable-author-archive", kind == "author-archive"),
            i("info", "wp-indexable-date-archive", kind == "date-archive"),
        ),
        GATE() & F.col("is_wordpress"),
    )


def tag_facts() -> Column:
    """What the HTML says about tag managers, as one struct."""
    blob = F.concat_ws("\n", f("script_srcs"), F.transform(f("imgs"), lambda x: x["src"]), f("inline_scripts"), f("noscripts"))
    inline = F.filter(f("inline_scripts"), lambda s: ~T.blank(s))
    init = rf"dataLayer\s*=\s*(\[|\w+\.dataLayer|window\.dataLayer)|{T.B}(\w)\[(\w)\]\s*=\s*\w\[\w\]\s*\|\|\s*\[\]"
    first = lambda regex: F.coalesce(F.array_position(F.transform(inline, lambda s: s.rlike(regex)), F.lit(True)), F.lit(0))

    def facts(b: Column) -> Column:
        ids = lambda regex, g: F.sort_array(F.array_distinct(F.regexp_extract_all(b, F.lit(regex), F.lit(g))))
        gtm = ids(rf"{T.B}GTM-[A-Z0-9]+", 0)
        loaded = ids(r"googletagmanager\.com/gtag/js\?id=([A-Za-z0-9-]+)", 1)
        config = ids(r"gtag\(\s*['\"]config['\"]\s*,\s*['\"]([A-Za-z0-9-]+)['\"]", 1)
        both, low = F.concat(loaded, config), F.lower(b)
        return F.struct(
            gtm.alias("gtm"),
            loaded.alias("loaded"),
            config.alias("config"),
            (F.exists(both, lambda x: x.startswith("G-")) | b.rlike(rf"{T.B}G-[A-Z0-9]{{4,}}")).alias("ga4"),
            (F.exists(both, lambda x: x.startswith("AW-")) | b.rlike(rf"{T.B}AW-[0-9]+")).alias("ads"),
            (low.contains("connect.facebook.net") | low.contains("fbq(")).alias("meta"),
            b.rlike(r"gtag\(\s*['\"]consent['\"]").alias("consent"),
            first(init).alias("init"),
            first(r"dataLayer\s*\.\s*push\s*\(").alias("push"),
            F.exists(f("head_scripts"), lambda s: s.contains("googletagmanager.com/gtm.js") | s.rlike(rf"{T.B}GTM-[A-Z0-9]+")).alias("in_head"),
            F.exists(f("noscripts"), lambda s: s.contains("googletagmanager.com/ns.html")).alias("noscript"),
        )

    return F.transform(F.array(blob), facts)[0]


def datalayer() -> Column:
    """Static checks, and those on the captured data layer that need one page only."""
    i = lambda *a, **k: issue("datalayer", *a, **k)

    def entries() -> Column:
        raw = F.transform(F.coalesce(F.col("render.data_layer"), F.expr("array()").cast("array<string>")), lambda e: F.try_parse_json(e))
        text = lambda v, p: F.try_variant_get(v, p, "string")

        def entry(v: Column) -> Column:
            called = F.when(F.schema_of_variant(v).startswith("OBJECT"), True)
            name = F.when(text(v, "$.event").isNotNull(), text(v, "$.event")).when(text(v, "$['0']") == "event", text(v, "$['1']"))
            command = F.when(text(v, "$.event").isNull(), text(v, "$['0']"))
            params = F.when(F.coalesce(command == "event", F.lit(False)) & F.try_variant_get(v, "$['2']", "map<string, variant>").isNotNull(), F.try_variant_get(v, "$['2']", "variant")).otherwise(v)
            flat = F.try_variant_get(params, "$", "map<string, variant>")
            inner = F.try_variant_get(params, "$.ecommerce", "map<string, variant>")
            merged = F.when(inner.isNull(), flat).otherwise(F.map_concat(F.map_filter(flat, lambda k, _: ~F.map_contains_key(inner, k)), inner))
            keys = F.map_keys(merged)
            got = lambda k: F.try_element_at(merged, F.lit(k))
            kind = lambda k: F.schema_of_variant(got(k))
            return F.when(
                called,
                F.struct(
                    name.alias("event"),
                    command.alias("command"),
                    keys.alias("keys"),
                    kind("value").alias("value_kind"),
                    F.try_variant_get(got("currency"), "$", "string").alias("currency"),
                    kind("currency").alias("currency_kind"),
                    kind("items").alias("items_kind"),
                    F.size(F.try_variant_get(got("items"), "$", "array<variant>")).alias("n_items"),
                    F.when(kind("transaction_id") == "STRING", F.try_variant_get(got("transaction_id"), "$", "string")).alias("transaction"),
                    F.to_json(params).alias("json"),
                ),
            )

        return F.array_compact(F.transform(F.filter(raw, lambda v: v.isNotNull()), entry))

    def static(t: Column) -> Column:
        has = F.size(t["gtm"]) > 0
        some = has | t["ga4"] | t["ads"]
        lone = F.transform(
            F.when(~has, F.array_except(t["config"], t["loaded"])).otherwise(F.array().cast("array<string>")),
            lambda c: i("warning", "datalayer-gtag-config-id-mismatch", config_id=c, loaded_ids=t["loaded"]),
        )
        return F.concat(
            found(
                i("warning", "datalayer-gtm-noscript-missing", has & ~t["noscript"], containers=t["gtm"]),
                i("info", "datalayer-gtm-snippet-not-in-head", has & ~t["in_head"], containers=t["gtm"]),
                i("warning", "datalayer-push-before-init", (t["push"] > 0) & ((t["init"] == 0) | (t["push"] < t["init"]))),
                i("warning", "datalayer-init-missing", (has | t["ga4"]) & (t["init"] == 0) & (t["push"] == 0)),
                i("info", "datalayer-consent-mode-present", (some | t["meta"] | (F.size(t["config"]) > 0)) & t["consent"]),
                i("info", "datalayer-consent-mode-missing", some & ~t["consent"]),
            ),
            lone,
        )

    def runtime(t: Column, e: Column) -> Column:
        has = F.size(t["gtm"]) > 0
        there = {"GA4": t["ga4"], "Google Ads": t["ads"], "Meta Pixel": t["meta"], "Google Tag Manager": has}
        requests = F.coalesce(F.col("render.requests"), F.expr("array()").cast("array<string>"))

        def sent(patterns: list[str]) -> Column:
            wanted = F.array(*map(F.lit, patterns))
            return F.exists(requests, lambda r: F.exists(wanted, lambda x: F.contains(r, x)))

        state = F.array(*(F.when(there[tag], F.struct(F.lit(tag).alias("tag"), sent(patterns).alias("ok"))) for tag, patterns in S.BEACONS))
        state = F.array_compact(state)
        fired = F.sort_array(F.transform(F.filter(state, lambda s: s["ok"]), lambda s: s["tag"]))
        firing = F.concat(
            F.transform(F.filter(state, lambda s: ~s["ok"]), lambda s: i("warning", "datalayer-tag-not-firing", tag=s["tag"])),
            found(i("info", "datalayer-tags-firing", F.size(fired) > 0, tags=fired)),
        )
        names = F.filter(F.transform(e, lambda x: x["event"]), lambda n: n.isNotNull() & (n != ""))
        counted = lambda xs: F.transform(F.array_distinct(xs), lambda n: F.struct(F.size(F.filter(xs, lambda m: m == n)).alias("count"), n.alias("event")))
        repeated = F.transform(
            F.filter(counted(F.filter(names, lambda n: n.isin(S.CONVERSIONS))), lambda c: c["count"] > 1),
            lambda c: i("warning", "datalayer-duplicate-event", event=c["event"], count=c["count"]),
        )
        bought = F.filter(F.transform(F.filter(e, lambda x: x["event"] == "purchase"), lambda x: x["transaction"]), lambda x: x.isNotNull() & (x != ""))
        twice = F.transform(F.filter(counted(bought), lambda c: c["count"] > 1), lambda c: i("warning", "datalayer-duplicate-transaction", transaction_id=c["event"], count=c["count"]))
        need = F.create_map(*(x for k, v in S.ECOMMERCE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

        def sale(x: Column) -> Column:
            missing = F.array_except(F.try_element_at(need, x["event"]), x["keys"])
            number = x["value_kind"].rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
            return found(
                i("warning", "datalayer-ecommerce-event-invalid", F.size(missing) > 0, event=x["event"], missing=missing),
                i("warning", "datalayer-param-type", x["value_kind"].isNotNull() & ~number, event=x["event"], param=F.lit("value"), want=F.lit("number")),
                i("warning", "datalayer-param-type", x["currency_kind"].isNotNull() & ~F.coalesce((x["currency_kind"] == "STRING") & x["currency"].rlike("^[A-Z]{3}$"), F.lit(False)), event=x["event"], param=F.lit("currency"), want=F.lit("ISO-4217 code"), got=x["currency"]),
                i("warning", "datalayer-param-type", x["items_kind"].isNotNull() & ~F.coalesce(x["items_kind"].startswith("ARRAY") & (x["n_items"] > 0), F.lit(False)), event=x["event"], param=F.lit("items")),
            )

        sales = F.flatten(F.transform(F.filter(e, lambda x: F.map_contains_key(need, F.coalesce(x["event"], F.lit("")))), sale))
        # string leaves of the entries, by the nearest key; the first of each kind and key counts
        pairs = F.flatten(F.transform(e, lambda x: F.transform(F.regexp_extract_all(x["json"], F.lit(r'"(?:[^"\\]|\\.)*"\s*:\s*"(?:[^"\\]|\\.)*"'), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r'^"((?:[^"\\]|\\.)*)"', 1).alias("key"), F.regexp_extract(m, r':\s*"((?:[^"\\]|\\.)*)"$', 1).alias("value")))))
        kinds = F.transform(pairs, lambda p: F.struct(F.when(p["value"].rlike(S.EMAIL), "email").when(p["key"].rlike(S.PHONE_KEY) & p["value"].rlike(S.PHONE), "phone").alias("kind"), p["key"].alias("key"), p["value"].alias("value")))
        hits = F.filter(kinds, lambda p: p["kind"].isNotNull())
        once = F.filter(hits, lambda p, n: F.array_position(F.transform(hits, lambda x: F.concat_ws("|", x["kind"], x["key"])), F.concat_ws("|", p["kind"], p["key"])) == n + 1)
        private = F.transform(once, lambda p: i("warning", "datalayer-pii", kind=p["kind"], key=p["key"], value=T.redact(p["value"])))
        loaded = F.exists(names, lambda n: n.isin(S.PAGE_LOADS)) | (F.size(t["config"]) > 0)
        empty = F.size(e) == 0
        seen = found(
            i("info", "datalayer-events", F.size(names) > 0, events=counted(names)),
            i("warning", "datalayer-page-view-missing", ~loaded),
        )
        hollow = ~F.coalesce(F.col("render.data_layer_present"), F.lit(False)) | (F.coalesce(F.size("render.data_layer"), F.lit(0)) == 0)
        none = F.array().cast(f"array<{ISSUE}>")
        body = F.when(hollow & (has | t["ga4"]), found(i("warning", "datalayer-empty"))).when(empty, none).otherwise(F.concat(seen, sales, repeated, twice, private))
        return F.when(F.coalesce(F.col("render.implemented"), F.lit(False)), F.concat(body, firing)).otherwise(none)

    return gated(F.transform(F.array(F.struct(tag_facts().alias("t"), entries().alias("e"))), lambda s: F.concat(static(s["t"]), runtime(s["t"], s["e"])))[0])


PAGE_RULES: dict[str, Callable[[], Column]] = {
    "seo": seo,
    "redirects": redirects,
    "images": images,
    "urls": urls,
    "security": security,
    "perf": perf,
    "botwall": botwall,
    "tracking": tracking,
    "structured": structured,
    "aeo": aeo,
    "geo": geo,
    "utm": utm,
    "wordpress": wordpress_page,
    "datalayer": datalayer,
}
