"""Rules that look across pages: joins, groups and facts of a whole crawl.

Each returns an issue DataFrame. Pages arrive as ``with_features`` gives them,
materialised, without their HTML. Joins are plain equi-joins, so the planner
picks broadcast or shuffle by size and splits skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import signatures as S
from .rules import GATE, f, found, header, issue, link_hrefs, meta


def flat(frame: DataFrame, issues: Column, *keep: str) -> DataFrame:
    """The issues as rows, with the columns of their page that ``keep`` names before them."""
    return frame.select(*keep, F.explode(issues).alias("i")).select(*keep, "i.*")


def page_index(pages: DataFrame) -> DataFrame:
    """``key`` and the page it leads to: requested and final keys of the first page of each final key."""
    keyed = pages.select(
        U.index_key(F.col("requested_url")).alias("asked"), U.index_key(F.col("final_url")).alias("got"), "page_seq", "final_url", "status_code", F.coalesce(F.size("redirects"), F.lit(0)).alias("hops")
    )
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("got").orderBy("page_seq"))).where("n = 1")
    keys = first.select(F.explode(F.array_distinct(F.array("got", "asked"))).alias("key"), "page_seq", "final_url", "status_code", "hops", "got")
    return keys.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy((F.col("key") != F.col("got")).cast("int"), "page_seq"))).where("n = 1").drop("n", "got")


def _moved(link: Column, final: Column) -> Column:
    return (F.col("hops") > 0) & (U.keep_slash(link) != U.keep_slash(final))


def links(pages: DataFrame) -> DataFrame:
    good = pages.where(GATE())
    each = good.select("page_seq", F.col("final_url").alias("page"), F.explode("f.anchors").alias("a"))
    index = page_index(pages)
    hit = each.where("NOT a.external").join(index.withColumnRenamed("page_seq", "to"), F.col("a.url") == F.col("key"))
    broken = F.col("status_code") >= 400
    targets = flat(
        hit,
        found(
            issue("links", "error", "link-broken", broken, url=F.col("page"), target=F.col("a.resolved"), status=F.col("status_code"), anchor=F.col("a.anchor")),
            issue("links", "warning", "link-to-redirect", ~broken & _moved(F.col("a.resolved"), F.col("final_url")), url=F.col("page"), target=F.col("a.resolved"), final=F.col("final_url")),
        ),
    )
    a = f("anchors")
    count = lambda test: F.size(F.filter(a, test))
    bare = count(lambda x: x["anchor"] == "")
    own = flat(
        good,
        found(
            issue("links", "info", "link-empty-anchor", bare > 0, count=bare),
            issue("links", "info", "link-summary", F.size(a) > 0, total=F.size(a), external=count(lambda x: x["external"]), nofollow=count(lambda x: x["nofollow"])),
        ),
    )
    every = pages.where("f IS NOT NULL").select("page_seq", F.explode("f.anchors").alias("a"))
    into = every.where("NOT a.external").join(index.withColumnRenamed("page_seq", "to"), F.col("a.url") == F.col("key")).where("page_seq <> to")
    # texts of links to one page are counted first, so a home page's are never gathered: the ten smallest are enough
    texts = into.groupBy("to", F.col("a.anchor").alias("anchor")).agg(F.count(F.lit(1)).alias("m"))
    place = F.row_number().over(Window.partitionBy("to").orderBy(F.col("anchor") == "", "anchor"))
    shown = F.when((F.col("place") <= 10) & (F.col("anchor") != ""), F.col("anchor"))
    counts = texts.withColumn("place", place).groupBy("to").agg(F.sum("m").alias("n"), F.sort_array(F.collect_list(shown)).alias("names"))
    inbound = good.join(counts, F.col("page_seq") == F.col("to"), "left").select(
        issue("links", "info", "link-inbound", count=F.coalesce("n", F.lit(0)), anchors=F.coalesce("names", F.array().cast("array<string>"))).alias("i")
    )
    return targets.unionAll(own).unionAll(inbound.select("i.*"))


def pagination(pages: DataFrame) -> DataFrame:
    good = pages.where(GATE())
    href = lambda rel: F.when(~T.blank(F.get(link_hrefs(rel), 0)), T.strip(F.get(link_hrefs(rel), 0)))
    named = good.select("final_url", href("next").alias("next"), href("prev").alias("prev"))
    seen = named.select(issue("pagination", "info", "pagination-detected", F.coalesce("next", "prev").isNotNull(), next=F.col("next"), prev=F.col("prev")).alias("i")).where("i IS NOT NULL")
    each = named.select(F.col("final_url").alias("page"), F.explode(F.create_map(F.lit("next"), "next", F.lit("prev"), "prev")).alias("rel", "href")).where("href IS NOT NULL")
    each = each.withColumn("full", U.resolve(F.col("page"), F.col("href")))
    hit = each.join(page_index(pages), U.index_key(F.col("full")) == F.col("key"))
    bad = (F.col("status_code") >= 400) | _moved(F.col("full"), F.col("final_url"))
    broken = flat(hit, found(issue("pagination", "warning", "pagination-broken", bad, url=F.col("page"), target=F.col("href"), rel=F.col("rel"), status=F.col("status_code"))))
    return seen.select("i.*").unionAll(broken)


def amp(pages: DataFrame) -> DataFrame:
    good = pages.where(GATE())
    amp_page = f("html_amp")
    runtime = F.exists(f("script_srcs"), lambda s: s.startswith("https://cdn.ampproject.org/v0.js"))
    own = flat(
        good,
        found(
            issue("amp", "info", "amp-detected", amp_page),
            issue("amp", "warning", "amp-missing-canonical", amp_page & (F.size(link_hrefs("canonical")) == 0)),
            issue("amp", "error", "amp-missing-runtime", amp_page & ~runtime),
        ),
    )
    href = T.strip(F.get(link_hrefs("amphtml"), 0))
    linked = good.where(~amp_page & ~T.blank(href)).select(F.col("final_url").alias("page"), href.alias("href"))
    linked = linked.withColumn("full", U.resolve(F.col("page"), F.col("href")))
    hit = linked.join(page_index(pages), U.index_key(F.col("full")) == F.col("key"), "left")
    bad = F.coalesce((F.col("status_code") >= 400) | _moved(F.col("full"), F.col("final_url")), F.lit(False))
    issues = found(
        issue("amp", "warning", "amp-broken-amphtml", bad, url=F.col("page"), target=F.col("href")),
        issue("amp", "info", "amp-amphtml-linked", ~bad, url=F.col("page"), target=F.col("href")),
    )
    return own.unionAll(flat(hit, issues))


#: Three-letter codes in use beside the two-letter ones, which are taken by form.
_LANG3 = ["fil", "yue", "cmn", "haw", "ceb", "hmn", "gsw", "nds", "ast", "mul", "und", "zxx"]
_TAG = r"(?i)^(x(-[a-z0-9]{1,8})+|([a-z]{2}|" + "|".join(_LANG3) + r")(-[a-z]{3}){0,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?(-([a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(-[a-wy-z0-9](-[a-z0-9]{2,8})+)*(-x(-[a-z0-9]{1,8})+)?)$"


def valid_language(code: Column) -> Column:
    return F.regexp_replace(code, "_", "-").rlike(_TAG)


def hreflang(pages: DataFrame) -> DataFrame:
    good = pages.where(GATE())
    entries = F.filter(f("links"), lambda x: F.coalesce((F.lower(x["rel"]) == "alternate") & x["hreflang"].isNotNull(), F.lit(False)))
    clusters = good.select("page_seq", F.col("final_url").alias("page"), entries.alias("e")).where(F.size("e") > 0)
    index = page_index(pages).select(F.col("key"), F.col("page_seq").alias("to"))
    edges = clusters.select("page_seq", "page", F.posexplode("e").alias("pos", "x")).join(index, U.index_key(F.col("x.href")) == F.col("key"), "left")
    edges = edges.select("page_seq", "page", "pos", "x", "to")
    back = edges.where("to IS NOT NULL").select(F.col("to").alias("b_from"), F.col("page_seq").alias("b_to")).distinct()
    lost = edges.where("to IS NOT NULL AND to <> page_seq").join(back, (F.col("b_from") == F.col("page_seq")) & (F.col("b_to") == F.col("to")), "left_anti")
    own = edges.groupBy("page_seq", "page").agg(F.max(F.coalesce(F.col("to") == F.col("page_seq"), F.lit(False))).alias("me"), F.max(F.lower("x.hreflang") == "x-default").alias("any"))
    wrong = flat(edges, found(issue("hreflang", "warning", "hreflang-invalid-code", ~valid_language(T.strip(F.col("x.hreflang"))), url=F.col("page"), code=F.col("x.hreflang"))))
    whole = flat(
        own,
        found(
            issue("hreflang", "info", "hreflang-missing-x-default", ~F.col("any"), url=F.col("page")),
            issue("hreflang", "info", "hreflang-missing-self", ~F.col("me"), url=F.col("page")),
        ),
    )
    return wrong.unionAll(whole).unionAll(flat(lost, F.array(issue("hreflang", "warning", "hreflang-no-return-link", url=F.col("page"), target=F.col("x.href")))))


def duplicates(pages: DataFrame) -> DataFrame:
    """Groups by text hash, title and description, pages counted by key without query and fragment."""
    good = pages.where(GATE()).select(
        U.page_key(F.col("final_url")).alias("pk"),
        "final_url",
        F.explode(
            F.array(
                F.struct(F.lit("duplicate-content").alias("code"), F.lit("warning").alias("severity"), f("content_hash").alias("value")),
                F.struct(F.lit("duplicate-title").alias("code"), F.lit("warning").alias("severity"), T.strip(f("title_head_all")).alias("value")),
                F.struct(F.lit("duplicate-meta-description").alias("code"), F.lit("info").alias("severity"), T.strip(F.coalesce(F.get(F.filter(f("metas"), lambda m: m["in_head"] & (m["name"] == "description")), 0)["content"], F.lit(""))).alias("value")),
            )
        ).alias("g"),
    )
    good = good.select("pk", "final_url", "g.*").where("value <> ''")
    # of the variants of a page, the bare URL speaks for it, then the shorter, then the first
    bare = F.struct((F.col("final_url") != F.col("pk")).cast("int").alias("a"), F.octet_length("final_url").alias("b"), F.col("final_url").alias("c"))
    kept = good.groupBy("code", "severity", "value", "pk").agg(F.min(bare)["c"].alias("url"))
    sizes = kept.groupBy("code", "value").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("lowest")).where("n > 1")
    # the ten smallest members name the others of any member, so no group is gathered whole
    top = kept.withColumn("r", F.row_number().over(Window.partitionBy("code", "value").orderBy("url"))).where("r <= 11")
    names = top.groupBy("code", "value").agg(F.sort_array(F.collect_list("url")).alias("names"))
    rows = kept.join(sizes.drop("lowest"), ["code", "value"]).join(names, ["code", "value"])
    others = F.slice(F.array_remove("names", F.col("url")), 1, 10)
    made = F.coalesce(*(issue("duplicates", s, c, F.col("code") == c, url=F.col("url"), duplicates=others, group_size=F.col("n"), title=F.when(F.col("code") == "duplicate-title", F.col("value"))) for c, s in (("duplicate-content", "warning"), ("duplicate-title", "warning"), ("duplicate-meta-description", "info"))))
    return rows.select(made.alias("i")).select("i.*")


def content(pages: DataFrame) -> DataFrame:
    good = pages.where(GATE()).select("final_url", f("body_words").alias("words"))
    facts = good.agg(F.avg("words").alias("mean"), F.count(F.lit(1)).alias("n"))  # one row
    low = (F.col("n") >= 3) & (F.col("mean") > 0) & (F.col("words") < 0.5 * F.col("mean"))
    issues = found(
        issue("content", "warning", "content-thin", F.col("words") < 100, words=F.col("words")),
        issue("content", "info", "content-low", (F.col("words") >= 100) & low, words=F.col("words"), site_average=F.floor(F.col("mean") + 0.5)),
    )
    return flat(good.join(F.broadcast(facts)), issues)


def landing(pages: DataFrame) -> DataFrame:
    """Pages that campaign links lead to, or that carry campaign tags themselves."""
    urls = F.concat(F.array(F.col("final_url")), F.coalesce(F.transform(f("anchors"), lambda a: a["resolved"]), F.array().cast("array<string>")))
    sources = pages.select("page_seq", F.posexplode(urls).alias("pos", "u"))
    of = lambda u, k: F.flatten(F.transform(F.filter(U.query_pairs(u), lambda p: F.lower(p["key"]) == k), lambda p: T.tokens(p["value"])))
    terms = lambda u: F.flatten(F.transform(F.array(*map(F.lit, S.CAMPAIGN_KEYS)), lambda k: of(u, k)))
    tagged = sources.where(F.lower(U.query(F.col("u"))).contains("utm_")).select(U.landing_key(F.col("u")).alias("key"), "page_seq", "pos", F.posexplode_outer(terms(F.col("u"))).alias("place", "term"))
    # a term counts once, where it comes first by page, link and key; pages that name no term stay
    once = tagged.groupBy("key", "term").agg(F.min(F.struct("page_seq", "pos", "place")).alias("at"))
    campaign = once.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("at", "term")))).alias("terms"))
    campaign = campaign.withColumn("terms", F.transform("terms", lambda x: x["term"]))
    hit = pages.where(GATE()).join(campaign, U.landing_key(F.col("final_url")) == F.col("key"))
    heads = F.array_join(F.transform(F.filter(f("headings"), lambda h: h["level"] <= 2), lambda h: h["text"]), " ")
    strong = T.tokens(F.concat_ws(" ", f("title_head_first"), heads))
    matched, missing = F.array_intersect("terms", strong), F.array_except("terms", strong)
    share = F.size(matched) / F.size("terms")
    i = lambda sev, code, when, **k: issue("landing", sev, code, when, **k)
    facts = {"campaign_terms": F.col("terms"), "matched": matched, "missing": missing, "coverage": T.half_away(share, 2)}
    some = F.size("terms") > 0
    robots = meta("robots", False)
    return flat(
        hit,
        found(
            i("warning", "landing-not-https", ~F.lower(F.col("final_url")).startswith("https://")),
            i("error", "landing-noindex", F.lower(robots).contains("noindex"), robots=robots),
            i("warning", "landing-missing-title", T.blank(f("title_head_first"))),
            i("warning", "landing-missing-h1", ~F.exists(f("headings"), lambda h: h["level"] == 1)),
            i("info", "landing-missing-description", meta("description", False) == ""),
            i("warning", "landing-keyword-mismatch", some & (share < 0.2), **facts),
            i("info", "landing-keyword-weak", some & (share >= 0.2) & (share < 0.5), **facts),
            i("info", "landing-keyword-aligned", some & (share >= 0.5), **facts),
        ),
    )


def wordpress_site(pages: DataFrame, seed: str) -> DataFrame:
    """One row of facts for the site, turned into its issues; pages need ``wp`` (``wordpress_signals``)."""
    good = pages.where(GATE())
    facts = good.agg(
        F.coalesce(F.max("wp.detected"), F.lit(False)).alias("detected"),
        F.min_by(F.when(F.col("wp.version") != "", F.col("wp.version")), F.when(F.col("wp.version") != "", F.col("page_seq"))).alias("version"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("wp.plugins")))).alias("plugins"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("wp.seo")))).alias("seo"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("wp.i18n")))).alias("i18n"),
        *(F.coalesce(F.max(f"wp.{c}"), F.lit(False)).alias(c) for c in ("emoji", "migrate", "tagline", "hreflang")),
    )
    c, at = F.col, F.lit(seed)
    i = lambda sev, code, when, **k: issue("wordpress", sev, code, c("detected") & when, url=at, **k)
    n = F.size("plugins")
    first = lambda x: F.when(F.size(x) > 0, F.array_join(x, ", "))
    return flat(
        facts,
        found(
            i("info", "wp-detected", F.lit(True), plugins=c("plugins"), plugin_count=n, version=c("version"), seo_plugin=first("seo"), i18n_plugin=first("i18n")),
            i("warning", "wp-version-exposed", c("version").isNotNull(), version=c("version")),
            i("info", "wp-emoji-enabled", c("emoji")),
            i("info", "wp-jquery-migrate", c("migrate")),
            i("warning", "wp-many-plugin-assets", n >= S.MANY_PLUGINS, plugins=c("plugins"), plugin_count=n),
            i("warning", "wp-default-tagline", c("tagline")),
            i("info", "wp-no-seo-plugin", F.size("seo") == 0),
            i("warning", "wp-multiple-seo-plugins", F.size("seo") > 1, plugins=c("seo")),
            i("info", "wp-multilingual-detected", F.size("i18n") > 0, plugins=c("i18n")),
            i("warning", "wp-i18n-no-hreflang", (F.size("i18n") > 0) & ~c("hreflang"), plugins=c("i18n")),
        ),
    )


def wordpress_signals() -> Column:
    """What one page shows of WordPress, from its features and its HTML."""
    body, assets = F.lower(F.coalesce("html", F.lit(""))), F.coalesce(f("assets"), F.lit(""))
    generator = meta("generator", False)

    def judged(s: Column) -> Column:
        b, a = s["b"], s["a"]
        both = F.concat(F.lower(a), F.lit("\n"), b)
        named = lambda text, table: F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in table))))
        wp = F.lower(generator).startswith("wordpress")
        told = (~T.blank(header("x-pingback"))) | F.coalesce(header("link"), F.lit("")).contains("api.w.org")
        return F.struct(
            (wp | told | a.contains("/wp-content/") | a.contains("/wp-includes/") | b.contains("/wp-json/")).alias("detected"),
            F.when(wp, T.strip(F.substring(generator, 10, 1 << 20))).otherwise("").alias("version"),
            F.array_distinct(F.regexp_extract_all(a, F.lit(S.PLUGIN_SLUG), F.lit(1))).alias("plugins"),
            named(b, S.SEO_PLUGINS).alias("seo"),
            named(both, S.I18N_PLUGINS).alias("i18n"),
            (a.contains("wp-emoji-release") | b.contains("_wpemojisettings")).alias("emoji"),
            a.contains("jquery-migrate").alias("migrate"),
            b.contains("just another wordpress site").alias("tagline"),
            F.exists(f("links"), lambda x: F.coalesce((x["rel"] == "alternate") & x["hreflang"].isNotNull(), F.lit(False))).alias("hreflang"),
        )

    return F.when(F.col("f").isNotNull(), F.transform(F.array(F.struct(body.alias("b"), assets.alias("a"))), judged)[0])


def wordpress_probes(probes: DataFrame, seed: str) -> DataFrame:
    """Opt-in: ``probe, url, status_code, final_url, body`` of five known endpoints; issues name the endpoint."""
    body, low, ok = F.col("body"), F.lower("body"), F.col("status_code") == 200
    slugs = F.filter(F.transform(F.from_json("body", "array<struct<slug: string>>"), lambda u: u["slug"]), lambda s: s != "")
    login = F.regexp_extract(U.decoded_path(F.col("final_url")), "/author/([^/]+)", 1)
    version = F.regexp_extract(body, S.README_VERSION, 1)
    i = lambda code, name, when, **k: issue("wordpress", "warning", code, (F.col("probe") == name) & when, url=F.coalesce(F.col("url"), F.lit(seed)), **k)
    return flat(
        probes,
        found(
            i("wp-xmlrpc-enabled", "xmlrpc", F.col("status_code").isin(200, 405) & low.contains("xml-rpc")),
            i("wp-user-enumeration-rest", "users", ok & (F.size(slugs) > 0), usernames=slugs, count=F.size(slugs)),
            i("wp-user-enumeration-author", "author", login != "", username=login),
            i("wp-directory-listing", "uploads", ok & low.contains("index of")),
            i("wp-readme-exposed", "readme", ok & low.contains("wordpress"), version=F.when(version != "", version)),
        ),
    )


def crawl_facts(pages: DataFrame) -> DataFrame:
    """One row: what depends on any page of the crawl."""
    return pages.agg(
        F.coalesce(F.max(F.col("render.implemented")), F.lit(False)).alias("any_rendered"),
        F.coalesce(F.max(F.when(GATE(), F.col("render.implemented"))), F.lit(False)).alias("any_html_rendered"),
        F.coalesce(F.max(F.when(GATE(), F.col("wp.detected"))), F.lit(False)).alias("is_wordpress"),
    )


def not_collected(facts: DataFrame, seed: str) -> dict[str, DataFrame]:
    return {
        "perf": flat(facts, found(issue("perf", "info", "perf-cwv-not-collected", ~F.col("any_rendered"), url=F.lit(seed)))),
        "datalayer": flat(facts, found(issue("datalayer", "info", "datalayer-not-collected", ~F.col("any_html_rendered"), url=F.lit(seed)))),
    }
