"""Queries whose input is derived from the given tables by a rule that SQL can state too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import robots
from ..streaming import throttle
from . import audit
from .registry import _t, kept, query

_ORIGIN = "^(https?://[^/?#]*)"

# --- references ------------------------------------------------------------------------------

#: What is put before each link's path, so that every form of a reference occurs.
FORMS = ["", ".", "..", "./..", "../../..", "x/./y/..", "../x/..", "//Cdn.example:8080/a/..", "?q=", "#", "HTTPS://b.example/./c/../.."]
_FOLD = """list_reduce(string_split(regexp_replace({p}, '^/', ''), '/'), lambda held, s: CASE s WHEN '..' THEN regexp_replace(held, '/[^/]*$', '') WHEN '.' THEN held ELSE held || '/' || s END, '')
  || CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END"""


def _dots(p: str) -> str:
    return f"CASE WHEN ({_FOLD.format(p=p)}) = '' THEN '/' ELSE {_FOLD.format(p=p)} END"


@query(rf"""WITH h AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
  r AS (SELECT page_id, url, f || href AS ref, regexp_extract(url, '{_ORIGIN}', 1) AS origin, regexp_extract(url, '^[a-z]+', 0) AS s,
    regexp_replace(regexp_replace(url, '{_ORIGIN}', ''), '[?#].*$', '') AS path, regexp_extract(url, '([?][^#]*)', 1) AS q
    FROM h, (SELECT unnest([{', '.join(repr(f) for f in FORMS)}]) AS f)),
  m AS (SELECT *, regexp_replace(path, '[^/]*$', '') || ref AS merged, regexp_replace(ref, '^[^/]*//[^/]*', '') AS rest FROM r)
  SELECT page_id, ref, CASE
    WHEN ref LIKE 'HTTPS:%' THEN 'HTTPS://b.example' || {_dots('rest')}
    WHEN ref LIKE '//%' THEN s || '://Cdn.example:8080' || {_dots('rest')}
    WHEN ref LIKE '/%' THEN origin || {_dots('ref')}
    WHEN ref LIKE '?%' THEN origin || path || ref
    WHEN ref LIKE '#%' THEN origin || path || q || ref
    ELSE origin || {_dots('merged')} END AS resolved FROM m""")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages in every relative form, resolved against the page's URL."""
    hrefs = _t(spark, d, "pages").select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("href"))
    forms = hrefs.select("page_id", "url", F.explode(F.transform(F.array(*map(F.lit, FORMS)), lambda f: F.concat(f, F.col("href")))).alias("ref"))
    return forms.select("page_id", "ref", U.resolve(F.col("url"), F.col("ref")).alias("resolved"))


# --- robots ----------------------------------------------------------------------------------

#: A page's own rule, by its number: what precedes the pattern, and the pattern as SQL and as an expression over the path.
_RULES = """CASE page_id % 6 WHEN 0 THEN 'Disallow: ' || substr(path, 1, 5) WHEN 1 THEN 'Allow: ' || path || '$' WHEN 2 THEN 'Disallow: /*' || substr(path, length(path) - 2) || '$'
  WHEN 3 THEN 'Disallow: /*/' || substr(path, length(path) - 1) || '*' WHEN 4 THEN 'Allow: /fr/*7' ELSE 'Disallow: /en/' END"""


@query(rf"""WITH p AS (SELECT page_id, right(host, 3) AS zone, path FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
    regexp_replace(regexp_replace(url, '{_ORIGIN}', ''), '#.*$', '') AS path FROM pages)),
  l AS (SELECT DISTINCT zone, trim(split_part(rule, ':', 1)) AS kind, trim(split_part(rule, ':', 2)) AS pattern FROM (SELECT zone, {_RULES} AS rule FROM p)),
  e AS (SELECT *, '^' || regexp_replace(replace(regexp_replace(pattern, '([.?+()\[\]])', '\\\1', 'g'), '*', '.*'), '\$$', '$') AS expression FROM l),
  v AS (SELECT page_id, arg_max(kind, length(pattern) * 2 + (kind = 'Allow')::INT) AS kind FROM p JOIN e ON p.zone = e.zone AND regexp_matches(p.path, e.expression) GROUP BY page_id)
  SELECT p.page_id, coalesce(kind, 'Allow') = 'Allow' AS allowed FROM p LEFT JOIN v ON p.page_id = v.page_id""")
def robots_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every page against one robots file per top-level domain that has a rule of each of its pages."""
    url = F.col("url")
    p = _t(spark, d, "pages").select("page_id", F.right(U.host(url), F.lit(3)).alias("zone"), robots.robots_path(url).alias("path"))
    lines = p.select("zone", F.expr(_RULES).alias("rule")).distinct()
    body = F.concat(F.lit("User-agent: *\n"), F.array_join(F.sort_array(F.collect_list("rule")), "\n"))  # a file: as long as its zone's distinct rules
    files = lines.groupBy("zone").agg(body.alias("body")).select(F.lit("https").alias("scheme"), F.col("zone").alias("host"), F.lit(200).alias("status"), "body")
    asked = p.select("page_id", F.lit("https").alias("scheme"), F.col("zone").alias("host"), "path")
    return asked.join(robots.verdicts(asked, robots.with_rules(files), "anybot"), ["scheme", "host", "path"]).select("page_id", F.col("ok").alias("allowed"))


# --- the limiter -----------------------------------------------------------------------------

#: Errors as answers of 20 hosts: 503, 429 or another status, some with a Retry-After.
_ANSWERS = """SELECT user_id % 20 AS host, (epoch_us(ts) / 1e6) / 3600 AS t, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 500 END AS status,
  CASE WHEN event_id % 4 = 0 THEN round(value) ELSE 0 END AS retry FROM events WHERE event_type = 'error'"""


@query(f"""WITH RECURSIVE a AS ({_ANSWERS}), b AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t, seq) AS k FROM a WHERE status <> 500),
  s AS (SELECT DISTINCT host, 0::BIGINT AS k, -1e18::DOUBLE AS last, 0::DOUBLE AS rate, 0::DOUBLE AS free FROM a
    UNION ALL SELECT s.host, b.k, CASE WHEN hit THEN b.t ELSE s.last END, CASE WHEN hit THEN next ELSE s.rate END,
      CASE WHEN hit THEN greatest(s.free, b.t + greatest(least(b.retry, 300), 1 / next)) ELSE s.free END
    FROM s JOIN b ON b.host = s.host AND b.k = s.k + 1,
      LATERAL (SELECT b.t - s.last >= 2 AS hit, CASE WHEN b.retry > 0 THEN least(slow, 1 / least(b.retry, 300)) ELSE slow END AS next
        FROM (SELECT CASE WHEN s.rate = 0 THEN 1.0 ELSE greatest(s.rate / 2, 0.1) END AS slow))),
  n AS (SELECT host, rate, free FROM s QUALIFY row_number() OVER (PARTITION BY host ORDER BY k DESC) = 1),
  g AS (SELECT host, max(t) - 0.25 AS sent FROM a GROUP BY host),
  z AS (SELECT n.host, rate, greatest(free, CASE WHEN rate > 0 THEN sent + 1 / rate ELSE 0 END) AS free FROM n JOIN g ON n.host = g.host),
  r AS (SELECT event_id, user_id % 20 AS host, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS before FROM events WHERE event_type = 'view')
  SELECT event_id, CAST(r.host AS VARCHAR) AS host, round(coalesce(rate, 0), 6) AS rate,
    round(greatest(480000, coalesce(free, 0)) + CASE WHEN rate > 0 THEN before / rate ELSE 0 END, 3) AS send_at FROM r LEFT JOIN z ON r.host = z.host""")
def limiter_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When each view would be asked for, after a wave in which the errors were the answers: the limiter's table, folded and read."""
    e = _t(spark, d, "events")
    host = F.pmod("user_id", F.lit(20)).cast("string").alias("host")
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6 / 3600
    status = F.when(F.col("event_id") % 3 == 0, 429).when(F.col("event_id") % 3 == 1, 503).otherwise(500)
    retry = F.when(F.col("event_id") % 4 == 0, F.round("value")).otherwise(0.0)
    answers = e.where("event_type = 'error'").select(host, at.alias("at"), F.col("event_id").alias("seq"), (at - 0.25).alias("sent_at"), status.alias("status_code"), retry.alias("retry_after"))
    state = throttle.carried(spark.createDataFrame([], throttle.STATE), answers)
    asked = e.where("event_type = 'view'").select("event_id", host, F.col("event_id").alias("rank"))
    return throttle.schedule(asked, state, 480000.0).select("event_id", "host", F.round("rate", 6).alias("rate"), F.round("send_at", 3).alias("send_at"))


# --- page rules over crawls that each page's number describes --------------------------------


def _crawl(spark: SparkSession, d: str, values: str, **columns: str) -> DataFrame:
    """``pages`` as a crawl: ``values`` names parts by the number ``i`` and the URL, ``columns`` are made of them; what isn't named is as it is when all is well."""
    plain = audit.crawl_of(audit.spread(_t(spark, d, "pages")))
    parts = plain.selectExpr("*", "page_seq AS i", "requested_url AS url").selectExpr("*", *(f"{e} AS {n}" for n, e in _parts(values)))
    kinds = {f.name: f.dataType for f in plain.schema}
    return parts.select(*(F.expr(columns[c]).cast(kinds[c]).alias(c) if c in columns else F.col(c) for c in plain.columns))


def _parts(values: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" := ", 1)) for line in values.strip().splitlines() if line.strip()]  # type: ignore[misc]


def _expected(values: str, rules: list[tuple[str, str, str, str]], url: str = "url") -> str:
    """SQL of the issues: a row for each page and rule ``(code, severity, condition, data)``; a rule may name its own URL after its code."""
    made = ", ".join(f"{e} AS {n.strip()}" for n, e in _parts(values))
    each = []
    for name, severity, when, data in rules:
        code, _, own = name.partition(" ")
        each.append(f"SELECT {own or url} AS url, '{code}' AS code, '{severity}' AS severity, CAST({data or 'NULL'} AS VARCHAR) AS data FROM c WHERE {when}")
    return f"WITH p AS (SELECT page_id AS i, url FROM pages), c AS (SELECT *, {made} FROM p) " + " UNION ALL ".join(each)


def _issues(pages: DataFrame, *names: str, **options) -> DataFrame:
    return audit.audit(kept(audit.prepare(pages)), audit.Options(enabled=list(names), seed="https://example.org/", **options)).select("url", "code", "severity", "data")


_HEADS = """
title := substr(repeat('abcdefghij', 8), 1, CAST(i % 75 AS INT))
description := substr(repeat('klmnopqrst', 20), 1, CAST(i % 190 AS INT))
robots := CASE i % 5 WHEN 0 THEN 'noindex' WHEN 1 THEN 'nofollow' WHEN 2 THEN 'noindex, nofollow' ELSE '' END
x_robots := CASE i % 7 WHEN 0 THEN 'NoIndex' WHEN 1 THEN 'nofollow' ELSE '' END
"""
_HEADS_HTML = """'<html' || CASE WHEN i % 4 = 1 THEN '' ELSE ' lang="en"' END || '><head>' || CASE WHEN i % 5 = 3 THEN '' ELSE '<meta charset="utf-8">' END
  || CASE WHEN i % 5 = 2 THEN '' ELSE '<meta name="viewport" content="x">' END || CASE WHEN i % 5 = 4 THEN '' ELSE '<meta property="og:title" content="x">' END
  || '<title>' || title || '</title><meta name="description" content="' || description || '"><meta name="robots" content="' || robots || '">'
  || CASE WHEN i % 11 = 0 THEN '<meta http-equiv="refresh" content="5; url=/x">' ELSE '' END
  || repeat('<link rel="canonical" href="/c">', CASE WHEN i % 10 = 0 THEN 0 WHEN i % 10 < 7 THEN 1 ELSE 2 END) || '</head><body>' || repeat('<h1>One</h1>', CAST(i % 3 AS INT))
  || '<h2>Two</h2>' || CASE WHEN i % 4 = 0 THEN '<h4>Four</h4>' ELSE '' END || CASE WHEN i % 6 = 0 THEN '<h3> </h3>' ELSE '' END || '</body></html>'"""


@query(_expected(_HEADS, [
    ("seo-missing-title", "error", "title = ''", ""), ("seo-short-title", "warning", "length(title) BETWEEN 1 AND 9", "json_object('length', length(title), 'title', title)"),
    ("seo-long-title", "warning", "length(title) > 60", "json_object('length', length(title), 'title', title)"), ("seo-missing-meta-description", "warning", "description = ''", ""),
    ("seo-short-meta-description", "info", "length(description) BETWEEN 1 AND 49", "json_object('length', length(description))"),
    ("seo-long-meta-description", "info", "length(description) > 160", "json_object('length', length(description))"),
    ("seo-meta-noindex", "warning", "i % 5 IN (0, 2)", "json_object('robots', robots)"), ("seo-meta-nofollow", "info", "i % 5 IN (1, 2)", "json_object('robots', robots)"),
    ("seo-x-robots-noindex", "warning", "i % 7 = 0", "json_object('x_robots_tag', x_robots)"), ("seo-x-robots-nofollow", "info", "i % 7 = 1", "json_object('x_robots_tag', x_robots)"),
    ("seo-meta-refresh", "warning", "i % 11 = 0", "json_object('content', '5; url=/x')"), ("seo-missing-canonical", "info", "i % 10 = 0", ""), ("seo-multiple-canonical", "warning", "i % 10 >= 7", ""),
    ("seo-missing-h1", "warning", "i % 3 = 0", ""), ("seo-multiple-h1", "info", "i % 3 = 2", "json_object('count', 2)"), ("seo-empty-heading", "warning", "i % 6 = 0", "json_object('tag', 'h3')"),
    ("seo-skipped-heading-level", "info", "i % 4 = 0", "json_object('from', 2, 'to', 4)"), ("seo-missing-lang", "info", "i % 4 = 1", ""), ("seo-missing-viewport", "info", "i % 5 = 2", ""),
    ("seo-missing-charset", "info", "i % 5 = 3", ""), ("seo-missing-opengraph", "info", "i % 5 = 4", ""),
]))
def heads_audited(spark: SparkSession, d: str) -> DataFrame:
    """Every rule on titles, descriptions, directives and headings, with its data."""
    return _issues(_crawl(spark, d, _HEADS, html=_HEADS_HTML, headers="CASE WHEN x_robots <> '' THEN map('X-Robots-Tag', array(x_robots)) END"), "seo")


_ANSWERED = """
own := regexp_replace(url, '^http:', 'https:')
k := i % 9
referred := CASE WHEN i % 2 = 0 THEN 'http://r.example/' END
pictures := i % 7
took := CASE WHEN i % 9 = 7 THEN 2500 ELSE 10 * (i % 3) END
"""
_FINAL = "own || CASE k WHEN 1 THEN '2' WHEN 2 THEN '1' ELSE '' END"
_FOUND_ON = "CASE WHEN referred IS NULL THEN json_object({0}) ELSE json_object({1}) END"


@query(_expected(_ANSWERED, [
    ("http-redirect-loop own", "error", "k = 0", "json_object('chain', [own, own || 'x', own])"), ("http-redirect-chain own", "warning", "k = 1", "json_object('chain', [own, own || '1', own || '2'], 'hops', 2)"),
    ("http-redirect own", "info", "k = 2", "json_object('status', 301, 'to', own || '1')"),
    ("http-fetch-error own", "error", "k = 3", _FOUND_ON.format("'error', 'timeout'", "'error', 'timeout', 'found_on', referred")),
    ("http-server-error own", "error", "k = 4", _FOUND_ON.format("'status', 503", "'found_on', referred, 'status', 503")), ("http-client-error own", "error", "k = 5", _FOUND_ON.format("'status', 404", "'found_on', referred, 'status', 404")),
    ("http-body-truncated own", "warning", "k = 6", ""), ("http-slow-response own", "warning", "took > 2000", "json_object('duration_ms', took)"),
    ("http-mixed-content own", "warning", "k <> 3 AND pictures > 0", "json_object('count', least(pictures, 5), 'examples', list_transform(range(least(pictures, 5)), lambda n: 'http://a.example/' || n || '.png'))"),
    ("security-missing-hsts", "warning", "k NOT IN (3, 4, 5) AND i % 4 IN (1, 3)", ""), ("security-missing-csp", "info", "k NOT IN (3, 4, 5) AND i % 4 IN (1, 2)", ""),
    ("security-missing-x-content-type-options", "info", "k NOT IN (3, 4, 5) AND i % 4 IN (1, 3)", ""),
    ("security-insecure-form", "warning", "k NOT IN (3, 4, 5) AND i % 5 = 0", "json_object('action', 'http://f.example/')"),
    ("perf-response-time", "info", "k NOT IN (3, 4, 5) AND took > 0", "json_object('duration_ms', took)"),
], url=_FINAL))
def responses_audited(spark: SparkSession, d: str) -> DataFrame:
    """Every rule on redirects, statuses, bodies, times, security headers and forms, with its data."""
    pages = _crawl(
        spark, d, _ANSWERED, requested_url="own", final_url=_FINAL, status_code="CASE k WHEN 3 THEN 0 WHEN 4 THEN 503 WHEN 5 THEN 404 ELSE 200 END", err="CASE WHEN k = 3 THEN 'timeout' ELSE '' END",
        content_type="CASE WHEN k = 3 THEN '' ELSE 'text/html' END", truncated="k = 6", duration_ms="took", referrer="coalesce(referred, '')",
        redirects="""CASE k WHEN 0 THEN from_json('[{"from":"' || own || '","to":"' || own || 'x","status":301},{"from":"' || own || 'x","to":"' || own || '","status":302}]', 'array<struct<from:string,to:string,status:int>>')
          WHEN 1 THEN from_json('[{"from":"' || own || '","to":"' || own || '1","status":301},{"from":"' || own || '1","to":"' || own || '2","status":302}]', 'array<struct<from:string,to:string,status:int>>')
          WHEN 2 THEN from_json('[{"from":"' || own || '","to":"' || own || '1","status":301}]', 'array<struct<from:string,to:string,status:int>>') ELSE from_json('[]', 'array<struct<from:string,to:string,status:int>>') END""",
        headers="""CASE i % 4 WHEN 1 THEN map('Server', array('x')) WHEN 2 THEN map('Strict-Transport-Security', array('max-age=1'), 'X-Content-Type-Options', array('NoSniff'))
          WHEN 3 THEN map('content-security-policy', array('x')) END""",
        html="""'<body>' || array_join(transform(sequence(0, 6), n -> CASE WHEN n < pictures THEN '<img src="http://a.example/' || n || '.png">' ELSE '' END), '')
          || CASE WHEN i % 5 = 0 THEN '<form action="http://f.example/"></form>' ELSE '' END""",
    )
    return _issues(pages, "redirects", "security", "perf").where("code <> 'perf-cwv-not-collected'")


_RENDERS = """
done := i % 4 <> 0
lcp := CAST((i * 37) % 6000 AS DOUBLE)
fcp := CAST((i * 29) % 4500 AS DOUBLE)
cls := CAST(i % 40 AS DOUBLE) / 100
tbt := CAST((i * 7) % 900 AS DOUBLE)
ttfb := CAST((i * 13) % 2500 AS DOUBLE)
"""


def _vital(name: str, good: float, fair: float) -> list[tuple[str, str, str, str]]:
    value, at = ("value", "threshold") if name == "cls" else ("value_ms", "threshold_ms")
    said = lambda t: f"json_object('{at}', {t}::DOUBLE, '{value}', {name})"
    return [(f"perf-{name}-needs-improvement", "warning", f"done AND {name} > {good} AND {name} <= {fair}", said(good)), (f"perf-{name}-poor", "error", f"done AND {name} > {fair}", said(fair))]


@query(_expected(_RENDERS, [
    ("perf-cwv-measured", "info", "done", "json_object('cls', cls, 'fcp_ms', fcp, 'lcp_ms', lcp, 'tbt_ms', tbt, 'ttfb_ms', ttfb)"), ("perf-cwv-render-failed", "info", "i % 8 = 0", "json_object('note', 'crashed')"),
    ("perf-render-incomplete", "warning", "i % 5 = 0", "json_object('raw_bytes', 2 * i, 'rendered_bytes', i)"),
    *_vital("lcp", 2500, 4000), *_vital("fcp", 1800, 3000), *_vital("cls", 0.1, 0.25), *_vital("tbt", 200, 600), *_vital("ttfb", 800, 1800),
]))
def renders_audited(spark: SparkSession, d: str) -> DataFrame:
    """Every rule on rendered pages and their vitals, with its data."""
    render = """named_struct('implemented', done, 'note', CASE WHEN i % 8 = 0 THEN 'crashed' ELSE '' END, 'raw_fallback', i % 5 = 0, 'rendered_bytes', CAST(i AS INT), 'raw_bytes', CAST(2 * i AS INT),
      'lcp_ms', lcp, 'fcp_ms', fcp, 'cls', cls, 'tbt_ms', tbt, 'ttfb_ms', ttfb, 'data_layer_present', false, 'data_layer', array(''), 'requests', array(''))"""
    return _issues(_crawl(spark, d, _RENDERS, render=render, html="'<p>x'"), "perf")


_MARKUP = r"""
origin := lower(regexp_extract(url, '^(https?://[^/?#]*)', 1))
good := i % 7 NOT IN (1, 3)
j := i % 6
bare := i % 4
asked := i % 5 + CASE WHEN i % 10 = 1 THEN 1 ELSE 0 END
long_text := i % 9 = 0
landmark := i % 11 = 0 OR i % 8 = 0
u := i % 6
leads := CASE i % 6 WHEN 0 THEN 'http://out.example/?utm_source=a&utm_medium=b&utm_campaign=c' WHEN 1 THEN '/z?utm_source=a' WHEN 2 THEN 'http://out.example/?utm_source=&utm_medium=b&utm_campaign=c' WHEN 3 THEN 'http://out.example/?utm_source=a&utm_source=b&utm_medium=b&utm_campaign=c' WHEN 4 THEN 'http://out.example/?UTM_Source=a&utm_medium=b&utm_campaign=c' ELSE '' END
"""
_TARGET = "CASE WHEN u = 1 THEN origin || leads ELSE leads END"
_MARKUP_HTML = """'<html><head><title>' || CASE WHEN i % 7 = 3 THEN 'Just a moment' ELSE 'Plain' END || '</title>'
  || CASE j WHEN 0 THEN '' ELSE '<script type="application/ld+json">' || CASE j WHEN 1 THEN '{bad' WHEN 2 THEN '{"@type":"Product"}' WHEN 3 THEN '{"@type":"FAQPage","mainEntity":{"@type":"Question"}}'
    WHEN 4 THEN '{"@type":"Article","headline":"h","author":"a"}' ELSE '{"@type":"VideoObject","name":"n","thumbnailUrl":"t"}' END || '</script>' END
  || CASE i % 4 WHEN 1 THEN '<script src="https://www.googletagmanager.com/gtm.js?id=GTM-AB12"></script>' WHEN 2 THEN '<script>x("UA-11-1");x("UA-22-1")</script>'
    WHEN 3 THEN '<script>x("UA-11-1");x("G-ABCD12")</script>' ELSE '' END || '</head><body>'
  || CASE WHEN i % 2 = 0 THEN '<h1>What now?</h1>' ELSE '' END || CASE WHEN i % 11 = 0 THEN '<main>' || repeat('m ', 305) || '</main>' ELSE '' END
  || CASE WHEN i % 8 = 0 THEN '<article>' || repeat('word ', 160) || '<time datetime="2020">x</time></article>' ELSE '' END
  || CASE WHEN long_text THEN '<p>' || repeat('word ', 310) || '</p>' ELSE '' END || CASE WHEN i % 5 = 0 THEN '<nav class="breadcrumb"><a href="/x">x</a><a href="/y">y</a></nav>' ELSE '' END
  || CASE WHEN leads <> '' THEN '<a href="' || leads || '">t</a>' ELSE '' END || CASE WHEN i % 7 = 0 THEN '<div>$5.00 buy now</div>' ELSE '' END
  || CASE WHEN i % 3 = 0 THEN '<video src="/v.mp4"></video>' ELSE '' END || CASE WHEN i % 7 = 1 THEN '<div id="cf_chl_opt"></div>' ELSE '' END
  || CASE WHEN i % 7 = 2 THEN '<div class="g-recaptcha">' || repeat('filler ', 200) || '</div>' ELSE '' END
  || '<img src="/a.png" alt="" width=1 height=1>' || repeat('<img src="/b.png">', CAST(bare AS INT)) || repeat('<h2>Why so?</h2><div>so</div>', CAST(i % 5 AS INT))
  || CASE WHEN i % 10 = 1 THEN '<h2>How long?</h2><div>' || repeat('w ', 70) || '</div>' ELSE '' END || '</body></html>'"""


@query(_expected(_MARKUP, [
    ("img-missing-alt", "warning", "good AND bare > 0", "json_object('count', bare, 'sample', list_transform(range(bare), lambda n: '/b.png'))"), ("img-missing-dimensions", "info", "good AND bare > 0", "json_object('count', bare)"),
    ("structured-none", "info", "good AND j = 0", ""), ("structured-invalid-jsonld", "warning", "good AND j = 1", ""),
    ("structured-data", "info", "good AND j > 1", "json_object('types', [['Product'], ['FAQPage'], ['Article'], ['VideoObject']][CAST(j - 1 AS INT)])"),
    ("structured-missing-required", "warning", "good AND j = 2", "json_object('missing', ['name'], 'type', 'Product')"), ("structured-breadcrumb-candidate", "warning", "good AND i % 5 = 0", "json_object('links', 2)"),
    ("structured-product-candidate", "warning", "good AND j <> 2 AND i % 7 = 0", "json_object('signal', '$5.00')"), ("structured-article-candidate", "warning", "good AND j <> 4 AND i % 8 = 0", "json_object('words', 161)"),
    ("structured-video-candidate", "warning", "good AND j <> 5 AND i % 3 = 0", "json_object('src', '/v.mp4')"),
    ("aeo-answer-schema", "info", "good AND j = 3", "json_object('types', ['FAQPage', 'Question'])"), ("aeo-faq-candidate", "warning", "good AND j <> 3 AND asked >= 3", "json_object('questions', asked)"),
    ("aeo-no-list-format", "info", "good AND i % 11 = 0", "json_object('words', 305)"), ("aeo-answer-too-long", "info", "good AND i % 10 = 1", "json_object('answer_words', 70, 'question', 'How long?')"),
    ("aeo-no-answer-lead", "info", "good AND i % 2 = 0", "json_object('lead_words', CASE WHEN long_text THEN 310 ELSE 0 END, 'title', 'What now?')"),
    ("geo-missing-author", "info", "good AND j <> 4 AND i % 8 = 0", ""), ("geo-missing-date", "info", "good AND j = 4 AND i % 8 <> 0", ""), ("geo-no-main-landmark", "info", "good AND long_text AND NOT landmark", "json_object('words', 310)"),
    ("geo-js-dependent-content", "info", "good AND long_text AND i % 2 = 0", "json_object('raw_words', 1, 'rendered_words', 310)"), ("geo-low-quotable-density", "info", "good AND long_text", "json_object('data_points', 0, 'words', 310)"),
    ("utm-internal-tagged", "info", "u = 1", f"json_object('target', {_TARGET})"),
    ("utm-partial-tagging", "warning", "u = 1", f"json_object('anchor', 't', 'missing', ['utm_medium', 'utm_campaign'], 'present', ['utm_source'], 'target', {_TARGET})"),
    ("utm-empty-value", "warning", "u = 2", f"json_object('keys', ['utm_source'], 'target', {_TARGET})"), ("utm-duplicate-param", "warning", "u = 3", f"json_object('keys', ['utm_source'], 'target', {_TARGET})"),
    ("utm-inconsistent-casing", "info", "u = 4", f"json_object('keys', ['UTM_Source'], 'target', {_TARGET})"),
    ("utm-summary", "info", "u < 5 OR i % 5 = 0", "json_object('external_tagged', (u < 5 AND u <> 1)::INT, 'internal_tagged', (u = 1)::INT, 'tagged_links', (u < 5)::INT, 'total_links', (u < 5)::INT + CASE WHEN i % 5 = 0 THEN 2 ELSE 0 END)"),
    ("tracking-none", "info", "good AND i % 4 = 0", ""),
    ("tracking-tags", "info", "good AND i % 4 > 0", "CASE i % 4 WHEN 1 THEN '{\"tags\":[{\"ids\":[\"GTM-AB12\"],\"tag\":\"Google Tag Manager\"}]}' WHEN 2 THEN '{\"tags\":[{\"ids\":[\"UA-11-1\",\"UA-22-1\"],\"tag\":\"Universal Analytics\"}]}' ELSE '{\"tags\":[{\"ids\":[\"G-ABCD12\"],\"tag\":\"GA4\"},{\"ids\":[\"UA-11-1\"],\"tag\":\"Universal Analytics\"}]}' END"),
    ("tracking-duplicate-tag", "warning", "good AND i % 4 = 2", "json_object('count', 2, 'ids', ['UA-11-1', 'UA-22-1'], 'tag', 'Universal Analytics')"),
    ("tracking-mixed-ga-versions", "info", "good AND i % 4 = 3", "json_object('ga4_ids', ['G-ABCD12'], 'ua_ids', ['UA-11-1'])"),
    ("botwall-challenge", "warning", "NOT good", "CASE WHEN i % 7 = 1 THEN json_object('provider', 'Cloudflare', 'signals', ['cf_chl_opt'], 'status', 403) ELSE json_object('provider', 'Unknown', 'signals', ['title: just a moment'], 'status', 403) END"),
    ("botwall-captcha-widget", "info", "i % 7 = 2", "json_object('provider', 'Google reCAPTCHA', 'providers', ['Google reCAPTCHA'], 'signals', ['g-recaptcha'])"),
]))
def markup_audited(spark: SparkSession, d: str) -> DataFrame:
    """Every rule on images, structured data, answers, prose, campaign links, tags and challenges, with its data."""
    raw = "CASE WHEN long_text AND i % 2 = 0 THEN '<p>few</p>' END"
    pages = _crawl(spark, d, _MARKUP, html=_MARKUP_HTML, raw_html=raw, status_code="CASE WHEN good THEN 200 ELSE 403 END")
    return _issues(pages, "images", "structured", "aeo", "geo", "utm", "tracking", "botwall", answer_lead=True, quotable_density=True)


# --- rules that look across pages ------------------------------------------------------------

_SITE = """
own := 'https://s.example/p' || i
final := 'https://s.example/' || CASE WHEN i % 10 = 5 THEN 'q' ELSE 'p' END || i
good := i % 10 <> 9
"""
_MOVED = "CASE WHEN i % 10 = 5 THEN from_json('[{\"from\":\"' || own || '\",\"to\":\"' || final || '\",\"status\":301}]', 'array<struct<from:string,to:string,status:int>>') ELSE from_json('[]', 'array<struct<from:string,to:string,status:int>>') END"


def _site(spark: SparkSession, d: str, html: str) -> DataFrame:
    """Pages of one site: each tenth is lost, another tenth has moved."""
    return _crawl(spark, d, _SITE, requested_url="own", final_url="final", redirects=_MOVED, html=html, status_code="CASE WHEN good THEN 200 ELSE 404 END")


_SITE_SQL = f"""p AS (SELECT page_id AS i, url FROM pages), c AS (SELECT *, {', '.join(f'{e} AS {n.strip()}' for n, e in _parts(_SITE))} FROM p)"""


def _rows(*rules: tuple[str, str, str, str, str]) -> str:
    """SQL of issues ``(code, severity, url, data, the rows they come from)``."""
    return " UNION ALL ".join(f"SELECT {url} AS url, '{code}' AS code, '{severity}' AS severity, CAST({data} AS VARCHAR) AS data FROM {rows}" for code, severity, url, data, rows in rules)


@query(f"""WITH {_SITE_SQL}, l AS (SELECT i, final, good, i + 1 AS t, 'n' AS anchor FROM c UNION ALL SELECT i, final, good, i + 7, '' FROM c WHERE i % 4 = 0),
  h AS (SELECT l.i, l.final AS page, l.good, l.anchor, c.i AS t, c.own AS target, c.final AS goes FROM l JOIN c ON c.i = l.t),
  n AS (SELECT c.i, c.final, count(h.i) AS n, CASE WHEN max(h.anchor) = 'n' THEN ['n'] ELSE [] END AS names FROM c LEFT JOIN h ON h.t = c.i WHERE c.good GROUP BY 1, 2) """ + _rows(
    ("link-broken", "error", "page", "json_object('anchor', anchor, 'status', 404, 'target', target)", "h WHERE good AND t % 10 = 9"),
    ("link-to-redirect", "warning", "page", "json_object('final', goes, 'target', target)", "h WHERE good AND t % 10 = 5"),
    ("link-empty-anchor", "info", "final", "json_object('count', 1)", "c WHERE good AND i % 4 = 0"),
    ("link-summary", "info", "final", "json_object('external', (i % 3 = 0)::INT, 'nofollow', (i % 3 = 0)::INT, 'total', 1 + (i % 4 = 0)::INT + (i % 3 = 0)::INT)", "c WHERE good"),
    ("link-inbound", "info", "final", "json_object('anchors', names, 'count', n)", "n"),
))
def links_audited(spark: SparkSession, d: str) -> DataFrame:
    """Every rule on links between pages, with its data."""
    html = """'<a href="/p' || (i + 1) || '">n</a>' || CASE WHEN i % 4 = 0 THEN '<a href="p' || (i + 7) || '"></a>' ELSE '' END
      || CASE WHEN i % 3 = 0 THEN '<a href="http://out.example/" rel="nofollow">out</a>' ELSE '' END"""
    return _issues(_site(spark, d, html), "links")


_GROUP = "(SELECT *, list_filter(list_sort(list(final) OVER (PARTITION BY {0}))[1:11], lambda x: x <> final)[1:10] AS others, count(*) OVER (PARTITION BY {0}) AS n FROM c WHERE good) WHERE n > 1"


@query(f"""WITH {_SITE_SQL}, w AS (SELECT *, 20 + 10 * (i % 50) AS words FROM c WHERE good), m AS (SELECT *, avg(words) OVER () AS mean FROM w),
  e AS (SELECT c.i, c.final, t.i AS t, t.own AS target FROM c JOIN c t ON t.i = c.i + 3 WHERE c.good AND c.i % 3 = 0),
  g AS (SELECT c.final, t.i AS t, './p' || t.i AS href FROM c JOIN c t ON t.i = c.i + 1 WHERE c.good AND c.i % 4 = 0),
  a AS (SELECT c.final, t.i AS t, '/p' || t.i AS href FROM c JOIN c t ON t.i = c.i - 1 WHERE c.good AND c.i % 7 = 1) """ + _rows(
    ("hreflang-invalid-code", "warning", "final", "json_object('code', 'english')", "c WHERE good AND i % 9 = 0 AND i % 15 <> 0"), ("hreflang-missing-x-default", "info", "final", "NULL", "c WHERE good AND i % 3 = 0 AND i % 6 <> 0"),
    ("hreflang-missing-self", "info", "final", "NULL", "c WHERE good AND i % 15 = 0 AND i % 6 <> 0"),
    ("hreflang-no-return-link", "warning", "e.final", "json_object('target', target)", "e JOIN c b ON b.i = e.t WHERE NOT (b.good AND b.i % 2 = 1)"),
    ("hreflang-no-return-link", "warning", "c.final", "json_object('target', t.own)", "c JOIN c t ON t.i = c.i - 3 WHERE c.good AND c.i % 3 = 0 AND c.i % 2 = 1 AND NOT t.good"),
    ("pagination-detected", "info", "final", "json_object('next', './p' || (i + 1))", "c WHERE good AND i % 4 = 0"), ("pagination-detected", "info", "final", "json_object('prev', '/p' || (i - 1))", "c WHERE good AND i % 4 = 1"),
    ("pagination-broken", "warning", "final", "json_object('rel', 'next', 'status', CASE t % 10 WHEN 9 THEN 404 ELSE 200 END, 'target', href)", "g WHERE t % 10 IN (5, 9)"),
    ("amp-detected", "info", "final", "NULL", "c WHERE good AND i % 7 = 0"), ("amp-missing-canonical", "warning", "final", "NULL", "c WHERE good AND i % 14 = 0"), ("amp-missing-runtime", "error", "final", "NULL", "c WHERE good AND i % 21 = 0"),
    ("amp-broken-amphtml", "warning", "final", "json_object('target', href)", "a WHERE t % 10 IN (5, 9)"), ("amp-amphtml-linked", "info", "final", "json_object('target', href)", "a WHERE t % 10 NOT IN (5, 9)"),
    ("duplicate-title", "warning", "final", "json_object('duplicates', others, 'group_size', n, 'title', 'Title ' || (i % 40))", _GROUP.format("i % 40")),
    ("duplicate-meta-description", "info", "final", "json_object('duplicates', others, 'group_size', n)", _GROUP.format("i % 60")), ("duplicate-content", "warning", "final", "json_object('duplicates', others, 'group_size', n)", _GROUP.format("i % 50")),
    ("content-thin", "warning", "final", "json_object('words', words)", "m WHERE words < 100"), ("content-low", "info", "final", "json_object('site_average', CAST(floor(mean + 0.5) AS BIGINT), 'words', words)", "m WHERE words >= 100 AND words < 0.5 * mean"),
))
def site_audited(spark: SparkSession, d: str) -> DataFrame:
    """Every rule on alternates, pagination, AMP, duplicates and length, with its data."""
    alternate = lambda code, to: f"'<link rel=\"alternate\" hreflang=\"{code}\" href=\"https://s.example/p' || ({to}) || '\">'"
    html = f"""'<html' || CASE WHEN i % 7 = 0 THEN ' amp' ELSE '' END || '><head><title>Title ' || (i % 40) || '</title><meta name="description" content="Desc ' || (i % 60) || '">'
      || CASE WHEN i % 3 = 0 THEN CASE WHEN i % 15 = 0 THEN '' WHEN i % 9 = 0 THEN {alternate('english', 'i')} ELSE {alternate('en', 'i')} END || {alternate('de', 'i + 3')}
        || CASE WHEN i % 6 = 0 THEN {alternate('x-default', 'i')} ELSE '' END || CASE WHEN i % 2 = 1 THEN {alternate('fr', 'i - 3')} ELSE '' END ELSE '' END
      || CASE i % 4 WHEN 0 THEN '<link rel="next" href="./p' || (i + 1) || '">' WHEN 1 THEN '<link rel="prev" href="/p' || (i - 1) || '">' ELSE '' END
      || CASE WHEN i % 14 = 0 THEN '' ELSE '<link rel="canonical" href="' || final || '">' END
      || CASE WHEN i % 21 = 0 THEN '' ELSE '<script src="https://cdn.ampproject.org/v0.js"></script>' END
      || CASE WHEN i % 7 = 1 THEN '<link rel="amphtml" href="/p' || (i - 1) || '">' ELSE '' END || '</head><body><p>' || repeat('word ', CAST(20 + 10 * (i % 50) AS INT)) || '</p></body></html>'"""
    return _issues(_site(spark, d, html), "hreflang", "pagination", "amp", "duplicates", "content")


_LANDING = """
own := CASE WHEN i % 4 = 0 THEN 'http' ELSE 'https' END || '://s.example/l' || i
final := own || CASE WHEN i % 2 = 0 THEN '?utm_campaign=alpha+bravo+charlie+delta+echo' ELSE '' END
m := i % 6
"""


@query(f"""WITH p AS (SELECT page_id AS i, url FROM pages), c AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _parts(_LANDING))} FROM p WHERE i % 2 = 0),
  t AS (SELECT *, CASE WHEN i > 0 THEN ['golf'] ELSE [] END AS asked, ['alpha', 'bravo', 'charlie', 'delta', 'echo'] AS words FROM c),
  k AS (SELECT *, CAST(m AS DOUBLE) / len(asked || words) AS share, json_object('campaign_terms', asked || words, 'coverage', floor(CAST(m AS DOUBLE) / len(asked || words) * 100 + 0.5) / 100,
    'matched', words[1:m], 'missing', asked || words[m + 1:]) AS data FROM t) """ + _rows(
    ("landing-not-https", "warning", "final", "NULL", "c WHERE i % 4 = 0"), ("landing-noindex", "error", "final", "json_object('robots', 'noindex')", "c WHERE i % 7 = 0"),
    ("landing-missing-title", "warning", "final", "NULL", "c WHERE m = 0"), ("landing-missing-h1", "warning", "final", "NULL", "c WHERE i % 3 = 0"), ("landing-missing-description", "info", "final", "NULL", "c WHERE i % 5 = 0"),
    ("landing-keyword-mismatch", "warning", "final", "data", "k WHERE share < 0.2"), ("landing-keyword-weak", "info", "final", "data", "k WHERE share >= 0.2 AND share < 0.5"), ("landing-keyword-aligned", "info", "final", "data", "k WHERE share >= 0.5"),
))
def landing_audited(spark: SparkSession, d: str) -> DataFrame:
    """Every rule on campaign pages, their own terms behind those of the link before, with its data."""
    html = """'<html><head><title>' || array_join(slice(array('alpha', 'bravo', 'charlie', 'delta', 'echo'), 1, CAST(m AS INT)), ' ') || '</title>' || CASE WHEN i % 5 = 0 THEN '' ELSE '<meta name="description" content="x">' END
      || CASE WHEN i % 7 = 0 THEN '<meta name="robots" content="noindex">' ELSE '' END || '</head><body>' || CASE WHEN i % 3 = 0 THEN '' ELSE '<h1>zulu</h1>' END
      || CASE WHEN i % 2 = 1 THEN '<a href="https://s.example/l' || (i + 1) || '?utm_term=golf">x</a>' ELSE '' END"""
    return _issues(_crawl(spark, d, _LANDING, requested_url="final", final_url="final", html=html), "landing")


_LAYER = """
r := i % 5 <> 0
g := i % 6
e := i % 7
sent := i % 2 = 0
"""
_SALE = '{"event":"purchase","ecommerce":{"transaction_id":"T1","value":5,"currency":"EUR","items":[{"a":1}]}}'
#: What each kind of page pushed.
_PUSHED = [
    [], ['{"event":"page_view"}', '{"event":"click"}', '{"event":"click"}'], ['{"event":"click"}'], ['{"event":"purchase","transaction_id":"T1","value":"5","currency":"eur","items":[]}'], [_SALE, _SALE],
    ['{"event":"view_item","email":"ann@b.example"}'], ['{"event":"gtm.js"}'],
]
_COUNTED = ["", '{"count":1,"event":"page_view"},{"count":2,"event":"click"}', '{"count":1,"event":"click"}', '{"count":1,"event":"purchase"}', '{"count":2,"event":"purchase"}', '{"count":1,"event":"view_item"}', '{"count":1,"event":"gtm.js"}']
_GTM = '<script src="https://www.googletagmanager.com/gtm.js?id=GTM-AA11"></script>'
_HEAD_TAGS = {1: f"<script>window.dataLayer=window.dataLayer||[];</script>{_GTM}", 3: '<script src="https://www.googletagmanager.com/gtag/js?id=G-ABCD12"></script><script>window.dataLayer=window.dataLayer||[];gtag("consent","default");gtag("config","G-ABCD12");gtag("config","AW-99")</script>',
              4: "<script>dataLayer.push({})</script><script>dataLayer=[]</script>", 5: '<script>fbq("init","123456")</script>'}
_BODY_TAGS = {1: '<noscript><iframe src="https://www.googletagmanager.com/ns.html?id=GTM-AA11"></iframe></noscript>', 2: _GTM}


def _case(of: str, texts: dict[int, str], otherwise: str = "''") -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in texts.items()) + f" ELSE {otherwise} END"


@query(_expected(_LAYER, [
    ("datalayer-gtm-noscript-missing", "warning", "g = 2", "json_object('containers', ['GTM-AA11'])"), ("datalayer-gtm-snippet-not-in-head", "info", "g = 2", "json_object('containers', ['GTM-AA11'])"),
    ("datalayer-push-before-init", "warning", "g = 4", ""), ("datalayer-init-missing", "warning", "g = 2", ""), ("datalayer-consent-mode-present", "info", "g = 3", ""), ("datalayer-consent-mode-missing", "info", "g IN (1, 2)", ""),
    ("datalayer-gtag-config-id-mismatch", "warning", "g = 3", "json_object('config_id', 'AW-99', 'loaded_ids', ['G-ABCD12'])"), ("datalayer-empty", "warning", "r AND e = 0 AND g IN (1, 2, 3)", ""),
    ("datalayer-events", "info", "r AND e > 0", f"'{{\"events\":[' || {_case('e', dict(enumerate(_COUNTED)))} || ']}}'"), ("datalayer-page-view-missing", "warning", "r AND e IN (2, 3, 4, 5) AND g <> 3", ""),
    ("datalayer-ecommerce-event-invalid", "warning", "r AND e = 5", "json_object('event', 'view_item', 'missing', ['currency', 'value', 'items'])"),
    ("datalayer-param-type", "warning", "r AND e = 3", "json_object('event', 'purchase', 'param', 'value', 'want', 'number')"), ("datalayer-param-type", "warning", "r AND e = 3", "json_object('event', 'purchase', 'got', 'eur', 'param', 'currency', 'want', 'ISO-4217 code')"),
    ("datalayer-param-type", "warning", "r AND e = 3", "json_object('event', 'purchase', 'param', 'items')"), ("datalayer-duplicate-event", "warning", "r AND e = 4", "json_object('count', 2, 'event', 'purchase')"),
    ("datalayer-duplicate-transaction", "warning", "r AND e = 4", "json_object('count', 2, 'transaction_id', 'T1')"), ("datalayer-pii", "warning", "r AND e = 5", "json_object('key', 'email', 'kind', 'email', 'value', 'an*********le')"),
    ("datalayer-tag-not-firing", "warning", "r AND g IN (1, 2) AND NOT sent", "json_object('tag', 'Google Tag Manager')"), ("datalayer-tag-not-firing", "warning", "r AND g = 3 AND NOT sent", "json_object('tag', 'GA4')"),
    ("datalayer-tag-not-firing", "warning", "r AND g = 3", "json_object('tag', 'Google Ads')"), ("datalayer-tag-not-firing", "warning", "r AND g = 5", "json_object('tag', 'Meta Pixel')"),
    ("datalayer-tags-firing", "info", "r AND g IN (1, 2, 3) AND sent", "json_object('tags', [CASE g WHEN 3 THEN 'GA4' ELSE 'Google Tag Manager' END])"),
]))
def datalayer_audited(spark: SparkSession, d: str) -> DataFrame:
    """Every rule on tag managers and data layers, with its data."""
    pushed = "CASE e " + " ".join(f"WHEN {k} THEN array({', '.join(repr(x) for x in xs)})" for k, xs in enumerate(_PUSHED) if xs) + " ELSE cast(array() AS array<string>) END"
    sent = "CASE WHEN sent THEN array('https://x.example/g/collect?a', 'https://www.googletagmanager.com/gtm.js?id=1') ELSE cast(array() AS array<string>) END"
    render = f"""named_struct('implemented', r, 'note', '', 'raw_fallback', false, 'rendered_bytes', 0, 'raw_bytes', 0, 'lcp_ms', 0D, 'fcp_ms', 0D, 'cls', 0D, 'tbt_ms', 0D, 'ttfb_ms', 0D,
      'data_layer_present', true, 'data_layer', {pushed}, 'requests', {sent})"""
    html = f"'<html><head>' || {_case('g', _HEAD_TAGS)} || '</head><body>' || {_case('g', _BODY_TAGS)} || '</body></html>'"
    return _issues(_crawl(spark, d, _LAYER, render=render, html=html), "datalayer")


# --- files beside the pages ------------------------------------------------------------------

_FILES = """
host := 'h' || (i % 20) || '.example'
k := i % 4
own := 'https://h' || (i % 20) || '.example/p' || i
"""


@query(f"""WITH p AS (SELECT page_id AS i, url FROM pages), c AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _parts(_FILES))} FROM p), h AS (SELECT DISTINCT host, k FROM c),
  m AS (SELECT own AS loc FROM c WHERE k = 0 UNION SELECT own || 'x' FROM c WHERE k = 0), o AS (SELECT count(*) AS listed, count(*) FILTER (WHERE loc NOT LIKE '%x') AS hit FROM m), n AS (SELECT count(*) AS pages FROM c) """ + _rows(
    ("robots-missing", "info", "'host ' || host", "json_object('status', 404)", "h WHERE k = 0"), ("robots-no-sitemap-declared", "info", "'host ' || host", "NULL", "h WHERE k IN (1, 3)"),
    ("robots-sitemaps-declared", "info", "'host ' || host", "json_object('sitemaps', ['https://x.example/s.xml'])", "h WHERE k = 2"), ("robots-crawled-disallowed", "warning", "own", "NULL", "c WHERE k = 1 AND CAST(i AS VARCHAR) LIKE '1%'"),
    ("geo-ai-crawler-blocked", "info", "'host ' || host", "json_object('blocked', ['GPTBot'])", "h WHERE k = 3"),
    ("sitemap-invalid", "warning", "own || '.xml'", "NULL", "c WHERE k = 1"), ("sitemap-truncated", "warning", "own || '.xml'", "NULL", "c WHERE k = 2"),
    ("sitemap-coverage", "info", "'https://example.org/'", "json_object('crawled_not_in_sitemap', pages - hit, 'crawled_pages', pages, 'in_sitemap_not_crawled', listed - hit, 'sitemap_urls', listed)", "o, n WHERE listed > 0"),
))
def files_audited(spark: SparkSession, d: str) -> DataFrame:
    """Rules on robots files and sitemaps of twenty hosts, with their data: each fourth host has no file, closes a part, declares a sitemap, or shuts a crawler out."""
    parts = _t(spark, d, "pages").selectExpr("page_id AS i", "url").selectExpr("*", *(f"{e} AS {n}" for n, e in _parts(_FILES)))
    body = "CASE k WHEN 1 THEN 'User-agent: *\\nDisallow: /p1' WHEN 2 THEN 'Sitemap: https://x.example/s.xml' WHEN 3 THEN 'User-agent: GPTBot\\nDisallow: /' ELSE '' END"
    files = parts.select("host", "k").distinct().selectExpr("'https' AS scheme", "host", "CASE k WHEN 0 THEN 404 ELSE 200 END AS status", f"{body} AS body")
    xml = "CASE k WHEN 0 THEN '<urlset><url><loc>' || own || '</loc></url><url><loc>' || own || 'x</loc></url></urlset>' WHEN 1 THEN 'nonsense' ELSE '<urlset>' END"
    maps = parts.selectExpr("own || '.xml' AS url", "CASE k WHEN 3 THEN 404 ELSE 200 END AS status", "k = 2 AS truncated", "true AS declared", f"encode({xml}, 'utf-8') AS body")
    pages = _crawl(spark, d, _FILES, requested_url="own", final_url="own", html="'<p>x</p>'")
    return _issues(pages, "robots", "sitemap", "geo", robots=files, sitemaps=maps)


_PRESS = """
k := i % 9
own := 'https://w.example' || CASE i % 9 WHEN 0 THEN '/?p=' || (i + 1) WHEN 1 THEN '/de' || i || '?lang=DE' WHEN 2 THEN '/?attachment_id=' || (i + 1) WHEN 3 THEN '/?s=w' || i WHEN 4 THEN '/author/a' || i WHEN 5 THEN '/' || (2000 + i % 25) || '/05/' WHEN 6 THEN '/author/b' || i ELSE '/x' || i END
"""
_SITE_WIDE = "'https://example.org/'"


@query(f"""WITH p AS (SELECT page_id AS i, url FROM pages), c AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _parts(_PRESS))} FROM p), s AS (SELECT list_sort(list(DISTINCT 'plug' || (i % 12))) AS plugins FROM c HAVING count(*) > 0) """ + _rows(
    ("wp-ugly-permalink", "info", "own", "json_object('param', 'p')", "c WHERE k = 0"), ("wp-i18n-lang-query-param", "info", "own", "json_object('lang', 'de')", "c WHERE k = 1"),
    ("wp-html-lang-mismatch", "warning", "own", "json_object('html_lang', 'en', 'url_lang', 'de')", "c WHERE k = 1"), ("wp-indexable-attachment", "warning", "own", "json_object('id', CAST(i + 1 AS VARCHAR))", "c WHERE k = 2"),
    ("wp-indexable-search", "warning", "own", "NULL", "c WHERE k = 3"), ("wp-indexable-author-archive", "info", "own", "NULL", "c WHERE k = 4"), ("wp-indexable-date-archive", "info", "own", "NULL", "c WHERE k = 5"),
    ("wp-acf-leaked-markup", "warning", "own", "json_object('snippet', 'hello [acf field] bye')", "c WHERE k = 7"),
    ("wp-detected", "info", _SITE_WIDE, "json_object('i18n_plugin', 'Polylang', 'plugin_count', len(plugins), 'plugins', plugins, 'seo_plugin', 'Rank Math, Yoast SEO', 'version', '6.4')", "s"),
    ("wp-version-exposed", "warning", _SITE_WIDE, "json_object('version', '6.4')", "s"), ("wp-emoji-enabled", "info", _SITE_WIDE, "NULL", "s"), ("wp-jquery-migrate", "info", _SITE_WIDE, "NULL", "s"),
    ("wp-many-plugin-assets", "warning", _SITE_WIDE, "json_object('plugin_count', len(plugins), 'plugins', plugins)", "s WHERE len(plugins) >= 10"), ("wp-default-tagline", "warning", _SITE_WIDE, "NULL", "s"),
    ("wp-multiple-seo-plugins", "warning", _SITE_WIDE, "json_object('plugins', ['Rank Math', 'Yoast SEO'])", "s"), ("wp-multilingual-detected", "info", _SITE_WIDE, "json_object('plugins', ['Polylang'])", "s"),
    ("wp-i18n-no-hreflang", "warning", _SITE_WIDE, "json_object('plugins', ['Polylang'])", "s"),
))
def wordpress_audited(spark: SparkSession, d: str) -> DataFrame:
    """Rules on WordPress, of pages and of the site they make together, with their data."""
    html = """'<html lang="en"><head>' || CASE WHEN i % 10 = 0 THEN '<meta name="generator" content="WordPress 6.4">' ELSE '' END || CASE WHEN k = 6 THEN '<meta name="robots" content="noindex">' ELSE '' END
      || '<script src="/wp-content/plugins/plug' || (i % 12) || '/a.js"></script>' || CASE WHEN i % 2 = 0 THEN '<!-- yoast -->' ELSE '<!-- rank-math -->' END || CASE WHEN i % 3 = 0 THEN '<!-- polylang -->' ELSE '' END
      || CASE WHEN i % 4 = 0 THEN '<script>_wpemojiSettings</script><script src="/jquery-migrate.js"></script><!-- Just another WordPress site -->' ELSE '' END
      || '</head><body>' || CASE WHEN k = 7 THEN 'hello [acf field] bye' ELSE 'hello' END || '</body></html>'"""
    return _issues(_crawl(spark, d, _PRESS, requested_url="own", final_url="own", html=html), "wordpress")
