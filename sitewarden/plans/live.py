"""A live crawl: waves of fetches, with robots files, sitemaps and the files that analyzers ask for."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import urls as U
from ..operators import redirects
from ..operators import robots as R
from ..operators import sitemaps as M
from ..sources import schema
from ..sources.fetch import PAGE_PARTS, TOO_MANY, Fetch, fetch_all, fetch_bodies, hops
from ..streaming import throttle
from . import audit, crawl
from .config import AGENT, Config

#: Where sitemaps are looked for that nobody declares.
GUESSED = ["/sitemap.xml", "/sitemap_index.xml"]
#: The endpoints of the opt-in probes.
PROBES = {"xmlrpc": "/xmlrpc.php", "users": "/wp-json/wp/v2/users", "author": "/?author=1", "uploads": "/wp-content/uploads/", "readme": "/readme.html"}


@dataclass
class Crawled:
    pages: DataFrame  # ``schema.PAGES`` with features
    left: DataFrame
    coverage: dict
    options: audit.Options


def fetch_options(config: Config) -> Fetch:
    return Fetch(
        agent=(config.user_agents or [AGENT])[0], adaptive=config.adaptive_delay, timeout=config.timeout, max_bytes=config.max_body_bytes, max_redirects=config.max_redirects,
        user=config.basic_auth, auth_host=urlsplit(config.seed).hostname or "", rate=config.rate,
    )


def limits(config: Config) -> crawl.Limits:
    names = ("max_pages", "max_depth", "follow_external", "follow_nofollow", "allow_subdomains", "strip_query", "include", "exclude", "max_seconds")
    return crawl.Limits(agent=(config.user_agents or [AGENT])[0], **{n: getattr(config, n) for n in names})


class Hops:
    """Answers to a frontier, redirects followed hop by hop.

    A redirect is a row of the next hop only if its target is in scope and open
    to robots; otherwise the page has an error, no status, and the hop that was
    refused. The limiter's state is a table that every hop reads and folds its
    answers into, so all tasks and waves of a crawl share it.
    """

    def __init__(self, spark: SparkSession, config: Config, options: Fetch, robots_of: crawl.Rows | None):
        self.config, self.options, self.robots_of = config, options, robots_of
        self.store, self.waves = crawl.Store(spark), 0
        self.home = crawl.home(spark, config.seed)
        self.limiter = spark.createDataFrame([], throttle.STATE)

    def _ask(self, flight: DataFrame, name: str) -> DataFrame:
        """One hop of ``flight(rank, at, secure)``, at the limiter's times."""
        config, options = self.config, self.options
        asked = flight.withColumns({"host": U.host(F.col("at")), "url": F.col("at")})
        asked = crawl.rotated(crawl.rotated(asked, config.user_agents, config.rotation), config.proxies, config.proxy_rotation, "proxy")
        planned = throttle.schedule(asked, self.limiter, time.time(), options.rate)
        got = self.store.keep(hops(planned, options, config.concurrency), f"got-{name}")
        status = F.col("status_code") if options.adaptive else F.lit(0)
        seen = got.select(U.host(F.col("at")).alias("host"), F.col("seen_at").alias("at"), F.col("rank").alias("seq"), "sent_at", status.alias("status_code"), F.least("retry_after", F.lit(options.longest_wait)).alias("retry_after"))
        self.limiter = self.store.keep(throttle.carried(self.limiter, seen, options.rate), f"limiter-{name}")
        return got

    def __call__(self, frontier: DataFrame) -> DataFrame:
        """``frontier(rank, key, url, referrer)`` with the columns of a page."""
        store, self.waves = self.store, self.waves + 1
        flight = frontier.select("rank", F.col("url").alias("at"), (U.scheme(F.col("url")) == "https").alias("secure"))
        for hop in range(self.config.max_redirects + 1):
            name = f"{self.waves}-{hop}"
            got = self._ask(flight, name)
            answers = store.append(got.where("to IS NULL"), f"answers-{self.waves}")
            led = got.where("to IS NOT NULL")
            trail = store.append(led.select("rank", F.lit(hop).alias("hop"), F.col("at").alias("from"), "to", F.col("status_code").alias("status"), "duration_ms"), f"trail-{self.waves}")
            judged = store.keep(crawl.judge(led, "to", self.home, limits(self.config), self.robots_of), f"led-{name}")
            shut = judged.where("NOT ok").drop("ok")
            refused = {"err": F.concat(F.lit("redirect to "), "to", F.lit(" refused by scope, exclusions or robots")), "status_code": F.lit(0), "headers": F.lit(None).cast(got.schema["headers"].dataType), "duration_ms": F.lit(0).cast("long")}
            answers = store.append(shut.withColumns(refused).withColumn("to", F.lit(None).cast("string")), f"answers-{self.waves}")
            flight = judged.where("ok").select("rank", F.col("to").alias("at"), "secure")
            if flight.isEmpty():
                break
        else:
            ended = judged.where("ok").drop("ok").withColumns(refused).withColumns({"err": F.lit(TOO_MANY), "at": F.col("to"), "to": F.lit(None).cast("string")})
            answers = store.append(ended, f"answers-{self.waves}")
        way = trail.groupBy(F.col("rank").alias("n")).agg(F.array_sort(F.collect_list(F.struct("hop", "from", "to", "status"))).alias("way"), F.sum("duration_ms").alias("before"))  # at most ``max_redirects`` each
        rows = answers.join(way, F.col("rank") == F.col("n"), "left").join(frontier.withColumnRenamed("rank", "m"), F.col("rank") == F.col("m"))
        made = {
            "requested_url": F.col("url"), "final_url": F.col("at"), "duration_ms": F.col("duration_ms") + F.coalesce("before", F.lit(0)),
            "redirects": F.coalesce(F.transform("way", lambda w: F.struct(w["from"].alias("from"), w["to"].alias("to"), w["status"].alias("status"))), F.array()),
        }
        kept = [f for f in StructType.fromDDL(schema.PAGES) if f.name not in ("page_seq", "depth", "referrer")]
        column = lambda f: made.get(f.name, F.col(f.name) if f.name in PAGE_PARTS else F.lit(None)).cast(f.dataType).alias(f.name)
        return rows.select("rank", "key", "url", "referrer", *map(column, kept))


def robots_of(options: Fetch) -> Callable[[DataFrame], DataFrame]:
    """robots.txt of ``(scheme, host)``, fetched once each."""

    def get(hosts: DataFrame) -> DataFrame:
        at = hosts.select(F.lit(0).alias("page_seq"), F.concat("scheme", F.lit("://"), "host", F.lit("/robots.txt")).alias("url"))
        asked = F.regexp_extract("requested_url", "^([a-z]+)://([^/]*)", 1), F.regexp_extract("requested_url", "^([a-z]+)://([^/]*)", 2)
        return fetch_all(at, options).select(asked[0].alias("scheme"), asked[1].alias("host"), F.col("status_code").alias("status"), F.col("html").alias("body"))

    return get


def sitemaps_of(spark: SparkSession, seed: str, robots: DataFrame, options: Fetch, depth: int = 2) -> DataFrame:
    """Bodies of the declared and guessed sitemaps and of what their indexes name: ``url, status, truncated, declared, body``."""
    parts = urlsplit(seed)
    guessed = spark.createDataFrame([(f"{parts.scheme}://{parts.netloc}{p}", False) for p in GUESSED], "url string, declared boolean")
    asked = R.with_rules(robots).select(F.explode("sitemaps").alias("url"), F.lit(True).alias("declared")).unionAll(guessed).groupBy("url").agg(F.max("declared").alias("declared"))
    return sitemap_bodies(spark, asked, options, depth)


def sitemap_bodies(spark: SparkSession, asked: DataFrame, options: Fetch, depth: int = 2) -> DataFrame:
    """Bodies of ``asked(url, declared)`` and of what their indexes name."""
    store = crawl.Store(spark)
    found = store.append(fetch_bodies(asked.select("url"), options).join(asked, "url").select("url", "status", "truncated", "declared", "body"), "bodies")
    for _ in range(depth):
        children = M.read(found).where("kind = 'index'").select(F.explode("locs").alias("url")).distinct()
        new = store.keep(children.join(found.select("url"), "url", "left_anti"), "children")
        if new.isEmpty():
            break
        got = fetch_bodies(new, options).select("url", "status", "truncated", F.lit(None).cast("boolean").alias("declared"), "body")
        found = store.append(store.keep(got, "got"), "bodies")
    return found


def listed_urls(spark: SparkSession, domain: str, options: Fetch, override: str | None = None) -> DataFrame:
    """``loc``: what a domain's sitemap lists. One that can't be read is an error, as every rule would be judged wrongly."""
    base = (domain if "://" in domain else f"https://{domain}").rstrip("/")
    places = [(override, True)] if override else [(f"{base}{p}", False) for p in GUESSED]
    bodies = sitemap_bodies(spark, spark.createDataFrame(places, "url string, declared boolean"), options)
    read = crawl.Store(spark).keep(M.read(bodies), "sitemaps")
    if read.where("kind IN ('index', 'urlset')").isEmpty():
        cut = not bodies.where("truncated").isEmpty()
        raise LookupError(f"no sitemap at {' or '.join(p for p, _ in places)}" + (": it is longer than max_body_bytes" if cut else ""))
    return read.where("kind = 'urlset'").select(F.explode("locs").alias("loc")).distinct()


def rule_answers(spark: SparkSession, rules: DataFrame, domain: str, config: Config) -> DataFrame:
    """``url, status_code, final_url, hops, err`` of the sources and targets of rules in scope, at the limiter's pace; redirects may lead anywhere."""
    c = F.col
    inside = rules.where(redirects.scope(c("Original URL"), c("Redirect to"), domain) == "in-scope")
    at = inside.select(F.explode(F.array(redirects.absolute(c("Original URL"), domain), redirects.absolute(c("Redirect to"), domain))).alias("url")).distinct()
    store = crawl.Store(spark)
    ask = Hops(spark, replace(config, follow_external=True, include=[], exclude=[]), fetch_options(config), None)
    frontier = store.numbered(at.withColumns({"key": c("url"), "referrer": F.lit("")}), ["url"], "rank", "rules")
    return store.keep(ask(frontier).select("url", "status_code", "final_url", F.size("redirects").alias("hops"), "err"), "rule-answers")


def crawl_site(spark: SparkSession, config: Config, stop: Callable[[], bool] | None = None, probes: bool = False) -> Crawled:
    """Fetches a site from its seed on, and what the selected analyzers need beside its pages."""
    options, store = fetch_options(config), crawl.Store(spark)
    seed = config.seed
    parts = urlsplit(seed)
    base = f"{parts.scheme}://{parts.netloc}"

    def links_of(wave: DataFrame) -> DataFrame:
        return wave.where("f IS NOT NULL").select("page_seq", F.posexplode("f.anchors").alias("pos", "a")).select("page_seq", "pos", F.col("a.resolved").alias("to"), F.col("a.nofollow").alias("nofollow"))

    known: DataFrame | None = None

    def robots_rows(hosts: DataFrame) -> DataFrame:
        """The files of these hosts; each is fetched once."""
        nonlocal known
        new = hosts if known is None else hosts.join(known.select("scheme", "host"), ["scheme", "host"], "left_anti")
        known = store.append(store.keep(robots_of(options)(new), "robots-new"), "robots")
        return known.join(hosts, ["scheme", "host"], "left_semi")

    ask = Hops(spark, config, options, robots_rows if config.robots else None)

    def look_up(frontier: DataFrame) -> DataFrame:
        return audit.prepare(ask(frontier).withColumn("page_seq", F.col("rank"))).drop("page_seq")

    robots_rows(spark.createDataFrame([(parts.scheme, parts.netloc.lower())], "scheme string, host string"))
    pages, left, coverage = crawl.walk(spark, seed, look_up, links_of, limits(config), robots_rows if config.robots else None, stop)
    names, _ = audit.select(audit.Options(enabled=config.analyzers, disabled=config.skip, strip_query=config.strip_query))
    one = lambda url: fetch_all(spark.createDataFrame([(0, url)], "page_seq int, url string"), options)
    llms = one(f"{base}/llms.txt").select(F.col("requested_url").alias("url"), "final_url", F.col("status_code").alias("status"), "content_type", F.col("html").alias("body"))
    asked = None
    if probes and "wordpress" in names:
        at = spark.createDataFrame([(i, f"{base}{p}", n) for i, (n, p) in enumerate(PROBES.items())], "i int, url string, probe string")
        asked = fetch_all(at.select(F.col("i").alias("page_seq"), "url"), options).join(at, F.col("page_seq") == F.col("i"))
        asked = store.keep(asked.select("probe", "url", "status_code", "final_url", F.col("html").alias("body")), "probes")
    wanted = audit.Options(
        enabled=config.analyzers, disabled=config.skip, strip_query=config.strip_query, seed=seed, agent=options.agent, robots=known,
        sitemaps=sitemaps_of(spark, seed, known, options) if "sitemap" in names else None, llms=store.keep(llms, "llms") if "geo" in names else None, probes=asked,
    )
    return Crawled(pages.drop("key", "url"), left, coverage, wanted)
