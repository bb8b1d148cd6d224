"""The crawl as waves of DataFrame jobs over a table of responses.

A wave looks its frontier up in tables (``crawl``) or fetches it (``live``),
takes the links of what answered, and keeps those that are new, in scope,
allowed and within limits as the next frontier. Each wave is written, and what
is known of all waves is one table that grows, so plans stay the same; the loop
ends with an empty frontier.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render as R_
from ..functions import urls as U
from ..operators import robots as R


@dataclass
class Limits:
    max_pages: int = 500  # 0: no limit
    max_depth: int = 0  # 0: no limit
    follow_external: bool = False
    follow_nofollow: bool = False
    allow_subdomains: bool = False
    strip_query: bool = False
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    agent: str = "sitewarden"
    max_seconds: float = 0.0


#: Public suffixes of two labels in common use.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "co.za", "com.mx", "co.in", "com.tr"]


def registrable(host):
    """The last two labels, or three where the last two are a public suffix."""
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    three = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    return F.when(two.isin(SUFFIXES) & (three != ""), three).when(two != "", two).otherwise(host)


class Store:
    """Tables written to the shared folder and read back: lineage ends, and branches share one result."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = base or tempfile.mkdtemp(prefix="crawl-")
        self.spark, self.root = spark, f"{base.rstrip('/')}/crawl-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def append(self, df: DataFrame, name: str) -> DataFrame:
        """One table of all that was appended, so plans don't grow with the waves."""
        return self.keep(df, name, "append")

    def numbered(self, df: DataFrame, order: list[str], column: str, name: str, base: int = 0) -> DataFrame:
        """Rows numbered from ``base + 1`` in an order: sorted ranges, and a count of rows per range (as many as partitions)."""
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        held = self.keep(ranged.withColumns({"_range": F.spark_partition_id(), "_place": place}), name)
        sizes = held.groupBy(F.col("_range").alias("r")).agg(F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s"))
        joined = held.join(F.broadcast(starts), F.col("_range") == F.col("r"))
        return joined.withColumn(column, F.col("_place") + F.col("s") + base + 1).drop("r", "s", "_range", "_place")


class Keys:
    """A growing set of keys, bucketed as shuffles are: what is new is dealt out to meet it, what is known stays where it is."""

    def __init__(self, store: Store, name: str):
        self.spark, self.path = store.spark, f"{store.root}/{name}"
        self.table = f"{name}_{uuid.uuid4().hex}"
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, keys: DataFrame) -> None:
        """One column named ``key``; keys may repeat."""
        keys.select("key").write.mode("append").bucketBy(self.buckets, "key").option("path", self.path).saveAsTable(self.table)

    def without(self, rows: DataFrame, column: str = "key") -> DataFrame:
        """Rows whose key isn't in the set; of ``rows``, already grouped by the column, nothing is shuffled again."""
        known = self.spark.table(self.table).select(F.col("key").alias("_known"))
        return rows.join(known, F.col(column) == F.col("_known"), "left_anti")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


Rows = Callable[[DataFrame], DataFrame]


def walk(spark: SparkSession, seed: str, look_up: Rows, links_of: Rows, limits: Limits, robots_of: Rows | None = None, stop: Callable[[], bool] | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Pages, URLs left out ``(key, reason)``, and coverage.

    ``look_up`` answers ``(rank, key, url, referrer)`` with ``final_url`` and
    ``status_code`` (and more) beside them; ``links_of`` gives the links
    ``(page_seq, pos, to, nofollow)`` of answered pages; ``robots_of`` the
    robots files of ``(scheme, host)``. ``stop`` and an interrupt end the crawl
    before the next wave; what it has by then is its result.
    """
    store, began = Store(spark), time.time()
    key = lambda c: U.index_key(c, limits.strip_query)
    seed_host = home(spark, seed)
    frontier = spark.range(1).select(F.lit(0).cast("long").alias("rank"), key(F.lit(seed)).alias("key"), F.lit(seed).alias("url"), F.lit("").alias("referrer"))
    frontier = store.keep(frontier, "frontier-0")
    visited, answered = Keys(store, "visited"), Keys(store, "answered")
    visited.add(frontier)
    left = store.append(frontier.select("key", F.lit("").alias("reason")).where("false"), "left")
    pages, depth, n_pages = None, 0, 0
    budget = limits.max_pages - 1 if limits.max_pages else None  # 0: as many as there are
    cut = {"page_limit": False, "depth_limit": False, "duration_limit": False, "interrupted": False}
    while not frontier.isEmpty():
        late = limits.max_seconds and time.time() - began > limits.max_seconds
        if pages is not None and (late or (stop and stop())):
            reason = "duration_limit" if late else "interrupted"
            cut[reason] = True
            left = store.append(frontier.select("key", F.lit(reason).alias("reason")), "left")
            break
        try:
            got = look_up(frontier).withColumns({"depth": F.lit(depth), "final_key": key(F.col("final_url"))})
            got = got.withColumn("n", F.row_number().over(Window.partitionBy("final_key").orderBy("rank"))).where("n = 1").drop("n")
            if pages is not None:
                got = answered.without(got, "final_key")
            wave = store.numbered(got, ["rank"], "page_seq", f"wave-{depth}", n_pages)
            n = wave.count()
            pages = store.append(wave, "pages")
            n_pages += n
            ends = wave.select(F.col("final_key").alias("key"))
            answered.add(ends)
            visited.add(ends)
            out = links_of(wave).select("page_seq", "pos", "to", "nofollow")
            out = out.where(F.lit(limits.follow_nofollow) | ~F.col("nofollow")).withColumn("key", key(F.col("to")))
            out = visited.without(out.groupBy("key").agg(F.min(F.struct("page_seq", "pos", "to")).alias("first")).select("key", "first.*"))
            judged = store.keep(judge(store.keep(out, f"found-{depth}"), "to", seed_host, limits, robots_of), f"judged-{depth}")
            visited.add(judged)  # what is out of scope is not tested again
            fresh = judged.where("ok").drop("ok")
            if limits.max_depth and depth >= limits.max_depth:
                left = store.append(fresh.select("key", F.lit("depth").alias("reason")), "left")
                cut["depth_limit"] |= not fresh.isEmpty()
                break
            by = pages.select(F.col("page_seq").alias("by"), F.col("final_url").alias("referrer"))
            fresh = store.numbered(fresh, ["page_seq", "pos"], "rank", f"fresh-{depth}")
            if budget is not None:
                over = fresh.where(F.col("rank") > max(budget, 0))
                left = store.append(over.select("key", F.lit("pages").alias("reason")), "left")
                cut["page_limit"] |= not over.isEmpty()
                fresh = fresh.where(F.col("rank") <= max(budget, 0))
            fresh = fresh.join(by, F.col("page_seq") == F.col("by"), "left").select("rank", "key", F.col("to").alias("url"), "referrer")
            depth += 1
            frontier = store.keep(fresh, f"frontier-{depth}")
            budget = budget if budget is None else budget - frontier.count()
        except KeyboardInterrupt:
            cut["interrupted"] = True
            left = store.append(frontier.select("key", F.lit("interrupted").alias("reason")), "left")
            break
    visited.close()
    answered.close()
    if pages is None:  # interrupted in the first wave
        pages = look_up(frontier.where("false")).withColumns({"depth": F.lit(0), "final_key": F.lit(""), "page_seq": F.lit(0).cast("long")})
    known = pages.select(F.col("key").alias("k")).unionAll(pages.select("final_key")).distinct()
    left = left.join(known, F.col("key") == F.col("k"), "left_anti").distinct()
    n_left = left.count()
    ended = ("duration_limit", "interrupted")
    coverage = {"complete": n_left == 0 and not any(cut[k] for k in ended), "pages": n_pages, "not_crawled": n_left}
    return pages.drop("rank", "final_key"), left, coverage | {k: v and (n_left > 0 or k in ended) for k, v in cut.items()}


def home(spark: SparkSession, seed: str) -> dict:
    """The host of a seed, and the domain it belongs to."""
    return spark.range(1).select(U.hostname(F.lit(seed)).alias("h"), registrable(U.hostname(F.lit(seed))).alias("r")).first().asDict()


def judge(rows: DataFrame, column: str, seed_host: dict, limits: Limits, robots_of: Rows | None = None) -> DataFrame:
    """``rows`` with ``ok``: whether the URL in a column is in scope and, by the file of its scheme and host, open to robots.

    Links are judged so before they are queued, and redirects before they are followed.
    """
    to = F.col(column)
    scoped = rows.withColumn("ok", _in_scope(to, seed_host, limits))
    if not robots_of:
        return scoped
    hosts = scoped.where("ok").select(U.scheme(to).alias("scheme"), U.host(to).alias("host")).distinct()
    rules = R.with_rules(robots_of(hosts).select("scheme", "host", "status", "body"))
    rules = rules.select(F.col("scheme").alias("rs"), F.col("host").alias("rh"), F.struct("found", "status", "agents", "rules").alias("r"))
    known = scoped.join(rules, (U.scheme(to) == F.col("rs")) & (U.host(to) == F.col("rh")), "left")
    return known.withColumn("ok", F.col("ok") & R.allowed(R.robots_path(to), F.lit(limits.agent))).drop("rs", "rh", "r")


def _in_scope(to, seed_host, limits: Limits):
    host = U.hostname(to)
    ok = U.scheme(to).isin("http", "https")
    if not limits.follow_external:
        ok = ok & ((registrable(host) == seed_host["r"]) if limits.allow_subdomains else (host == seed_host["h"]))
    for pattern in limits.exclude:
        ok = ok & ~to.rlike(pattern)
    if limits.include:
        ok = ok & to.rlike("|".join(f"(?:{p})" for p in limits.include))
    return ok


def crawl(seed: str, responses: DataFrame, links: DataFrame, limits: Limits | None = None, robots: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """A crawl replayed over tables: pages ``(page_seq, key, url, depth, final_url, status_code)``, URLs left out, coverage.

    ``responses(url, final_url, status_code)``, of several for one URL the first by URL; ``links(page_url, pos, url, nofollow)`` by
    the final URL of the page; ``robots(scheme, host, status, body)``.
    """
    limits = limits or Limits()
    spark = responses.sparkSession
    store = Store(spark)
    key = lambda c: U.index_key(c, limits.strip_query)
    found = responses.groupBy(key(F.col("url")).alias("k")).agg(F.min(F.struct("url", "final_url", "status_code")).alias("a"))
    found = store.keep(found.select("k", "a.final_url", "a.status_code"), "responses")
    by_page = store.keep(links.select(key(F.col("page_url")).alias("from"), "pos", F.col("url").alias("to"), "nofollow"), "links")

    def look_up(frontier: DataFrame) -> DataFrame:
        answer = [F.coalesce("final_url", "url").alias("final_url"), F.coalesce("status_code", F.lit(0)).alias("status_code")]
        return frontier.join(found, F.col("key") == F.col("k"), "left").select("rank", "key", "url", *answer)

    def links_of(wave: DataFrame) -> DataFrame:
        return wave.select("page_seq", key(F.col("final_url")).alias("at")).join(by_page, F.col("at") == F.col("from"))

    def robots_of(hosts: DataFrame) -> DataFrame:
        return robots.join(hosts, ["scheme", "host"], "left_semi")

    pages, left, coverage = walk(spark, seed, look_up, links_of, limits, robots_of if robots is not None else None)
    return pages.select("page_seq", "key", "url", "depth", "final_url", "status_code"), left, coverage


def rotated(urls: DataFrame, pool: list[str], how: str = "round-robin", column: str = "agent") -> DataFrame:
    """``urls(rank, url)`` with one of the pool: in turn, by host, at random, or the first; null where there is none to choose."""
    if not pool:
        return urls.withColumn(column, F.lit(None).cast("string"))
    names = F.array(*map(F.lit, pool))
    if how == "off":
        place = F.lit(0)
    elif how == "sticky-host":
        place = R_.pick(U.host(F.col("url")), len(pool))
    elif how == "random":
        place = F.floor(F.rand() * len(pool))
    else:
        place = F.pmod(F.col("rank"), F.lit(len(pool)))
    return urls.withColumn(column, F.element_at(names, place.cast("int") + 1))
