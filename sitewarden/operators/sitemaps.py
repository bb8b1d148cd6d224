"""Sitemaps: reading, coverage against a crawl, and the site tree."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .crawl_rules import flat
from .rules import GATE, f, found, issue


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies as text; gzip is recognised by its first bytes, a broken one becomes null."""
    for batch in batches:
        out = []
        for body in batch.column("body").to_pylist():
            try:
                raw = gzip.decompress(body) if body and body[:2] == b"\x1f\x8b" else body or b""
                out.append(raw.decode("utf-8", "replace"))
            except (OSError, EOFError):
                out.append(None)
        keep = [c for c in batch.schema.names if c != "body"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "xml"])


def read(responses: DataFrame) -> DataFrame:
    """``url, status, body (binary), truncated, declared`` as ``url, declared, truncated, kind, locs``.

    ``kind`` is ``index``, ``urlset``, ``absent`` (no or an empty answer), ``cut`` (not read to its end) or ``invalid``; an
    index without entries is invalid.
    """
    made = responses.select("url", "status", "truncated", "declared", "body").mapInArrow(_unpack, "url string, status int, truncated boolean, declared boolean, xml string")
    root = F.regexp_extract(F.coalesce("xml", F.lit("")), r"^(?s)(?:\s|<\?.*?\?>|<!--.*?-->)*<(?:[A-Za-z0-9]+:)?(sitemapindex|urlset)\b", 1)
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(F.replace(x, F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit("")))
    locs = F.transform(locs, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    absent = (F.col("status") != 200) | (F.col("xml") == "")
    kind = F.when(absent, "absent").when(F.coalesce("truncated", F.lit(False)), "cut").when((root == "") | ((root == "sitemapindex") & (F.size(locs) == 0)), "invalid").when(root == "sitemapindex", "index").otherwise("urlset")
    return made.select("url", "declared", "truncated", kind.alias("kind"), locs.alias("locs"))


def entries(sitemaps: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """The listed URLs, and every sitemap reached from the candidates, at most ``depth`` indexes deep.

    ``sitemaps`` has all responses; ``declared`` or guessed ones are candidates, children are declared.
    """
    reached = sitemaps.where("declared IS NOT NULL")
    level = reached
    for _ in range(depth):
        children = level.where("kind = 'index'").select(F.explode("locs").alias("child")).distinct()
        level = sitemaps.where("declared IS NULL").join(children, F.col("url") == F.col("child"), "left_semi").withColumn("declared", F.lit(True))
        reached = reached.unionByName(level)
    reached = reached.groupBy("url").agg(F.max("declared").alias("declared"), F.max("truncated").alias("truncated"), F.min(F.struct("kind", "locs")).alias("m"))
    reached = reached.select("url", "declared", "truncated", "m.kind", "m.locs")
    return reached.where("kind = 'urlset'").select(F.explode("locs").alias("loc")), reached


def sitemap_issues(pages: DataFrame, sitemaps: DataFrame, seed: str) -> DataFrame:
    listed, reached = entries(read(sitemaps))
    each = flat(
        reached,
        found(
            issue("sitemap", "warning", "sitemap-invalid", F.col("declared") & (F.col("kind") == "invalid"), url=F.col("url")),
            issue("sitemap", "warning", "sitemap-truncated", F.col("declared") & (F.col("kind") == "cut"), url=F.col("url")),
        ),
    )
    keys = listed.select(U.sitemap_key(F.col("loc")).alias("k")).distinct()
    crawled = pages.where("status_code = 200").select(U.sitemap_key(F.col("final_url")).alias("c")).distinct()
    both = keys.join(crawled, F.col("k") == F.col("c"), "full_outer")
    one = both.agg(
        F.count("k").alias("listed"), F.count("c").alias("crawled"), F.count(F.when(F.col("k").isNull(), 1)).alias("extra"), F.count(F.when(F.col("c").isNull(), 1)).alias("missed")
    )
    state = reached.agg(F.coalesce(F.max(F.col("kind").isin("index", "urlset")), F.lit(False)).alias("parsed"), F.coalesce(F.max(F.col("declared") & (F.col("kind") == "cut")), F.lit(False)).alias("cut"))
    whole = flat(
        one.join(F.broadcast(state)),
        found(
            issue("sitemap", "warning", "sitemap-missing", ~F.col("parsed") & ~F.col("cut"), url=F.lit(seed)),
            issue("sitemap", "info", "sitemap-coverage", F.col("parsed"), url=F.lit(seed), sitemap_urls=F.col("listed"), crawled_pages=F.col("crawled"), crawled_not_in_sitemap=F.col("extra"), in_sitemap_not_crawled=F.col("missed")),
        ),
    )
    return each.unionAll(whole)


def site_entries(pages: DataFrame, host: str) -> DataFrame:
    """``loc, title, lastmod, page_seq`` of the good pages of a host and its subdomains, one per location."""
    own = U.hostname(F.col("final_url"))
    good = pages.where(GATE() & ((own == host) | own.endswith("." + host)))
    stamp = F.try_to_timestamp(F.regexp_extract(F.coalesce(F.get(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == "last-modified")), 0)[0], F.lit("")), "^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    rows = good.select(U.sitemap_key(F.col("final_url")).alias("loc_key"), F.col("final_url").alias("loc"), F.trim(f("title_any_first")).alias("title"), F.date_format(stamp, "yyyy-MM-dd").alias("lastmod"), "page_seq")
    return rows.groupBy("loc_key").agg(F.min_by(F.struct("loc", "title", "lastmod", "page_seq"), "page_seq").alias("e")).select("loc_key", "e.*")


def site_tree(entries_: DataFrame, issues: DataFrame) -> DataFrame:
    """``depth, prefix, url, title, n_pages, errors, warnings, infos``: counts include everything below a prefix.

    Path prefixes are rows; a page and its issues are added to each, so the roll-up is one aggregation.
    """
    counts = issues.groupBy(U.sitemap_key(F.col("url")).alias("ik")).agg(*(F.sum((F.col("severity") == s).cast("long")).alias(s) for s in ("error", "warning", "info")))
    rows = entries_.join(counts, F.col("loc_key") == F.col("ik"), "left")
    parts = F.filter(F.split(U.path(F.col("loc")), "/"), lambda p: p != "")
    each = rows.withColumn("parts", parts).select("*", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
    each = each.withColumn("prefix", F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, F.col("depth")), "/")))
    own = F.col("depth") == F.size("parts")
    # the root keeps its first page, deeper nodes their last
    order = F.when(F.col("depth") == 0, -F.col("page_seq")).otherwise(F.col("page_seq"))
    return each.groupBy("depth", "prefix").agg(
        F.max_by(F.when(own, F.col("loc")), F.when(own, order)).alias("url"),
        F.max_by(F.when(own, F.col("title")), F.when(own, order)).alias("title"),
        F.count(F.lit(1)).alias("n_pages"),
        *(F.sum(F.coalesce(s, F.lit(0))).alias(f"{s}s") for s in ("error", "warning", "info")),
    )


def attached(entries_: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues with ``prefix``, the place of their page in the tree; null for what names no page of it."""
    place = F.concat(F.lit("/"), F.array_join(F.filter(F.split(U.path(F.col("loc")), "/"), lambda p: p != ""), "/"))
    keys = entries_.select("loc_key", place.alias("prefix"))
    return issues.join(keys, U.sitemap_key(F.col("url")) == F.col("loc_key"), "left").drop("loc_key")


def sitemap_xml(entries_: DataFrame, path: str) -> None:
    """The entries as ``urlset`` files, ordered by location."""
    entries_.select("loc", "lastmod").orderBy("loc").write.mode("overwrite").format("xml").option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').option("rowTag", "url").save(path)
