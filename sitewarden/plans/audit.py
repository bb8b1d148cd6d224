"""The analyzers of an audit, in order, and the plan that runs a selection of them.

The HTML pass runs once; its result is written (or cached by the caller), after
which page rules are one projection and one explode, and crawl rules are a few
joins over narrow columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl_rules as C
from ..operators import robots as R
from ..operators import rules as P
from ..operators import sitemaps as M
from ..sources.html import with_features
from ..sources.schema import ISSUES

#: The order of reports; names are the selection's vocabulary.
ORDER = [
    "redirects", "links", "seo", "robots", "sitemap", "structured", "duplicates", "content", "images", "security", "urls", "hreflang",
    "pagination", "amp", "perf", "tracking", "datalayer", "utm", "landing", "botwall", "wordpress", "aeo", "geo",
]
NEEDS_QUERY = {"utm", "landing", "wordpress"}


@dataclass
class Options:
    """``robots``, ``sitemaps``, ``llms`` and ``probes`` are response tables; what is missing is not judged."""

    enabled: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    strip_query: bool = False
    seed: str = ""
    agent: str = "sitewarden"
    answer_lead: bool = False
    quotable_density: bool = False
    robots: DataFrame | None = None
    sitemaps: DataFrame | None = None
    llms: DataFrame | None = None
    probes: DataFrame | None = None


def select(options: Options) -> tuple[list[str], list[str]]:
    """The analyzers to run, in order, and those left out because queries were stripped. Unknown names are ignored."""
    chosen = [a for a in ORDER if (not options.enabled or a in options.enabled) and a not in options.disabled]
    skipped = [a for a in chosen if options.strip_query and a in NEEDS_QUERY]
    return [a for a in chosen if a not in skipped], skipped


def prepare(pages: DataFrame) -> DataFrame:
    """Pages with features and the facts that need their HTML."""
    return with_features(pages).withColumn("wp", C.wordpress_signals())


def audit(prepared: DataFrame, options: Options | None = None) -> DataFrame:
    """The issues of a crawl."""
    options = options or Options()
    names, _ = select(options)
    facts = C.crawl_facts(prepared)
    rows = prepared.join(F.broadcast(facts))  # one row
    page = dict(P.PAGE_RULES) | {"aeo": lambda: P.aeo(options.answer_lead), "geo": lambda: P.geo(options.quotable_density)}
    arrays = [page[n]() for n in names if n in page]
    out = [C.flat(rows, F.concat(*arrays))] if arrays else []
    late = C.not_collected(facts, options.seed)
    whole = {"links": C.links, "pagination": C.pagination, "amp": C.amp, "hreflang": C.hreflang, "duplicates": C.duplicates, "content": C.content, "landing": C.landing}
    for n in names:
        if n in whole:
            out.append(whole[n](prepared))
        if n in late:
            out.append(late[n])
        if n == "wordpress":
            out.append(C.wordpress_site(prepared, options.seed))
            if options.probes is not None:
                out.append(C.wordpress_probes(options.probes, options.seed))
        if n == "robots" and options.robots is not None:
            out.append(R.robots_issues(prepared, options.robots, options.agent))
        if n == "geo" and options.robots is not None:
            out.append(R.ai_access(options.robots))
        if n == "geo" and options.llms is not None:
            out.append(R.llms_txt(options.llms, options.seed))
        if n == "sitemap" and options.sitemaps is not None:
            out.append(M.sitemap_issues(prepared, options.sitemaps, options.seed))
    if not out:
        return prepared.sparkSession.createDataFrame([], ISSUES)
    return reduce(DataFrame.unionAll, out)


def crawl_of(pages: DataFrame) -> DataFrame:
    """A ``pages(page_id, url, html)`` table as a crawl in which every page answered 200."""
    return pages.selectExpr(
        "page_id AS page_seq", "url AS requested_url", "url AS final_url", "200 AS status_code", "cast(NULL AS map<string, array<string>>) AS headers",
        "'text/html' AS content_type", "html", "cast(NULL AS string) AS raw_html", "cast(array() AS array<struct<`from`: string, `to`: string, status: int>>) AS redirects",
        "0 AS depth", "'' AS referrer", "0L AS duration_ms", "'' AS err", "false AS truncated",
        "cast(NULL AS struct<implemented: boolean, note: string, raw_fallback: boolean, rendered_bytes: int, raw_bytes: int, lcp_ms: double, fcp_ms: double,"
        " cls: double, tbt_ms: double, ttfb_ms: double, data_layer_present: boolean, data_layer: array<string>, requests: array<string>>) AS render",
    )


def spread(table: DataFrame) -> DataFrame:
    """A table of few files dealt to all cores, as parsing is what takes time; one of many files stays as it is.

    The number of partitions doesn't tell: a file is split by bytes, but a row group is read by one task.
    """
    cores, parts = table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions()
    return table.repartition(max(cores, parts)) if min(parts, len(table.inputFiles())) < cores else table


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_of(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
