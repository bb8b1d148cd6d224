"""Command line: crawl a site, audit a table of pages, render, compare and list stored crawls, check redirect rules."""

from __future__ import annotations

import argparse
import contextlib
import sys
import time
from dataclasses import fields
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .operators import redirects
from .plans import audit, config, crawl, live, report
from .sources import schema


def _say(issues: DataFrame, n_pages: int, notes: list[str]) -> None:
    """The outcome in a few lines, beside what goes to standard output."""
    by = {r["key"]: r["n"] for r in report.summary(issues).where("dim = 'severity'").collect()}
    print(f"{n_pages} pages, {sum(by.values())} issues: " + ", ".join(f"{by.get(s, 0)} {s}" for s in ("error", "warning", "info")), *notes, sep="\n", file=sys.stderr)


def _write(issues: DataFrame, pages: DataFrame, seed: str, kind: str, out: str | None, coverage: dict, skipped: list[str]) -> None:
    if kind == "csv":
        report.write_csv(issues, out or "issues")
        return
    if kind == "json" and out:
        report.write_json(out, issues, pages, seed, coverage, skipped)
        return
    with open(out, "w") if out else contextlib.nullcontext(sys.stdout) as f:
        if kind == "json":
            report.write_json(f, issues, pages, seed, coverage, skipped)
        else:
            report.write_html(f, report.lines_of(report.document(issues, pages, seed, coverage, skipped)))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sitewarden")
    sub = parser.add_subparsers(dest="command", required=True)

    def selection(p: argparse.ArgumentParser) -> None:
        p.add_argument("--only", nargs="*", default=[])
        p.add_argument("--skip", nargs="*", default=[])
        p.add_argument("--format", choices=["json", "csv", "html"])
        p.add_argument("--out")
        p.add_argument("--store")
        p.add_argument("--time", help="yyyymmddThhmmssZ; now, if not given")

    w = sub.add_parser("crawl", help="fetch a site and audit it")
    w.add_argument("seed", nargs="?")
    w.add_argument("--config", help="YAML file; the environment and these options go before it")
    for name in ("max-pages", "max-depth", "concurrency", "max-redirects", "max-body-bytes"):
        w.add_argument(f"--{name}", type=int)
    for name in ("rate", "timeout", "max-seconds"):
        w.add_argument(f"--{name}", type=float)
    for name in ("include", "exclude"):
        w.add_argument(f"--{name}", nargs="*")
    for name in ("follow-external", "follow-nofollow", "allow-subdomains", "strip-query", "probes"):
        w.add_argument(f"--{name}", action="store_const", const=True)
    w.add_argument("--ignore-robots", dest="robots", action="store_const", const=False)
    w.add_argument("--basic-auth")
    w.add_argument("--pages", help="where to write the crawled pages (Parquet)")
    selection(w)
    i = sub.add_parser("init", help="a settings file with the defaults")
    i.add_argument("path", nargs="?", default="sitewarden.yaml")
    n = sub.add_parser("render", help="an HTML page from a JSON report")
    n.add_argument("report")
    n.add_argument("out")
    a = sub.add_parser("audit", help="issues of a Parquet table of pages")
    a.add_argument("pages")
    a.add_argument("--seed", default="")
    a.add_argument("--host")
    selection(a)
    sub.add_parser("analyzers", help="names, in order")
    c = sub.add_parser("compare", help="two stored crawls")
    c.add_argument("store")
    c.add_argument("base")
    c.add_argument("current")
    c.add_argument("--format", choices=["text", "json"], default="text")
    c.add_argument("--fail-on-new", action="store_true")
    h = sub.add_parser("history", help="stored crawls, newest first")
    h.add_argument("store")
    h.add_argument("--host")
    r = sub.add_parser("check-redirects", help="a rule CSV against what sources and targets answer and what the sitemap lists")
    for name in ("rules", "domain", "out"):
        r.add_argument(name)
    r.add_argument("--responses", help="answers (Parquet); they are fetched if it isn't given")
    r.add_argument("--sitemap", help="URLs of the sitemap (Parquet); it is looked for if it isn't given")
    r.add_argument("--sitemap-url", help="where the sitemap is, in place of the usual addresses")
    r.add_argument("--config")
    given = parser.parse_args(args)
    if given.command == "init":
        with open(given.path, "x") as f:
            f.write(config.sample())
        return 0
    if given.command == "render":
        with open(given.report) as f, open(given.out, "w") as out:
            report.write_html(out, f)
        return 0
    if given.command == "analyzers":
        print("\n".join(audit.ORDER))
        return 0
    spark = SparkSession.builder.appName("sitewarden").getOrCreate()
    if given.command == "crawl":
        names = {f.name for f in fields(config.Config)}
        asked = {k: v for k, v in vars(given).items() if k in names and v not in (None, [])}
        settings = config.load(given.config, **asked, analyzers=given.only or None, skip=given.skip or None)
        if not settings.seed:
            parser.error("crawl needs a seed")
        made = live.crawl_site(spark, settings, probes=settings.probes)
        pages = made.pages
        if given.pages:
            pages.select(*(f.name for f in StructType.fromDDL(schema.PAGES))).write.mode("overwrite").parquet(given.pages)
        issues = crawl.Store(spark).keep(audit.audit(pages, made.options), "issues")
        _, skipped = audit.select(made.options)
        _say(issues, made.coverage["pages"], report.notes(made.coverage, skipped))
        if given.store:
            report.save(issues, given.store, urlsplit(settings.seed).netloc, given.time or time.strftime("%Y%m%dT%H%M%SZ", time.gmtime()))
        _write(issues, pages, settings.seed, settings.format, given.out, made.coverage, skipped)
        return 130 if made.coverage["interrupted"] else 0
    if given.command == "audit":
        pages = audit.prepare(audit.spread(spark.read.parquet(given.pages))).persist()
        options = audit.Options(enabled=given.only, disabled=given.skip, seed=given.seed)
        issues = audit.audit(pages, options).persist()
        _say(issues, pages.count(), [])
        if given.store:
            report.save(issues, given.store, given.host or "", given.time or time.strftime("%Y%m%dT%H%M%SZ", time.gmtime()))
        _write(issues, pages, given.seed, given.format or "json", given.out, {}, [])
    elif given.command == "compare":
        base, current = (report.stored(spark, given.store, ref) for ref in (given.base, given.current))
        diff = report.compare(base, current).persist()
        print(report.diff_json(diff, report.summary_delta(report.summary(base), report.summary(current))) if given.format == "json" else report.diff_text(diff))
        return int(given.fail_on_new and not diff.where("bucket = 'new'").isEmpty())
    elif given.command == "history":
        for row in report.history(spark, given.store, given.host).toLocalIterator():
            print(f"{row['host']}/{row['ts']}\t{row['n_issues']}")
    else:
        settings = config.load(given.config, seed=given.domain)
        rules = redirects.read_rules(spark, given.rules)
        answers = spark.read.parquet(given.responses) if given.responses else live.rule_answers(spark, rules, given.domain, settings)
        listed = spark.read.parquet(given.sitemap) if given.sitemap else live.listed_urls(spark, given.domain, live.fetch_options(settings), given.sitemap_url)
        checked = redirects.check(rules, answers, listed, given.domain)
        redirects.write_results(checked, given.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
