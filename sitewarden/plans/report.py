"""Reports: counts, coverage notes, files, history and comparison of crawls."""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from html import escape
from typing import TextIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import sitemaps
from ..operators.catalog import CATALOG, explain
from ..sources.schema import ISSUES
from .crawl import Store

KEY = ["analyzer", "code", "url"]


def rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy(rank(F.col("severity")), "analyzer", "code", "url")


def summary(issues: DataFrame) -> DataFrame:
    """``dim, key, n``: by severity and by analyzer, from one pass with grouping sets."""
    g = issues.groupingSets([["severity"], ["analyzer"]], "severity", "analyzer").agg(F.count(F.lit(1)).alias("n"), F.grouping("severity").alias("by_analyzer"))
    return g.select(F.when(F.col("by_analyzer") == 1, "analyzer").otherwise("severity").alias("dim"), F.coalesce("severity", "analyzer").alias("key"), "n")


def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.col("status_code").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("dim"), "key", "n")


def coverage_note(duration: Column, interrupted: Column, page_limit: Column, depth_limit: Column, left: Column) -> Column:
    """Why a crawl is incomplete; the first reason counts."""
    return (
        F.when(left == 0, None)
        .when(duration, F.concat(F.lit("time limit reached, "), left, F.lit(" URLs left")))
        .when(interrupted, F.concat(F.lit("interrupted, "), left, F.lit(" URLs left")))
        .when(page_limit, F.concat(F.lit("page limit reached, "), left, F.lit(" URLs left")))
        .when(depth_limit, F.concat(F.lit("depth limit reached, "), left, F.lit(" URLs left")))
    )


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, m, a) for c, (m, a) in CATALOG.items()], "code string, message string, advice string")


def guarded(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(issues: DataFrame, path: str) -> None:
    ordered(issues).select(*(guarded(F.col(c)).alias(c) for c in issues.columns)).write.mode("overwrite").csv(path, header=True, escape='"')


def notes(coverage: dict, skipped: Iterable[str] = ()) -> list[str]:
    """What a reader must know before trusting the counts."""
    out = []
    if left := coverage.get("not_crawled", 0):
        why = {"duration_limit": "time limit reached", "interrupted": "interrupted", "page_limit": "page limit reached", "depth_limit": "depth limit reached"}
        first = next((text for k, text in why.items() if coverage.get(k)), "not complete")
        out.append(f"{first}, {left} URLs left")
    if skipped := list(skipped):
        out.append(f"not run, as queries were stripped: {', '.join(skipped)}")
    return out


def _issue(row: Row) -> dict:
    return {c: row[c] for c in ("severity", "analyzer", "code", "url", "message")} | {"data": json.loads(row["data"]) if row["data"] else None}


def _quoted(c: Column) -> Column:
    """A string as JSON, null as null."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _issue_json() -> Column:
    fields = [(c, _quoted(F.col(c))) for c in ("analyzer", "code", "message", "severity", "url")] + [("data", F.coalesce("data", F.lit("null")))]
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), value) for name, value in fields)), F.lit("}"))


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and their issues, in order, as lines: a node opens, its issues follow one a line, and it closes before the next."""
    is_open, first = False, True
    for batch in batches:
        lines = []
        for kind, text in zip(batch.column("kind").to_pylist(), batch.column("json").to_pylist(), strict=True):
            if kind == 0:
                lines += ["]}"] if is_open else []
                lines.append(f",{text[:-1]},\"issues\":[")
                is_open, first = True, True
            else:
                lines.append(text if first else f",{text}")
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])
    if is_open:
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["line"])


def site_map_lines(pages: DataFrame, issues: DataFrame, seed: str) -> DataFrame:
    """``line``: the site tree, parents first, each page with its issues; at last, without a prefix, what names no page of it.

    Nodes and issues meet by ranges of the prefix, so a node and what hangs on
    it are one partition's, and stream through it.
    """
    entries = sitemaps.site_entries(pages, urlsplit(seed).hostname or "")
    placed = sitemaps.attached(entries, issues)
    counted = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]
    own = placed.where("prefix IS NOT NULL").groupBy(F.col("prefix").alias("p")).agg(*counted)
    tree = sitemaps.site_tree(entries, issues).join(own, F.col("prefix") == F.col("p"), "left").join(_status_of(pages), F.col("url") == F.col("at"), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    made = F.struct(
        "prefix", "depth", "url", "title", F.col("n_pages").alias("pages"), status_class(F.col("status_code")).alias("status"),
        F.struct(*(number(s).alias(s) for s in SEVERITIES)).alias("counts"), F.struct(*(F.col(f"{s}s").alias(s) for s in SEVERITIES)).alias("subtotal"),
    )
    order = ["kind", "r", "code", "analyzer", "url"]
    blank = [F.lit(None).cast("string").alias(c) for c in ("code", "analyzer", "url")]
    nodes = tree.select("prefix", F.lit(0).alias("kind"), F.lit(0).alias("r"), *blank, F.to_json(made, {"ignoreNullFields": "false"}).alias("json"))
    last = entries.sparkSession.range(1).select(F.lit(None).cast("string").alias("prefix"), F.lit(0).alias("kind"), F.lit(0).alias("r"), *blank, F.lit('{"prefix":null}').alias("json"))
    below = placed.select("prefix", F.lit(1).alias("kind"), rank(F.col("severity")).alias("r"), "code", "analyzer", "url", _issue_json().alias("json"))
    place = F.col("prefix").asc_nulls_last()
    return nodes.unionAll(last).unionAll(below).repartitionByRange(place).sortWithinPartitions(place, *order).select("kind", "json").mapInArrow(_nest, "line string")


def _status_of(pages: DataFrame) -> DataFrame:
    """The status of each final URL, its first page's."""
    return pages.groupBy(F.col("final_url").alias("at")).agg(F.min_by("status_code", "page_seq").alias("status_code"))


def status_class(status: Column) -> Column:
    """What an answer is, for the eye; null and 0 are no answer."""
    return F.when(status.between(200, 299), "ok").when(status.between(300, 399), "redirect").when(F.coalesce(status, F.lit(0)) == 0, "none").otherwise("error")


SEVERITIES = ("error", "warning", "info")
CHUNK = 1 << 20


class _Parts:
    """Text that executors wrote in order, read back as one; its first character, a comma, is left out."""

    def __init__(self, spark: SparkSession, lines: DataFrame, name: str):
        self.spark, self.path = spark, f"{Store(spark).root}/{name}"
        lines.write.text(self.path)
        self.hadoop, self.conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()

    def streams(self) -> Iterator:
        at = self.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.conf)
        begun = False
        for path in sorted(f.getPath().toString() for f in files.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()):
            stream = files.open(self.hadoop.fs.Path(path))
            if not begun:
                stream.read()
                begun = True
            yield stream
            stream.close()
        files.delete(at, True)

    def text(self) -> Iterator[str]:
        decode = codecs.getincrementaldecoder("utf-8")()
        for stream in self.streams():
            while chunk := bytes(stream.readNBytes(CHUNK)):
                yield decode.decode(chunk)


def document(issues: DataFrame, pages: DataFrame, seed: str, coverage: dict | None = None, skipped: Iterable[str] = ()) -> Iterator[str | _Parts]:
    """A report in pieces: the driver's own words (counts, notes, what codes mean), and parts that executors wrote, a row per line."""
    coverage, spark = coverage or {}, issues.sparkSession
    counts = summary(issues).unionAll(status_counts(pages)).collect()
    dims = {d: {r["key"]: r["n"] for r in counts if r["dim"] == d} for d in ("severity", "analyzer", "status")}
    codes = sorted(r["code"] for r in issues.select("code").distinct().collect())
    head = {"seed": seed, "pages_crawled": sum(dims["status"].values()), "summary": dims, "coverage": coverage, "notes": notes(coverage, skipped), "explanations": {c: explain(c) for c in codes}}
    yield json.dumps(head, indent=2, sort_keys=True)[:-2] + f",\n{_ISSUES}\n"
    yield _Parts(spark, ordered(issues).select(F.concat(F.lit(","), _issue_json()).alias("line")), "issues")
    yield f"  ],\n{_SITE_MAP}\n"
    yield _Parts(spark, site_map_lines(pages, issues, seed), "site-map")
    yield "  ]\n}\n"


_ISSUES, _SITE_MAP = '  "issues": [', '  "site_map": ['


def write_json(out: TextIO | str, issues: DataFrame, pages: DataFrame, seed: str, coverage: dict | None = None, skipped: Iterable[str] = ()) -> None:
    """One document: summary, coverage, notes, issues with what they mean, and the site map.

    To a path, the file system copies what executors wrote; nothing but counts
    passes the driver's Python. To an open file, it passes in chunks.
    """
    pieces = document(issues, pages, seed, coverage, skipped)
    if not isinstance(out, str):
        for piece in pieces:
            for text in [piece] if isinstance(piece, str) else piece.text():
                out.write(text)
        return
    hadoop = issues.sparkSession._jvm.org.apache.hadoop
    at = hadoop.fs.Path(out if "://" in out else f"file://{os.path.abspath(out)}")
    files = at.getFileSystem(issues.sparkSession._jsc.hadoopConfiguration())
    files.setWriteChecksum(False)
    target = files.create(at, True)
    for piece in pieces:
        if isinstance(piece, str):
            target.write(bytearray(piece.encode()))
        else:
            for stream in piece.streams():
                hadoop.io.IOUtils.copyBytes(stream, target, 1 << 16, False)
    target.close()


def lines_of(pieces: Iterable[str | _Parts]) -> Iterator[str]:
    """The lines of a document in pieces."""
    held = ""
    for piece in pieces:
        for text in [piece] if isinstance(piece, str) else piece.text():
            *whole, held = (held + text).split("\n")
            yield from whole
    yield held


class _Read:
    """A JSON report read line by line: ``head`` at once, then the issues, then the nodes, each once and in this order."""

    def __init__(self, lines: Iterable[str]):
        self.lines, held = iter(lines), []
        for line in self.lines:
            if line.rstrip() == _ISSUES:
                break
            held.append(line)
        self.head = json.loads("".join(held).rstrip().rstrip(",") + "}")

    def issues(self) -> Iterator[dict]:
        for line in self.lines:
            if line.strip() == "],":
                return
            if line.strip():
                yield json.loads(line.strip().lstrip(","))

    def nodes(self) -> Iterator[tuple[dict, Iterator[dict]]]:
        """Each node and its issues, to be read before the next."""
        for line in self.lines:
            if line.strip().endswith('"issues":['):
                own = self._own()
                yield json.loads(line.strip().lstrip(",") + "]}"), own
                for _ in own:
                    pass

    def _own(self) -> Iterator[dict]:
        for line in self.lines:
            if line.strip() == "]}":
                return
            yield json.loads(line.strip().lstrip(","))


def write_html(out: TextIO, lines: Iterable[str]) -> None:
    """A self-contained page from the lines of a JSON report, a row at a time; everything from the crawl is escaped."""
    report = _Read(lines)
    head = report.head
    title = f"Audit of {escape(head['seed'])}"
    out.write(f"<!doctype html><meta charset=utf-8><title>{title}</title><style>.error{{color:#a00}}.warning{{color:#850}}.redirect{{color:#06c}}.none{{color:#777}}</style><h1>{title}</h1>")
    for note in head["notes"]:
        out.write(f"<p role=alert><b>{escape(note)}</b></p>")
    for dim, counts in sorted(head["summary"].items()):
        out.write(f"<p>{escape(dim)}: {escape(', '.join(f'{k} {n}' for k, n in sorted(counts.items())))}</p>")

    def table(names: list[str], rows: Iterable[tuple[str, list]]) -> None:
        out.write("<table border=1><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>")
        for kind, row in rows:
            out.write(f"<tr class={kind}>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in row) + "</tr>\n")
        out.write("</table>")

    what = head["explanations"]
    out.write("<h2>Issues</h2>")
    shown = ("severity", "analyzer", "code", "url", "message")
    severity = lambda i: i["severity"] if i["severity"] in SEVERITIES else "info"
    table([*shown, "data", "impact", "fix"], ((severity(i), [*(i[c] for c in shown), json.dumps(i["data"]) if i["data"] else "", what[i["code"]]["impact"], what[i["code"]]["fix"]]) for i in report.issues()))
    out.write("<h2>Site map</h2>")
    site: list[tuple[dict, Iterator[dict]]] = []

    def pages() -> Iterator[tuple[str, list]]:
        for node, own in report.nodes():
            if node["prefix"] is None:  # the last
                site.append((node, own))
                return
            yield node.get("status") or "none", [node["prefix"], node["title"], node["pages"], " ".join(i["code"] for i in own), sum(node["subtotal"].values())]

    table(["path", "title", "pages", "issues here", "issues below"], pages())
    out.write("<h2>Site-wide</h2>")
    table(["severity", "code", "url"], ((severity(i), [i["severity"], i["code"], i["url"]]) for _, own in site for i in own))


def save(issues: DataFrame, root: str, host: str, crawl_ts: str) -> None:
    """Appends a crawl to the history; the commit protocol makes it all or nothing."""
    if not re.fullmatch(r"[A-Za-z0-9.:\[\]-]+", host) or ".." in host or not re.fullmatch(r"\d{8}T\d{6}Z", crawl_ts):
        raise ValueError(f"no host and time of a crawl: {host!r}, {crawl_ts!r}")
    issues.withColumns({"host": F.lit(host), "ts": F.lit(crawl_ts)}).write.mode("append").partitionBy("host", "ts").parquet(root)


def history(spark: SparkSession, root: str, host: str | None = None) -> DataFrame:
    """``host, ts, issues``, newest first; partition pruning keeps other hosts unread."""
    rows = spark.read.schema(f"{ISSUES}, host string, ts string").parquet(root)
    rows = rows.where(F.col("host") == host) if host else rows
    return rows.groupBy("host", "ts").agg(F.count(F.lit(1)).alias("n_issues")).orderBy(F.desc("ts"), F.desc("host"))


def stored(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """Issues of a report file, ``latest``, ``<host>/<ts>`` or a host's newest crawl; a file that exists goes first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(ref if "://" in ref else f"file://{os.path.abspath(ref)}")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at) and files.getFileStatus(at).isFile():
        return reported(spark, at.toString())
    host, _, ts = ref.partition("/")
    if not ts:
        newest = history(spark, root, None if ref == "latest" else ref).first()
        if newest is None:
            raise LookupError(f"no crawl for {ref!r}")
        host, ts = newest["host"], newest["ts"]
    return spark.read.schema(f"{ISSUES}, host string, ts string").parquet(root).where((F.col("host") == host) & (F.col("ts") == ts)).drop("host", "ts")


def reported(spark: SparkSession, path: str) -> DataFrame:
    """The issues of a JSON report: those of its lines that are one, up to where the site map repeats them."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), "^,", "").alias("line"), F.monotonically_increasing_id().alias("n"))
    ends = lines.where(F.col("line") == _SITE_MAP.strip()).agg(F.min("n").alias("end"))  # one row
    rows = lines.where(F.col("line").startswith('{"analyzer":')).join(F.broadcast(ends)).where("end IS NULL OR n < end")
    value = F.from_json("line", "analyzer string, url string, severity string, code string, message string, data string")
    return rows.select(value.alias("i")).select("i.*")


def compare(base: DataFrame, current: DataFrame, page: str | None = None) -> DataFrame:
    """Issues with ``bucket``: new, resolved or persisting. Severity doesn't tell issues apart; repeated ones stay.

    ``page`` names a column that numbers pages, for crawls that hold several pages of one URL; else the URL tells them apart.
    """
    key = [*KEY, page] if page else KEY
    tagged = lambda frame, name: frame.select(F.lit(name).alias("bucket"), *base.columns)
    return reduce(
        DataFrame.unionAll,
        [
            tagged(current.join(base.select(key).distinct(), key, "left_anti"), "new"),
            tagged(base.join(current.select(key).distinct(), key, "left_anti"), "resolved"),
            tagged(current.join(base.select(key).distinct(), key, "left_semi"), "persisting"),
        ],
    )


def summary_delta(base: DataFrame, current: DataFrame) -> DataFrame:
    """``dim, key, delta`` of two summaries, zeros left out."""
    b, c = base.withColumnRenamed("n", "b"), current.withColumnRenamed("n", "c")
    both = b.join(c, ["dim", "key"], "full_outer").select("dim", "key", (F.coalesce("c", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"))
    return both.where("delta <> 0")


def page_diff(base: DataFrame, current: DataFrame, page: str | None = None) -> DataFrame:
    """``kind, url``: pages added and removed, a row each. ``page`` is as in ``compare``."""
    key = ["url", page] if page else ["url"]
    added = current.select(*key).distinct().join(base.select(*key).distinct(), key, "left_anti")
    removed = base.select(*key).distinct().join(current.select(*key).distinct(), key, "left_anti")
    return added.select(F.lit("added").alias("kind"), "url").unionAll(removed.select(F.lit("removed").alias("kind"), "url"))


def diff_text(diff: DataFrame, most: int = 20) -> str:
    """A few lines per bucket."""
    out = []
    for bucket in ("new", "resolved", "persisting"):
        rows = ordered(diff.where(F.col("bucket") == bucket)).limit(most).collect()
        out += [f"{bucket}:", *(f"  {r['severity']} {r['code']} {r['url']}" for r in rows)]
    return "\n".join(out)


def diff_json(diff: DataFrame, delta: DataFrame, pages: DataFrame | None = None) -> str:
    """Counts per bucket, changes of the summary, and the issues that are new or resolved; what persists is only counted."""
    counts = {r["bucket"]: r["n"] for r in diff.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    changed = {b: [_issue(r) for r in ordered(diff.where(F.col("bucket") == b)).toLocalIterator()] for b in ("new", "resolved")}
    moved = {f"{r['dim']}:{r['key']}": r["delta"] for r in delta.collect()}
    out = {"counts": {b: counts.get(b, 0) for b in ("new", "resolved", "persisting")}, "summary_delta": moved} | changed
    if pages is not None:
        out["pages"] = {k: sorted(r["url"] for r in pages.where(F.col("kind") == k).toLocalIterator()) for k in ("added", "removed")}
    return json.dumps(out, indent=2, sort_keys=True)
