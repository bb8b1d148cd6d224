import gzip

import pytest
from pyspark.sql import functions as F

from sitewarden.operators import redirects, robots, sitemaps
from sitewarden.plans import crawl, fixtures, report
from sitewarden.sources.schema import ISSUES
from sitewarden.streaming import throttle


def issues(spark, rows):
    return spark.createDataFrame([("seo", u, s, c, "m", None) for u, s, c in rows], ISSUES)


def test_compare_ignores_severity(spark):
    base = issues(spark, [("u1", "error", "a"), ("u2", "info", "b")])
    now = issues(spark, [("u1", "warning", "a"), ("u3", "info", "b"), ("u3", "info", "b")])
    got = sorted((r.bucket, r.url) for r in report.compare(base, now).collect())
    assert got == [("new", "u3"), ("new", "u3"), ("persisting", "u1"), ("resolved", "u2")]
    delta = {(r.dim, r.key): r.delta for r in report.summary_delta(report.summary(base), report.summary(now)).collect()}
    assert delta == {("severity", "error"): -1, ("severity", "warning"): 1, ("severity", "info"): 1, ("analyzer", "seo"): 1}
    assert "u2" in report.diff_text(report.compare(base, now))


def test_history_and_references(spark, tmp_path):
    root = str(tmp_path / "h")
    rows = issues(spark, [("u", "info", "a")])
    report.save(rows, root, "a.example", "20240101T000000Z")
    report.save(rows.unionAll(rows), root, "a.example", "20240201T000000Z")
    report.save(rows, root, "b.example", "20240102T000000Z")
    assert [(r.host, r.ts, r.n_issues) for r in report.history(spark, root).collect()][0] == ("a.example", "20240201T000000Z", 2)
    assert report.history(spark, root, "b.example").count() == 1
    assert report.stored(spark, root, "latest").count() == 2
    assert report.stored(spark, root, "a.example/20240101T000000Z").count() == 1
    for host in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            report.save(rows, root, host, "20240101T000000Z")


def test_files(spark, tmp_path):
    rows = issues(spark, [("=cmd", "info", "seo-missing-title"), ("<b>", "error", "seo-missing-title")])
    report.write_csv(rows, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert "'=cmd" in text and text.index("<b>") < text.index("'=cmd")
    pages = spark.createDataFrame([(200,), (0,)], "status_code int")
    sitemaps.sitemap_xml(spark.createDataFrame([("https://a/?x&y", None)], "loc string, lastmod string"), str(tmp_path / "x"))
    assert "&amp;" in "".join(p.read_text() for p in (tmp_path / "x").glob("part*"))


def test_crawl_matches_plain_breadth_first(spark):
    from sitewarden.plans.registry import _LINKS, _graph

    depth, front = {"https://g.example/": 0}, ["https://g.example/"]
    while front:
        new = [b for a in front for x, b in _LINKS if "https://g.example" + x == a and b.startswith("https://g.example") and b not in depth]
        front = list(dict.fromkeys(new))
        depth |= {b: depth.get(b, max(depth.values()) + 1) for b in front}
    pages, left, coverage = crawl.crawl("https://g.example/", *_graph(spark))
    assert {r.key: r.depth for r in pages.collect()} == depth
    assert coverage["complete"] and left.isEmpty()
    pages, left, coverage = crawl.crawl("https://g.example/", *_graph(spark), crawl.Limits(max_depth=1, exclude=["/b$"]))
    assert {r.key for r in pages.collect()} == {"https://g.example/", "https://g.example/a"}
    assert coverage["depth_limit"] and not coverage["complete"] and left.count() == 1


def test_robots_states(spark):
    rows = spark.createDataFrame([("https", "a", 503, ""), ("https", "b", 404, ""), ("https", "c", 200, "User-agent: x\nUser-agent: *\nDisallow: /p\nAllow: /p")], "scheme string, host string, status int, body string")
    known = robots.with_rules(rows)
    got = {r.host: r.ok for r in known.select("host", F.struct(*known.columns).alias("r")).select("host", robots.allowed(F.lit("/p"), F.lit("Bot/1")).alias("ok")).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_sitemap_kinds(spark):
    body = lambda s: s.encode()
    rows = [
        ("i", 200, False, True, body("<sitemapindex></sitemapindex>")),
        ("z", 200, False, True, gzip.compress(body("<urlset><url><loc> https://a/ </loc></url></urlset>"))),
        ("b", 200, False, True, b"\x1f\x8bbroken"),
        ("t", 200, True, True, body("<urlset>")),
    ]
    made = sitemaps.read(spark.createDataFrame(rows, "url string, status int, truncated boolean, declared boolean, body binary"))
    got = {r.url: (r.kind, r.locs) for r in made.collect()}
    assert got["i"][0] == got["b"][0] == "invalid" and got["z"] == ("urlset", ["https://a/"])


def test_redirect_csv_needs_its_header(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("Original URL,Redirect to,Redirect type,Redirect style,Priority,Match query strings,Ignore trailing slash,Ignore protocol,Disable if page exists,Note\n/a,/b,301,s,1,,,,,\n")
    assert redirects.read_rules(spark, str(good)).count() == 1
    bad = tmp_path / "bad.csv"
    bad.write_text("From,To\n/a,/b\n")
    with pytest.raises(Exception):
        redirects.read_rules(spark, str(bad)).collect()


def test_throttle_batch_and_stream_agree(spark, tmp_path):
    rows = spark.createDataFrame(
        [("h", t, i, 429, None) for i, t in enumerate([0.0, 1.0, 2.5, 4.4, 4.6])] + [("k", 0.0, 0, 503, 20.0), ("k", 9.0, 1, 200, None)],
        "host string, at double, seq int, status_code int, retry_after double",
    )
    got = {r.host: (r.rate, r.accepted) for r in throttle.per_host(rows).collect()}
    assert got == {"h": (0.25, 3), "k": (0.05, 1)}
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = throttle.stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.host: (r.rate, r.accepted) for r in spark.table("rates").collect()} == got


def test_pages_stream(spark, tmp_path):
    from sitewarden.plans.audit import Options
    from sitewarden.streaming import pages as stream

    fixtures.pages(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(fixtures.pages(spark).schema).parquet(str(tmp_path / "in"))
    stream.start(source, str(tmp_path / "out"), str(tmp_path / "ck"), Options(enabled=["images"])).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_and_batch_agree(spark, tmp_path):
    """Late and repeated pages in several files, a restart in between: each page is judged once, as it is in a batch."""
    from sitewarden.plans import audit
    from sitewarden.streaming import pages as stream

    made = fixtures.pages(spark).withColumn("fetched_at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(page_seq AS int), 0)"))
    rows = made.count()
    source, out, kept, state = (str(tmp_path / n) for n in ("in", "out", "kept", "state"))
    parts = [made.where("page_seq % 2 = 0"), made.where("page_seq % 2 = 1"), made.withColumn("fetched_at", F.expr("fetched_at + interval 5 minutes"))]
    options = audit.Options(disabled=["perf"])
    for k, part in enumerate(parts):  # the last repeats everything, after a restart
        part.coalesce(1).write.mode("append").parquet(source)
        if k != 1:
            frame = spark.readStream.schema(made.schema).parquet(source)
            stream.start(frame, out, state, options, stored=kept).awaitTermination()
    columns = ["code", "severity", "url", "data"]
    got = sorted(map(repr, spark.read.parquet(out).select(*columns).collect()))
    want = sorted(map(repr, stream.page_issues(stream.once(made), options).select(*columns).collect()))
    assert got == want and len(got) > 50
    assert spark.read.parquet(kept).count() == stream.once(made).count() <= rows
    across = stream.rest(spark, kept, audit.Options())
    assert {"links", "duplicates", "content", "hreflang"} <= {r.analyzer for r in across.select("analyzer").distinct().collect()} and across.where("analyzer = 'seo'").isEmpty()
    late = made.limit(1).withColumns({"fetched_at": F.expr("timestamp'2023-01-01 00:00:00'"), "final_url": F.lit("https://late.example/"), "requested_url": F.lit("https://late.example/")})
    late.coalesce(1).write.mode("append").parquet(source)
    stream.start(spark.readStream.schema(made.schema).parquet(source), out, state, options, stored=kept).awaitTermination()
    assert spark.read.parquet(kept).where("final_url like '%late%'").isEmpty()  # beyond the watermark
    with pytest.raises(ValueError, match="links"):
        stream.start(spark.readStream.schema(made.schema).parquet(source), out, state, audit.Options(enabled=["links", "seo"]))


def test_rotation(spark):
    urls = spark.createDataFrame([(0, "https://a/1"), (1, "https://b/1"), (2, "https://a/2")], "rank int, url string")
    assert [r.agent for r in crawl.rotated(urls, ["x", "y"]).orderBy("rank").collect()] == ["x", "y", "x"]
    sticky = {r.url: r.agent for r in crawl.rotated(urls, ["x", "y", "z"], "sticky-host").collect()}
    assert sticky["https://a/1"] == sticky["https://a/2"]


def test_known_keys_are_not_shuffled(spark):
    """A crawl of 20 waves; what is new meets the known keys where they lie."""
    responses = spark.createDataFrame([(f"http://h/{i}", f"http://h/{i}", 200) for i in range(20)], "url string, final_url string, status_code int")
    back = [(f"http://h/{i}", j, f"http://h/{j}", False) for i in range(20) for j in (0, i - 1, i, i + 1) if 0 <= j < 20]
    links = spark.createDataFrame(back, "page_url string, pos int, url string, nofollow boolean")
    pages, left, coverage = crawl.crawl("http://h/0", responses, links, crawl.Limits(max_pages=0))
    assert sorted((r.depth, r.url) for r in pages.collect()) == [(i, f"http://h/{i}") for i in range(20)] and coverage["complete"]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        known = crawl.Keys(crawl.Store(spark), "known")
        for i in range(3):
            known.add(spark.range(100 * i, 100 * i + 50).select(F.concat(F.lit("k"), "id").alias("key")))
        new = spark.range(0, 300, 1, 3).select(F.concat(F.lit("k"), F.col("id")).alias("key"), "id").groupBy("key").agg(F.min("id").alias("id"))
        found = known.without(new)
        assert sorted(r.id for r in found.collect()) == [i for i in range(300) if i % 100 >= 50]
        assert found._jdf.queryExecution().sparkPlan().toString() and found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") == 1
        known.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_pages_of_one_row_group_are_dealt(spark, tmp_path):
    """A file is split by bytes, but a row group is read by one task: its pages go to all cores nevertheless."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from sitewarden.plans import audit

    pages = {"page_id": range(2000), "url": [f"https://example.org/{i}" for i in range(2000)], "html": [f"<p>{i * i * 7919:>900}</p>" for i in range(2000)]}
    pq.write_table(pa.table({k: list(v) for k, v in pages.items()}), tmp_path / "pages.parquet", compression="none", use_dictionary=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        table = spark.read.parquet(str(tmp_path / "pages.parquet"))
        cores = spark.sparkContext.defaultParallelism
        assert table.rdd.getNumPartitions() >= cores
        dealt = audit.spread(table).rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(dealt) == 2000 and max(dealt) < 2000 / cores * 2
