"""A crawl of a local server: waves, robots, sitemaps, pace, limits, interrupts and the command line."""

import gzip
import io
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sitewarden.__main__ import main
from sitewarden.plans import audit, config, crawl, live, report
from sitewarden.sources.fetch import Fetch, Pace, Paced, ask, retry_after
from sitewarden.streaming import throttle


def page(title, *links, more=""):
    return f"<html lang=en><head><title>{title}</title>{more}</head><body><h1>{title}</h1>" + "".join(f"<a href='{to}'>{to}</a>" for to in links) + "</body></html>"


@pytest.fixture
def site():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, time.monotonic()))
            base = f"http://{self.headers['Host']}"
            pages = {
                "/": page("The start page", "/a", "/b", "/old", "/private/x", "/gone", "mailto:x@y", "http://elsewhere.example/", "/a#part"),
                "/a": page("The first page", "/c", "/"),
                "/b": page("The second page", "/c", "/d"),
                "/c": page("The third page", "/e"),
                "/d": page("The fourth page"),
                "/e": page("The fifth page"),
                "/new": page("Where the old one went"),
                "/private/x": page("Not to be seen"),
                "/robots.txt": f"User-agent: *\nDisallow: /private\nSitemap: {base}/map.xml\n",
                "/map.xml": f"<sitemapindex><sitemap><loc>{base}/one.xml.gz</loc></sitemap></sitemapindex>",
                "/llms.txt": "# Notes for models",
            }
            packed = gzip.compress(f"<urlset><url><loc>{base}/a</loc></url><url><loc>{base}/unlinked</loc></url></urlset>".encode())
            body = packed if self.path == "/one.xml.gz" else pages.get(self.path, "lost").encode()
            found = self.path in pages or self.path == "/one.xml.gz"
            self.send_response(301 if self.path == "/old" else 200 if found else 404)
            if self.path == "/old":
                self.send_header("Location", "/new")
            self.send_header("Content-Type", "text/plain" if ".txt" in self.path else "text/xml" if ".xml" in self.path else "text/html")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def paths(frame, base, column="requested_url"):
    return {r[column].removeprefix(base) for r in frame.collect()}


def test_whole_site(spark, site):
    base, asked = site
    made = live.crawl_site(spark, config.Config(seed=f"{base}/", max_pages=0, timeout=5))
    rows = {r.requested_url.removeprefix(base): r for r in made.pages.collect()}
    assert set(rows) == {"/", "/a", "/b", "/old", "/gone", "/c", "/d", "/e"}
    assert {p: r.depth for p, r in rows.items()} == {"/": 0, "/a": 1, "/b": 1, "/old": 1, "/gone": 1, "/c": 2, "/d": 2, "/e": 3}
    assert rows["/old"].final_url == f"{base}/new" and rows["/gone"].status_code == 404 and rows["/e"].referrer == f"{base}/c"
    assert sorted(r.page_seq for r in rows.values()) == list(range(1, 9))
    assert made.coverage["complete"] and made.left.isEmpty()
    times = [p for p, _ in asked]
    assert times.count("/robots.txt") == 1 and times.count("/c") == 1 and "/private/x" not in times
    found = {(r.code, r.url.removeprefix(base)): r.data for r in audit.audit(made.pages, made.options).collect()}
    assert ("geo-llms-txt", "/llms.txt") in found and ("robots-sitemaps-declared", f"host {base[7:]}") in found
    covered = json.loads(found["sitemap-coverage", "/"])
    assert (covered["sitemap_urls"], covered["in_sitemap_not_crawled"]) == (2, 1)
    assert ("link-broken", "/") in found and ("http-redirect", "/old") in found


def test_limits(spark, site):
    base, _ = site
    made = live.crawl_site(spark, config.Config(seed=f"{base}/", max_pages=3, robots=False, analyzers=["seo"]))
    assert paths(made.pages, base) == {"/", "/a", "/b"} and made.coverage["page_limit"] and not made.coverage["complete"]
    made = live.crawl_site(spark, config.Config(seed=f"{base}/", max_depth=1, exclude=["/old"], analyzers=["seo"]))
    assert paths(made.pages, base) == {"/", "/a", "/b", "/gone"} and made.coverage["depth_limit"]
    assert {r.key.removeprefix(base) for r in made.left.collect()} == {"/c", "/d"}


def test_interrupted_crawl_keeps_what_it_has(spark, site):
    base, _ = site
    made = live.crawl_site(spark, config.Config(seed=f"{base}/", analyzers=["seo"]), stop=lambda: True)
    assert paths(made.pages, base) == {"/"} and made.coverage["interrupted"] and made.coverage["not_crawled"] == 4


def test_pace(site):
    base, asked = site
    get = Paced(Fetch(rate=20))
    for _ in range(5):
        get(f"{base}/d")
    gaps = [b - a for (_, a), (_, b) in zip(asked, asked[1:])]
    assert len(gaps) == 4 and min(gaps) > 0.04
    pace = Pace(0, 300)
    assert pace.wait(10) == 0 and pace.wait(10) == 0
    pace.seen(429, None, 10)
    assert pace.rate == 1 and pace.wait(10) == 1 and pace.wait(10) == 2
    pace.seen(429, None, 11)  # within two seconds of the last
    assert pace.rate == 1
    pace.seen(503, "20", 13)
    assert pace.rate == 1 / 20 and pace.wait(13) == 20
    assert retry_after("Wed, 21 Oct 2015 07:28:00 GMT", 1445412450.0) == 30 and retry_after("soon") == retry_after(None) == 0


def test_commands(spark, site, tmp_path, capsys):
    base, _ = site
    out, store, pages = (str(tmp_path / n) for n in ("r.json", "store", "pages"))
    assert main(["init", str(tmp_path / "c.yaml")]) == 0
    assert config.load(str(tmp_path / "c.yaml"), {}) == config.Config()
    (tmp_path / "c.yaml").write_text("max_pages: 4\nskip: [geo]\n")
    given = ["crawl", f"{base}/", "--config", str(tmp_path / "c.yaml"), "--out", out, "--store", store, "--pages", pages, "--only", "seo", "links", "robots"]
    assert main([*given, "--time", "20240101T000000Z"]) == 0
    assert "4 pages" in capsys.readouterr().err
    made = json.load(open(out))
    assert made["coverage"]["page_limit"] and made["notes"] == ["page limit reached, 3 URLs left"] and made["pages_crawled"] == 4
    assert made["site_map"][0]["prefix"] == "/" and made["site_map"][-1]["prefix"] is None
    assert sum(len(n["issues"]) for n in made["site_map"]) == len(made["issues"]) == made["site_map"][0]["subtotal"]["error"] + sum(
        made["site_map"][0]["subtotal"][s] for s in ("warning", "info")
    ) + len(made["site_map"][-1]["issues"])
    assert set(made["explanations"]["seo-missing-canonical"]) == {"what", "impact", "fix"}
    assert main(["render", out, str(tmp_path / "r.html")]) == 0
    html = (tmp_path / "r.html").read_text()
    assert "page limit reached" in html and "Site map" in html and "The first page" in html
    assert spark.read.parquet(pages).count() == 4
    assert main([*given, "--max-pages", "0", "--time", "20240201T000000Z"]) == 0
    capsys.readouterr()
    host = base.removeprefix("http://")
    assert main(["compare", store, f"{host}/20240101T000000Z", f"{host}/20240201T000000Z", "--format", "json", "--fail-on-new"]) == 1
    diff = json.loads(capsys.readouterr().out)
    assert diff["counts"]["new"] > 0 and diff["new"] and "severity:info" in diff["summary_delta"]


@pytest.fixture
def serve():
    """Servers made of a function: path and headers in, status, headers and body out; and what they were asked."""
    running = []

    def start(answer):
        asked = []

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                asked.append((self.path, time.time(), dict(self.headers)))
                status, headers, body = answer(self.path)
                self.send_response(status)
                for k, v in ({"Content-Type": "text/html"} | headers).items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        running.append(server)
        return server.server_port, asked

    yield start
    for server in running:
        server.shutdown()


def test_redirects_stay_in_scope(spark, serve):
    """A hop that leaves the host, is excluded, or is closed to robots is refused before it is asked; the chain up to there is kept."""
    away, foreign = serve(lambda path: (200, {}, page("Elsewhere")))

    def answer(path):
        to = {"/out": f"http://localhost:{away}/x", "/hop": "/hop2", "/hop2": "/end", "/shut": "/private", "/cut": "/no/way", "/round": "/round", "/bare": "", "/odd": "ftp://x/"}.get(path)
        if to is not None:
            return 302, {"Location": to} if to else {}, ""
        if path == "/robots.txt":
            return 200, {"Content-Type": "text/plain"}, "User-agent: *\nDisallow: /private\n"
        return 200, {}, page("The start page", "/out", "/hop", "/shut", "/cut", "/round", "/bare", "/odd") if path == "/" else page("An end")

    port, asked = serve(answer)
    base = f"http://127.0.0.1:{port}"
    made = live.crawl_site(spark, config.Config(seed=f"{base}/", exclude=["/no/"], max_redirects=3, analyzers=["seo"]))
    rows = {r.requested_url.removeprefix(base): r for r in made.pages.collect()}
    hops = lambda p: [(h["from"].removeprefix(base), h["to"].removeprefix(base), h["status"]) for h in rows[p].redirects]
    assert not foreign and not {"/private", "/no/way"} & {p for p, _, _ in asked}
    for path, to in (("/out", f"http://localhost:{away}/x"), ("/shut", "/private"), ("/cut", "/no/way")):
        assert rows[path].status_code == 0 and rows[path].err and rows[path].final_url == base + path and hops(path) == [(path, to, 302)]
    assert rows["/hop"].status_code == 200 and rows["/hop"].final_url == f"{base}/end" and hops("/hop") == [("/hop", "/hop2", 302), ("/hop2", "/end", 302)]
    assert rows["/round"].err == "too many redirects" and len(hops("/round")) == 4
    assert (rows["/bare"].status_code, rows["/odd"].status_code) == (302, 0) and rows["/bare"].err and rows["/odd"].err
    open_ = live.crawl_site(spark, config.Config(seed=f"{base}/", max_pages=2, follow_external=True, robots=False, analyzers=["seo"]))
    assert {r.final_url for r in open_.pages.where("requested_url like '%/out'").collect()} == {f"http://localhost:{away}/x"} and foreign


def test_one_limiter_for_all_waves(spark, serve):
    """After a 429 every later request of the host keeps its distance, whatever task or wave it belongs to."""
    links = {"/": ("/a", "/b"), "/a": ("/c", "/d", "/e")}
    port, asked = serve(lambda path: (429 if path == "/b" else 200, {}, page(f"Page {path}", *links.get(path, ()))))
    live.crawl_site(spark, config.Config(seed=f"http://127.0.0.1:{port}/", robots=False, analyzers=["seo"], concurrency=4))
    at = {p: t for p, t, _ in asked}
    late = sorted(at[p] for p in ("/c", "/d", "/e"))
    assert late[0] - at["/b"] >= 0.99 and min(b - a for a, b in zip(late, late[1:])) >= 0.95


def test_limiter_table(spark):
    """The state after a wave is what one limiter has that sees the same answers; requests are a rate apart."""
    answers = [("a", 10.0, 1, 9.5, 200, 0.0), ("a", 11.0, 2, 10.5, 429, 0.0), ("a", 12.0, 3, 11.5, 503, 0.0), ("a", 14.0, 4, 13.5, 503, 7.0), ("b", 10.0, 5, 9.9, 200, 0.0), ("c", 10.0, 6, 9.0, 429, 9999.0)]
    rows = spark.createDataFrame(answers, "host string, at double, seq long, sent_at double, status_code int, retry_after double")
    state = spark.createDataFrame([("b", 4.0, None, 0.0), ("d", 1.0, 3.0, 99.0)], throttle.STATE)
    after = throttle.carried(state, rows)
    got = {r.host: (r.rate, r.last, r.free) for r in after.collect()}
    pace = Pace(0, 300, free=0)
    for _, at, _, sent, status, retry in answers[:4]:
        pace.wait(sent)
        pace.seen(status, str(retry), at)
    assert got["a"] == (pace.rate, pace.last, 21.0) and pace.rate == 1 / 7
    assert got["b"] == (4.0, -1e18, 9.9 + 0.25) and got["c"] == (1 / 300, 10.0, 310.0) and got["d"] == (1.0, 3.0, 99.0)
    asked = spark.createDataFrame([("a", i) for i in range(4)] + [("new", 9), ("d", 1)], "host string, rank long")
    times = {(r.host, r.rank): r.send_at for r in throttle.schedule(asked, after, 20.0).collect()}
    assert [times["a", i] for i in range(4)] == [21.0 + 7 * i for i in range(4)] and times["new", 9] == 20.0 and times["d", 1] == 99.0


def test_agents_and_proxies_rotate(spark, serve):
    links = {"/": ("/a", "/b", "/c")}
    port, asked = serve(lambda path: (200, {}, page(f"Page {path}", *links.get(path, ()))))
    via, proxied = serve(lambda path: (200, {}, page("By proxy")))
    seed = f"http://127.0.0.1:{port}/"
    agents = lambda: [h["User-Agent"] for p, _, h in asked if not p.endswith(".txt")]
    live.crawl_site(spark, config.Config(seed=seed, robots=False, analyzers=["seo"], user_agents=["one", "two"]))
    assert sorted(agents()) == ["one", "one", "two", "two"]
    asked.clear()
    live.crawl_site(spark, config.Config(seed=seed, robots=False, analyzers=["seo"], user_agents=["one", "two"], rotation="sticky-host"))
    assert len(set(agents())) == 1 and len(agents()) == 4
    asked.clear()
    live.crawl_site(spark, config.Config(seed=seed, robots=False, analyzers=["seo"], proxies=[f"http://me:pa%20ss@127.0.0.1:{via}"]))
    assert [p for p, _, _ in proxied] == [seed] and not [p for p, _, _ in asked if not p.endswith(".txt")]
    assert proxied[0][2]["Proxy-Authorization"] == "Basic bWU6cGEgc3M=" and ask("https://127.0.0.1:1/", Fetch(timeout=1), True, None, f"http://127.0.0.1:{via}")["err"]
    with pytest.raises(ValueError):
        config.Config(proxies=["socks5://x"])
    assert crawl.rotated(spark.range(3).selectExpr("id AS rank", "'http://h/' AS url"), []).where("agent IS NULL").count() == 3


def test_redirect_rules_of_a_live_site(spark, serve, tmp_path):
    """Sources and targets are fetched and the sitemap is looked for; without one nothing is judged."""
    base = ""

    def answer(path):
        if path in ("/old", "/far"):
            return 301, {"Location": "/new" if path == "/old" else "/other"}, ""
        if path == "/sitemap.xml":
            return 200, {"Content-Type": "text/xml"}, f"<urlset><url><loc>{base}/new</loc></url></urlset>"
        return (200, {}, page("Here")) if path in ("/new", "/other", "/live") else (404, {}, "lost")

    port, asked = serve(answer)
    base = f"http://127.0.0.1:{port}"
    names = ["Original URL", "Redirect to", "Redirect type", "Redirect style", "Priority", "Match query strings", "Ignore trailing slash", "Ignore protocol", "Disable if page exists", "Note"]
    rules = tmp_path / "rules.csv"
    rules.write_text("\n".join([",".join(names), *(f"{a},{b},301,,,,,,{off}," for a, b, off in (("/old", "/new", ""), ("/far", "/new", ""), ("/live", "/new", "TRUE"), ("/gone", "/lost", ""), ("/x", "https://other.example/", "")))]))
    out = str(tmp_path / "checked")
    assert main(["check-redirects", str(rules), base, out]) == 0
    got = {r["Original URL"]: (r.scope, r.verdict, r.source_status, r.target_in_sitemap) for r in spark.read.csv(out, header=True).collect()}
    assert got == {"/old": ("in-scope", "ok", "200", "TRUE"), "/far": ("in-scope", "error", "200", "TRUE"), "/live": ("in-scope", "warning", "200", "TRUE"), "/gone": ("in-scope", "error", "404", "FALSE"), "/x": ("external", None, None, "FALSE")}
    assert len([p for p, _, _ in asked if p == "/new"]) == 2  # as a target, and behind a redirect
    with pytest.raises(LookupError, match="nowhere"):
        main(["check-redirects", str(rules), base, out, "--sitemap-url", f"{base}/nowhere.xml"])


def test_reports_by_path_and_by_stream(spark, site, tmp_path):
    """A report copied by the file system is the one that is streamed; it can be rendered, and read back in place of a stored crawl."""
    base, _ = site
    made = live.crawl_site(spark, config.Config(seed=f"{base}/", analyzers=["seo", "links", "robots"]))
    issues = crawl.Store(spark).keep(audit.audit(made.pages, made.options), "issues")
    path, streamed = str(tmp_path / "r.json"), io.StringIO()
    report.write_json(path, issues, made.pages, base, made.coverage)
    report.write_json(streamed, issues, made.pages, base, made.coverage)
    assert open(path).read() == streamed.getvalue()
    document = json.loads(streamed.getvalue())
    assert len(document["issues"]) == issues.count() and document["issues"][0]["severity"] == "error" and all(isinstance(i["data"], (dict, type(None))) for i in document["issues"])
    nodes = {n["prefix"]: n for n in document["site_map"]}
    assert list(nodes)[0] == "/" and list(nodes)[-1] is None and {n.get("status") for n in document["site_map"][:-1]} == {"ok"}
    assert all(n["counts"] == {s: sum(i["severity"] == s for i in n["issues"]) for s in report.SEVERITIES} for n in document["site_map"][:-1])
    page_ = io.StringIO()
    report.write_html(page_, open(path))
    assert "<tr class=error>" in page_.getvalue() and "<tr class=ok>" in page_.getvalue() and page_.getvalue().count("<tr class=") >= issues.count()
    key = lambda frame: sorted((r.analyzer, r.code, r.url, r.severity, r.message) for r in frame.collect())
    again = report.stored(spark, str(tmp_path / "no-store"), path)
    assert key(again) == key(issues) and {json.dumps(json.loads(r.data)) for r in again.where("data IS NOT NULL").collect()} == {json.dumps(json.loads(r.data)) for r in issues.where("data IS NOT NULL").collect()}
