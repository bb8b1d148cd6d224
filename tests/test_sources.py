import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from sitewarden.__main__ import main
from sitewarden.plans import config
from sitewarden.sources.fetch import Fetch, decode, fetch, fetch_all, location


@pytest.fixture(scope="module")
def site():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            to = {"/old": "/new", "/round": "/round"}.get(self.path)
            self.send_response(301 if to else 404 if self.path == "/gone" else 200)
            if to:
                self.send_header("Location", to)
            self.send_header("Content-Type", "text/html; charset=iso-8859-1")
            self.end_headers()
            self.wfile.write(b"<title>f\xfcr</title>" + b"x" * 100 + (self.headers.get("Authorization") or "").encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(site):
    page = fetch(f"{site}/old", Fetch())
    assert (page["status_code"], page["final_url"], page["redirects"][0]["status"]) == (200, f"{site}/new", 301)
    assert "für" in page["html"] and not page["truncated"] and page["err"] == ""
    assert fetch(f"{site}/gone", Fetch(max_bytes=10))["truncated"]
    lost = fetch(f"{site}/round", Fetch(max_redirects=3))
    assert lost["err"] == "too many redirects" and lost["status_code"] == 0 and len(lost["redirects"]) == 4
    shut = fetch(f"{site}/old", Fetch(allowed=lambda u: False))
    assert shut["status_code"] == 0 and shut["err"] and len(shut["redirects"]) == 1
    assert fetch("http://127.0.0.1:9/", Fetch(timeout=2))["err"]
    assert "Basic" in fetch(site, Fetch(user="a:b", auth_host="127.0.0.1"))["html"]
    assert "Basic" not in fetch(site, Fetch(user="a:b", auth_host="other"))["html"]


def test_fetch_all(spark, site):
    urls = spark.createDataFrame([(1, f"{site}/"), (2, f"{site}/gone")], "page_seq int, url string")
    assert {r.page_seq: r.status_code for r in fetch_all(urls).collect()} == {1: 200, 2: 404}


def test_decode_and_location():
    assert decode("é".encode(), "") == "é" and decode(b"\xe9", "") == "é"
    assert decode(b'<meta charset="latin1">\xe9', "")[-1] == "é" and decode("é".encode("utf-16"), "") == "é"
    assert decode(b"a", "text/html; charset=nonsense") == "a"
    assert location("http://a/x/", " ../y ") == "http://a/y"
    assert location("http://a/", "ftp://b/") is None and location("http://a/", None) is None


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("max_pages: 7\nexclude: ['/x']\n")
    made = config.load(str(path), {"SITEWARDEN_MAX_PAGES": "9", "SITEWARDEN_STRIP_QUERY": "true"}, seed="u:p@a.example/x")
    assert (made.max_pages, made.strip_query, made.seed, made.basic_auth, made.exclude) == (9, True, "https://a.example/x", "u:p", ["/x"])
    for bad in ({"render": "x"}, {"format": "x"}, {"rotation": "x"}, {"basic_auth": "x"}, {"max_pages": -1}):
        with pytest.raises(ValueError):
            config.load(env={}, **bad)
    path.write_text("nothing: 1\n")
    with pytest.raises(ValueError):
        config.load(str(path), {})


def test_command_line(spark, tmp_path, capsys):
    from sitewarden.plans import fixtures

    assert main(["analyzers"]) == 0 and "seo" in capsys.readouterr().out
    pages, store = str(tmp_path / "p"), str(tmp_path / "s")
    fixtures.pages(spark).where("page_seq < 3").write.parquet(pages)
    base = ["audit", pages, "--only", "images", "--store", store, "--host", "shop.example", "--format", "csv", "--out", str(tmp_path / "o")]
    assert main([*base, "--time", "20240101T000000Z"]) == 0
    assert main([*base, "--skip", "images", "--time", "20240201T000000Z"]) == 0
    assert main(["history", store]) == 0
    assert main(["compare", store, "shop.example/20240101T000000Z", "shop.example/20240101T000000Z", "--fail-on-new"]) == 0


def test_import_needs_no_session():
    import subprocess
    import sys

    from conftest import ROOT

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
