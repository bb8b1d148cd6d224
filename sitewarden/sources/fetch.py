"""Live fetching as a batch function: URLs in, rows of ``schema.PAGES`` out.

``hops`` asks each URL once and gives a redirect back as a row, so that a crawl
can judge where it leads before that is asked; ``fetch_all`` follows redirects
itself, for files that no scope binds. A failure is a row with ``err``, never
an exception. Bodies are cut at a limit, and decoded by header, byte order mark,
meta tag, UTF-8 or windows-1252. A host's requests go through one task, whose
threads share one pace.
"""

from __future__ import annotations

import base64
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from email.utils import parsedate_to_datetime
from http.client import HTTPConnection, HTTPException, HTTPSConnection, IncompleteRead
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..streaming import throttle
from . import schema

#: Statuses that redirect.
REDIRECTS = {301, 302, 303, 307, 308}
TOO_MANY = "too many redirects"


@dataclass(frozen=True)
class Fetch:
    agent: str = "sitewarden"
    timeout: float = 15.0
    max_bytes: int = 5 << 20
    max_redirects: int = 10
    user: str = ""  # name:password, sent to ``auth_host`` only, and never from https to http
    auth_host: str = ""
    rate: float = 0.0  # requests per second and host; 0: as fast as answers come
    adaptive: bool = True  # 429 and 503 slow a host down
    longest_wait: float = 300.0
    allowed: Callable[[str], bool] | None = None  # asked before ``fetch`` follows a redirect; a crawl judges its own


def decode(body: bytes, content_type: str) -> str:
    """Text of a body; what can't be decoded is replaced."""
    named = re.search(r"charset=[\"']?([\w.:-]+)", content_type or "", re.I)
    names = [named[1]] if named else []
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            names.append(name)
    if meta := re.search(rb"<meta[^>]+charset=[\"']?([\w.:-]+)", body[:1024], re.I):
        names.append(meta[1].decode("ascii", "replace"))
    for name in names:
        try:
            return body.decode(name, "replace")
        except LookupError:
            continue
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("windows-1252", "replace")


def location(base: str, value: str | None) -> str | None:
    """Where a redirect leads; http and https only."""
    try:
        to = urljoin(base, (value or "").strip())
        return to if value and urlsplit(to).scheme in ("http", "https") and urlsplit(to).netloc else None
    except ValueError:
        return None


def retry_after(value: str | None, now: float | None = None) -> float:
    """Seconds of a Retry-After header, given as a number or a date; 0 if it says nothing."""
    try:
        return max(0.0, float(value or 0))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return 0.0


class Pace:
    """When the next request to a host may go out: a bucket of one, which 429 and 503 slow down as ``streaming.throttle`` says. Threads may share it."""

    def __init__(self, rate: float, longest: float, last: float = -1e18, free: float = 0.0):
        self.rate, self.longest, self.free, self.last = rate, longest, free, last
        self.lock = threading.Lock()

    def wait(self, now: float, not_before: float = 0.0) -> float:
        """Seconds to wait from now; the request is taken to go out then."""
        with self.lock:
            at = max(now, self.free, not_before)
            self.free = at + (1 / self.rate if self.rate else 0.0)
            return at - now

    def seen(self, status: int, header: str | None, now: float) -> None:
        with self.lock:
            if status not in throttle.STATUSES or now - self.last < throttle.DEBOUNCE:
                return
            held = min(retry_after(header), self.longest)
            self.last, self.rate = now, max(self.rate / 2, throttle.FLOOR) if self.rate else throttle.START
            if held:
                self.rate = min(self.rate, 1 / held)
            self.free = max(self.free, now + max(held, 1 / self.rate))


def _retry(row: dict) -> str | None:
    named = {k.lower(): v for k, v in (row["headers"] or {}).items()}
    return named.get("retry-after", [None])[0]


class Paced:
    """Fetches of one task, each host at its pace."""

    def __init__(self, options: Fetch):
        self.options, self.hosts = options, {}

    def __call__(self, url: str) -> dict:
        host = urlsplit(url).netloc.lower()
        pace = self.hosts.setdefault(host, Pace(self.options.rate, self.options.longest_wait))
        time.sleep(pace.wait(time.time()))
        row = fetch(url, self.options)
        if self.options.adaptive:
            pace.seen(row["status_code"], _retry(row), time.time())
        return row


def _connection(parts, options: Fetch, proxy: str | None):
    """An open link and the target to name on it; plain requests go to a proxy whole, others through a tunnel."""
    kind = HTTPSConnection if parts.scheme == "https" else HTTPConnection
    target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    if not proxy:
        return kind(parts.hostname, parts.port, timeout=options.timeout), target, {}
    via = urlsplit(proxy)
    user = {"Proxy-Authorization": "Basic " + base64.b64encode(unquote(f"{via.username}:{via.password or ''}").encode()).decode()} if via.username else {}
    if parts.scheme == "https":
        link = HTTPSConnection(via.hostname, via.port, timeout=options.timeout)
        link.set_tunnel(parts.hostname, parts.port or 443, headers=user)
        return link, target, {}
    return HTTPConnection(via.hostname, via.port, timeout=options.timeout), f"http://{parts.netloc.rpartition('@')[2]}{target}", user


def ask(at: str, options: Fetch, secure: bool, agent: str | None = None, proxy: str | None = None) -> dict:
    """One request, no redirect followed: a page row with ``body`` and ``to``, where a redirect leads.

    ``secure``: the chain began with https, so no password goes out over http.
    """
    began = time.monotonic()
    row: dict = {"requested_url": at, "final_url": at, "status_code": 0, "headers": None, "content_type": "", "html": "", "body": b"", "redirects": [], "err": "", "truncated": False, "depth": 0, "referrer": "", "to": None}
    try:
        parts = urlsplit(at)
        headers = {"User-Agent": agent or options.agent, "Accept-Encoding": "identity"}
        if options.user and parts.hostname == options.auth_host and not (secure and parts.scheme == "http"):
            headers["Authorization"] = "Basic " + base64.b64encode(options.user.encode()).decode()
        link, target, more = _connection(parts, options, proxy)
        link.request("GET", target, headers=headers | more)
        answer = link.getresponse()
        try:
            body = answer.read(options.max_bytes + 1)
            cut = len(body) > options.max_bytes
        except IncompleteRead as e:
            body, cut = e.partial, True
        link.close()
    except (OSError, HTTPException, ValueError) as e:
        return row | {"err": str(e) or type(e).__name__, "duration_ms": int((time.monotonic() - began) * 1000)}
    named: dict[str, list[str]] = {}
    for k, v in answer.headers.items():
        named.setdefault(k, []).append(v)
    row |= {"status_code": answer.status, "headers": named, "duration_ms": int((time.monotonic() - began) * 1000)}
    if answer.status in REDIRECTS:
        leads = answer.headers.get("Location")
        to = location(at, leads)
        if to:
            return row | {"to": to}
        return row | ({"err": "redirect without a location"} if not leads else {"err": f"invalid redirect target {leads!r}", "status_code": 0})
    kind_of = answer.headers.get("Content-Type", "")
    body = body[: options.max_bytes]
    return row | {"content_type": kind_of, "truncated": cut, "body": body, "html": decode(body, kind_of)}


def fetch(url: str, options: Fetch) -> dict:
    """One URL as a page row, redirects followed, with the bytes of its body beside the text."""
    hops, took, at = [], 0, url
    for _ in range(options.max_redirects + 1):
        row = ask(at, options, url.startswith("https:"))
        took += row["duration_ms"]
        if row["to"] is None:
            break
        hops.append({"from": at, "to": row["to"], "status": row["status_code"]})
        at = row["to"]
        if options.allowed and not options.allowed(at):
            row |= {"err": "redirect leaves the allowed scope", "final_url": at, "status_code": 0, "headers": None}
            break
    else:
        row |= {"err": TOO_MANY, "final_url": at, "status_code": 0, "headers": None}
    return row | {"requested_url": url, "redirects": hops, "duration_ms": took}


#: What ``hops`` gives beside the columns of a page: the rank and place asked for, times, and where a redirect leads.
HOP = "rank long, at string, secure boolean, sent_at double, seen_at double, retry_after double, to string"
PAGE_PARTS = ("status_code", "headers", "content_type", "html", "err", "truncated", "duration_ms")


def hops(requests: DataFrame, options: Fetch, threads: int = 1) -> DataFrame:
    """Every row of ``requests(rank, at, host, secure, agent, proxy, rate, last, free, send_at)`` asked once: ``HOP`` and ``PAGE_PARTS``.

    A host's rows are one partition's, in order of their time; ``threads`` of
    them are on their way at once and share its pace, which starts from the
    limiter's state and is slowed down by what comes back meanwhile.
    """
    pages = StructType.fromDDL(schema.PAGES)
    kind = StructType(StructType.fromDDL(HOP).fields + [pages[name] for name in PAGE_PARTS])
    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paces: dict[str, Pace] = {}
        held = threading.Lock()

        def one(r: dict) -> dict:
            with held:
                pace = paces.setdefault(r["host"], Pace(r["rate"], options.longest_wait, -1e18 if r["last"] is None else r["last"], r["free"] or 0.0))
            time.sleep(pace.wait(time.time(), r["send_at"]))
            sent = time.time()
            row = ask(r["at"], options, r["secure"], r["agent"], r["proxy"])
            seen = time.time()
            header = _retry(row)
            if options.adaptive:
                pace.seen(row["status_code"], header, seen)
            return {"rank": r["rank"], "at": r["at"], "secure": r["secure"], "sent_at": sent, "seen_at": seen, "retry_after": retry_after(header, seen), "to": row["to"]} | {k: row[k] for k in PAGE_PARTS}

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for k in range(0, len(batch), 4 * threads):  # some bodies at a time
                    rows = pool.map(one, batch.slice(k, 4 * threads).to_pylist())
                    yield from pa.Table.from_pylist(list(rows), schema=arrow).combine_chunks().to_batches()

    columns = ["rank", "at", "host", "secure", "agent", "proxy", "rate", "last", "free", "send_at"]
    return requests.select(*columns).repartition("host").sortWithinPartitions("host", "send_at", "rank").mapInArrow(work, kind)


def fetch_all(urls: DataFrame, options: Fetch | None = None) -> DataFrame:
    """``urls(page_seq, url)`` fetched; a host's URLs share one task, and its rate, for politeness."""
    kind = StructType.fromDDL(schema.PAGES)
    return _fetched(urls.select(F.col("page_seq").cast("long").alias("page_seq"), "url"), options or Fetch(), kind, lambda n, row: {"page_seq": n} | row)


def fetch_bodies(urls: DataFrame, options: Fetch | None = None) -> DataFrame:
    """``url, status, truncated, body`` of ``urls(url)``: bytes as they came."""
    kind = StructType.fromDDL("url string, status int, truncated boolean, body binary")
    made = lambda _, row: {"url": row["requested_url"], "status": row["status_code"], "truncated": row["truncated"], "body": row["body"]}
    return _fetched(urls.select(F.lit(0).cast("long").alias("page_seq"), "url"), options or Fetch(), kind, made)


def _fetched(urls: DataFrame, options: Fetch, kind: StructType, made) -> DataFrame:
    from ..functions import urls as U

    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Paced(options)
        for batch in batches:
            for n, u in zip(batch.column("page_seq").to_pylist(), batch.column("url").to_pylist(), strict=True):
                yield from pa.Table.from_pylist([made(n, get(u))], schema=arrow).combine_chunks().to_batches()

    return urls.repartition(U.host(F.col("url"))).mapInArrow(work, kind)
