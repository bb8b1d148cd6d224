"""One pass over a page's HTML into the typed features every rule reads.

Spark has no HTML parser, so this is the one place where pages are handled in
Python: batches come and go as Arrow, one page is parsed once, and everything
after is column expressions. The tree builder on the standard library's
tokenizer knows implied ``html``, ``head`` and ``body``, void and raw-text
elements and optional end tags; misnested formatting is kept as it nests, which
leaves text the same. A page that isn't HTML has null features.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from ..functions.text import INTERROGATIVES, collapse_py, fields
from . import schema
from .spans import Spans

_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_WALLS = (*sorted(_BLOCKS), "li", "dt", "dd", "td", "th", "caption", "button", "object", "svg", "template")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

#: What a schema.org type needs at least.
REQUIRED = {
    "Product": ["name"],
    "Offer": ["price"],
    "Article": ["headline"],
    "NewsArticle": ["headline"],
    "BlogPosting": ["headline"],
    "Recipe": ["name"],
    "Event": ["name", "startDate"],
    "Organization": ["name"],
    "LocalBusiness": ["name"],
    "Person": ["name"],
    "BreadcrumbList": ["itemListElement"],
    "FAQPage": ["mainEntity"],
    "VideoObject": ["name", "thumbnailUrl"],
}
#: Patterns of prices, purchase prompts and leaked template markup.
PRICE = re.compile(r"[$€£¥]\s?\d[\d,.]*\d|\b\d[\d,.]*\d\s?(?:USD|EUR|GBP)\b", re.ASCII)
CART = re.compile(r"(?i)add.?to.?cart|buy now|add.?to.?bag|add.?to.?basket")
LEAKS = (re.compile(r"(?i)\[acf[_\s\]]", re.ASCII), re.compile(r"(?i)\b(?:the|get)(?:_sub)?_field\s*\(", re.ASCII))
_LOADS = {"stylesheet", "icon", "shortcut icon", "preload", "modulepreload", "prefetch", "manifest", "apple-touch-icon"}


#: So many pages are objects at once.
CHUNK = 32


class Node:
    """An element; ``begin`` and ``end`` bound its text in the document's, ``first`` and ``stop`` its own place and its last descendant's."""

    __slots__ = ("tag", "attrs", "children", "parent", "begin", "end", "first", "stop")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []


class Document:
    """A tree in order of its elements: texts are slices of one text, descendants are stretches of one list."""

    def __init__(self, root: Node):
        self.root, self.nodes, self.by = root, [], {}
        texts, at, stack = [], 0, [root]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                texts.append(x)
                at += len(x)
            elif isinstance(x, tuple):
                x[0].end, x[0].stop = at, len(self.nodes)
            else:
                x.begin, x.first = at, len(self.nodes)
                self.nodes.append(x)
                self.by.setdefault(x.tag, []).append(x)
                stack.append((x,))
                stack += reversed(x.children)
        self.flat = "".join(texts)
        self.spans = Spans(self.flat)

    def get(self, *tags: str) -> list[Node]:
        """All elements with one of the tags, in order."""
        return self.by.get(tags[0], []) if len(tags) == 1 else sorted((n for t in tags for n in self.by.get(t, [])), key=lambda n: n.first)

    def text(self, node: Node) -> str:
        return self.flat[node.begin : node.end]

    def prose(self) -> list[tuple[int, int]]:
        """Where the texts of paragraphs and list items are, in order; they may overlap."""
        return [(n.begin, n.end) for n in self.get("p", "li")]

    def within(self, node: Node, *tags: str) -> list[Node]:
        """The descendants with one of the tags, in order."""
        place = lambda n: n.first
        found = []
        for tag in tags:
            every = self.by.get(tag, [])
            found += every[bisect_left(every, node.first + 1, key=place) : bisect_left(every, node.stop, key=place)]
        return found if len(tags) == 1 else sorted(found, key=place)

    def release(self) -> None:
        """Elements let go of their parents, so that the tree goes at once and not when the collector comes to it."""
        for n in self.nodes:
            n.parent = None

    def text_without(self, node: Node, without: frozenset) -> str:
        out, at = [], node.begin
        for n in self.get(*without):
            if node.first < n.first < node.stop and n.begin >= at:
                out.append(self.flat[at : n.begin])
                at = n.end
        return "".join([*out, self.flat[at : node.end]])


class _Builder(HTMLParser):
    """Open elements are a path; of each tag it knows which are open, so no ancestors are searched."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.head, self.body = Node("head", {}, self.root), Node("body", {}, self.root)
        self.root.children = [self.head, self.body]
        self.base, self.early = self.head, True
        self.path: list[Node] = []
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # tag -> places in the path

    @property
    def at(self) -> Node:
        return self.path[-1] if self.path else self.base

    def _cut(self, place: int) -> None:
        while len(self.path) > place:
            self.open[self.path.pop().tag].pop()

    @property
    def wall(self) -> int:
        """The place of the innermost open element that isn't formatting."""
        return max((self.open[t][-1] for t in _WALLS if self.open[t]), default=-1)

    def _to_body(self) -> None:
        if self.early:
            self._cut(0)
            self.base, self.early = self.body, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named: dict = {}
        for k, v in attrs:
            named.setdefault(k, v or "")
        if tag in ("html", "body"):
            own = self.root if tag == "html" else self.body
            own.attrs = named | own.attrs
            if tag == "body":
                self._to_body()
            return
        if tag == "head":
            return
        if self.early and not self.path and tag not in _HEAD:
            self._to_body()
        if tag in _BLOCKS:
            self._close({"p"}, {"button", "table", "td", "th"})
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _FENCES[tag])
        if tag in _HEADINGS and self.path and self.path[-1].tag in _HEADINGS:
            self._cut(len(self.path) - 1)
        if tag == "a" and self.open["a"] and self.open["a"][-1] > self.wall:
            self._cut(self.open["a"][-1])  # a link ends where the next begins, if only formatting is open between them
        node = Node(tag, named, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.open[tag].append(len(self.path))
            self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def _close(self, tags: set, fences: set) -> None:
        innermost = lambda names: max((self.open[n][-1] for n in names if self.open[n]), default=-1)
        if (place := innermost(tags)) > innermost(fences):
            self._cut(place)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            if self.early:
                self._to_body()
        elif self.open[tag]:
            self._cut(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.early and not self.path:
            if not data.strip():
                return
            self._to_body()
        self.at.children.append(data)


def parse(html: str) -> Document:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return Document(builder.root)


def _port(scheme: str, netloc: str) -> str:
    return netloc.removesuffix({"http": ":80", "https": ":443"}.get(scheme, "\0"))


def canonical(url: str, keep: bool, strip_query: bool = False) -> str:
    """The index key of an absolute URL in Python, for links resolved while parsing."""
    p = urlsplit(url)
    netloc = _port(p.scheme, p.netloc.rpartition("@")[2].lower())
    path = p.path
    if not keep and len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    return urlunsplit((p.scheme.lower(), netloc, path or "/", "" if strip_query else p.query, ""))


def resolve(base: str, href: str) -> str | None:
    """An absolute http(s) URL, or none for fragments, other schemes and broken references."""
    href = href.strip()
    if not href or href.startswith("#"):
        return None
    try:
        url = urljoin(base, href)
        ok = urlsplit(url).scheme in ("http", "https") and bool(urlsplit(url).netloc)
    except ValueError:
        return None
    return url if ok else None


def _host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def _strings(v) -> list[str]:
    return [v] if isinstance(v, str) else [x for x in v if isinstance(x, str)] if isinstance(v, list) else []


def _empty(v) -> bool:
    return v is None or (isinstance(v, str) and not v.strip()) or (isinstance(v, (list, dict)) and not v)


def _objects(v, inner: tuple[str, ...]) -> list[dict]:
    """The objects of a JSON value, outer ones first: itself, those of its lists, and what it holds under ``inner``."""
    out, stack = [], [v]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            out.append(x)
            stack += [x[k] for k in reversed(inner) if k in x]
        elif isinstance(x, list):
            stack += reversed(x)
    return out


def _question(text: str) -> bool:
    text = text.strip()
    if text.endswith("?"):
        return True
    first = fields(text.lower())[:1]
    return bool(first) and first[0].strip(",.:;\"'") in INTERROGATIVES


def _distinct(items: list) -> list:
    return list(dict.fromkeys(items))


def _snippet(text: str) -> str:
    for pattern in LEAKS:
        if m := pattern.search(text):
            at = len(text[: m.start()].encode())
            raw = text.encode()
            return collapse_py(raw[max(0, at - 20) : at + 60].decode("utf-8", "ignore"))
    return ""


def extract(html: str, url: str) -> dict:
    """The features of one page."""
    page = parse(html)
    root, nodes, get, text_of, within = page.root, page.nodes, page.get, page.text, page.within
    head, body = root.children[0], root.children[1]
    in_head = lambda n: head.first <= n.first < head.stop
    titles = [text_of(n) for n in get("title") if in_head(n)]
    f: dict = {
        "title_head_first": titles[0] if titles else "",
        "title_head_all": "".join(titles),
        "title_any_first": text_of(get("title")[0]) if get("title") else "",
        "html_lang": root.attrs.get("lang", ""),
        "html_amp": "amp" in root.attrs or "⚡" in root.attrs,
    }
    f["metas"] = [
        {"name": n.attrs.get("name"), "property": n.attrs.get("property"), "http_equiv": n.attrs.get("http-equiv"), "charset": "charset" in n.attrs, "content": n.attrs.get("content"), "in_head": in_head(n)}
        for n in get("meta")
    ]
    f["links"] = [{"rel": n.attrs.get("rel"), "href": n.attrs.get("href"), "hreflang": n.attrs.get("hreflang"), "in_head": in_head(n)} for n in get("link")]
    heads = get(*_HEADINGS)
    f["headings"] = [
        {"level": int(n.tag[1]), "text": text_of(n), "labelled": bool(n.attrs.get("aria-label", "").strip()) or any(i.attrs.get("alt", "").strip() for i in within(n, "img"))}
        for n in heads
    ]
    questions, places = [], {}
    for n in heads:
        if n.tag in ("h2", "h3") and _question(text_of(n)):
            siblings = n.parent.children
            if n.parent.first not in places:  # where each child is, worked out once for a parent
                places[n.parent.first] = {id(s): i for i, s in enumerate(siblings)}
            answer = 0
            for i in range(places[n.parent.first][id(n)] + 1, len(siblings)):
                if isinstance(s := siblings[i], Node):
                    if s.tag in _HEADINGS:
                        break
                    answer += page.spans.words(s.begin, s.end)
            questions.append({"text": collapse_py(text_of(n)), "answer_words": answer})
    f["questions"] = questions
    base = next((resolve(url, n.attrs["href"]) for n in get("base") if n.attrs.get("href")), None) or url
    seen, anchors, own = set(), [], _host(url)
    for n in get("a"):
        if (to := resolve(base, n.attrs.get("href", ""))) and (key := canonical(to, False)) not in seen:
            seen.add(key)
            rel = n.attrs.get("rel", "")
            anchors.append({"url": key, "resolved": canonical(to, True), "href": n.attrs["href"], "anchor": text_of(n).strip(), "rel": rel, "nofollow": "nofollow" in rel, "external": _host(to) != own})
    f["anchors"] = anchors
    f["imgs"] = [{"src": n.attrs.get("src", ""), "alt": "alt" in n.attrs, "width": "width" in n.attrs, "height": "height" in n.attrs} for n in get("img")]
    f["script_srcs"] = [n.attrs["src"] for n in get("script") if "src" in n.attrs]
    f["inline_scripts"] = [text_of(n) for n in get("script") if "src" not in n.attrs]
    f["head_scripts"] = [f"{text_of(n)} {n.attrs.get('src', '')}" for n in get("script") if in_head(n)]
    f["noscripts"] = [text_of(n) + "".join(" " + i.attrs.get("src", "") for i in within(n, "iframe", "img")) for n in get("noscript")]
    sources = [n.attrs["src"] for n in nodes if n.tag in ("img", "script", "iframe", "source", "video", "audio", "embed") and n.attrs.get("src")]
    loads = [n.attrs["href"] for n in get("link") if n.attrs.get("href") and n.attrs.get("rel", "").lower().strip() in _LOADS]
    f["subresources"] = sources + loads + [n.attrs["data"] for n in get("object") if n.attrs.get("data")]
    f["form_actions"] = [n.attrs["action"] for n in get("form") if "action" in n.attrs]
    f["iframe_srcs"] = [n.attrs.get("src", "") for n in get("iframe")]
    video = get("video")[0] if get("video") else None
    f["video_src"] = (video.attrs.get("src") or next((s.attrs["src"] for s in within(video, "source") if s.attrs.get("src")), None) or "video") if video else None
    text = text_of(body)
    flat = collapse_py(text)
    f["body_words"] = len(fields(text))
    f["body_bytes"] = len(text.strip().encode())
    f["content_hash"] = hashlib.md5(flat.lower().encode()).hexdigest() if flat else None
    f["acf_snippet"] = _snippet(page.text_without(body, frozenset(("script", "style", "code", "pre", "textarea"))))
    price = PRICE.search(text)
    f["price"], f["has_cart"] = price.group() if price else None, bool(CART.search(text))
    f["microdata"] = any(n.attrs.get("itemprop") == "price" or re.search("schema.org/(Product|Offer)", n.attrs.get("itemtype", "")) for n in nodes)
    f["prose_words"], f["data_points"] = page.spans.joined_words(page.prose()), page.spans.joined_points(page.prose())
    mains = get("main", "article")
    first = mains[0] if mains else None
    f["main_count"], f["article_count"] = len(mains), len(get("article"))
    f["article_words"] = len(fields(text_of(get("article")[0]))) if get("article") else 0
    f["main_words"] = len(fields(text_of(first))) if first else 0
    f["main_has_list"] = bool(first) and bool(within(first, "ol", "ul", "table", "dl"))
    lead = next(iter(within(first or body, "p") or within(body, "p")), None)
    f["lead_words"] = len(fields(text_of(lead))) if lead else 0
    meta = {n.attrs.get("property") for n in get("meta")}
    f["has_author_mark"] = any(n.attrs.get("rel") == "author" or n.attrs.get("itemprop") == "author" for n in nodes) or "article:author" in meta
    f["has_date_mark"] = any("datetime" in n.attrs for n in get("time")) or bool(meta & {"article:published_time", "article:modified_time"})
    crumbs = next((n for n in get("nav", "ol", "ul") if "breadcrumb" in (n.attrs.get("class", "") + " " + n.attrs.get("aria-label", "")).lower() and len(within(n, "a")) >= 2), None)
    f["breadcrumb_links"] = len(within(crumbs, "a")) if crumbs else 0
    blocks = [t for n in get("script") if n.attrs.get("type") == "application/ld+json" and (t := text_of(n).strip())]
    values, errors = [], 0
    for raw in blocks:
        try:
            values.append(json.loads(raw))
        except (ValueError, RecursionError):  # nested beyond what a parser follows
            errors += 1
    objects = [o for v in values for o in _objects(v, ("@graph",))]
    deep = [o for v in values for o in _objects(v, ("@graph", "mainEntity"))]
    f["jsonld_blocks"], f["jsonld_errors"] = len(blocks), errors
    f["jsonld_types"] = _distinct([t for o in objects for t in _strings(o.get("@type"))])
    f["answer_types"] = _distinct([t for o in deep for t in _strings(o.get("@type")) if t in ("FAQPage", "QAPage", "HowTo", "Question")])
    editorial = ("Article", "NewsArticle", "BlogPosting", "TechArticle", "ScholarlyArticle", "Report", "Review")
    f["article_types"] = [t for t in f["jsonld_types"] if t in editorial]
    f["jsonld_keys"] = _distinct([k for o in objects for k, v in o.items() if not _empty(v)])
    f["jsonld_missing"] = [
        {"type": t, "missing": lacking}
        for o in objects
        for t in _strings(o.get("@type"))
        if t in REQUIRED and (lacking := [k for k in REQUIRED[t] if _empty(o.get(k))])
    ]
    f["assets"] = "\n".join([n.attrs["src"] for n in nodes if n.tag in ("script", "img") and "src" in n.attrs] + [n.attrs["href"] for n in get("link") if "href" in n.attrs])
    page.release()
    return f


def _raw_prose(html: str) -> int:
    page = parse(html)
    words = page.spans.joined_words(page.prose())
    page.release()
    return words


def in_chunks(rows: Iterator[dict], kind: pa.DataType) -> pa.Array:
    """An array of rows of which few are objects at once: a batch has up to ten thousand, and objects take many times their texts."""
    made = [pa.array([], kind)]
    while some := list(islice(rows, CHUNK)):
        made.append(pa.array(some, kind))
    return pa.concat_arrays(made)


def with_features(pages: DataFrame) -> DataFrame:
    """``pages`` with ``is_html``, ``f`` (features) and ``raw_prose_words``; only what is parsed travels to Python."""
    made = StructType().add("f", StructType.fromDDL(schema.FEATURES)).add("raw_prose_words", IntegerType())
    arrow = pa.struct(list(to_arrow_schema(made)))

    def work(html: pa.Array, url: pa.Array, ok: pa.Array, raw: pa.Array) -> pa.Array:
        rows = (
            {"f": extract(h.as_py() or "", u.as_py() or "") if k.as_py() else None, "raw_prose_words": _raw_prose(r.as_py()) if k.as_py() and r.is_valid and r.as_py() else None}
            for h, u, k, r in zip(html, url, ok, raw, strict=True)
        )
        return in_chunks(rows, arrow)

    # a filter on a feature must not run the parser again below it
    parsed = F.arrow_udf(work, made).asNondeterministic()
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    marked = pages.withColumn("is_html", kind.contains("text/html") | kind.contains("application/xhtml"))
    return marked.withColumn("_made", parsed("html", "final_url", "is_html", "raw_html")).select(*marked.columns, "_made.f", "_made.raw_prose_words")
