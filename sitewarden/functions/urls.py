"""URL expressions: the audit's six canonical forms, as native columns.

They are kept apart on purpose; each operator matches on its own form.
``parse_url`` is not used: it rejects or loses what crawled links contain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Host with port, without user information, in lower case."""
    return F.lower(F.regexp_replace(part(url, 2), "^.*@", ""))


def hostname(url: Column) -> Column:
    """Host without port; brackets of IPv6 literals go."""
    h = host(url)
    return F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(h, r":\d*$", ""))


def path(url: Column) -> Column:
    return part(url, 3)


def decoded_path(url: Column) -> Column:
    """The path with escapes decoded; as it is where an escape is broken. A plus sign stays."""
    p = path(url)
    return F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)


def query(url: Column) -> Column:
    return part(url, 4)


def has_query(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "#.*$", "").contains("?")


def _normal(url: Column, keep_slash: bool, strip_query: bool) -> Column:
    s, h, p = scheme(url), host(url), path(url)
    h = F.when(s == "http", F.regexp_replace(h, ":80$", "")).when(s == "https", F.regexp_replace(h, ":443$", "")).otherwise(h)
    if not keep_slash:
        p = F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    p = F.when(p == "", "/").otherwise(p)
    q = F.lit("") if strip_query else F.when(has_query(url), F.concat(F.lit("?"), query(url))).otherwise("")
    return F.when(h == "", F.trim(url)).otherwise(F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), F.lit("//"), h, p, q))


def index_key(url: Column, strip_query: bool = False) -> Column:
    """Scheme and host in lower case, no fragment, user, default port, nor one trailing slash."""
    return _normal(url, False, strip_query)


def keep_slash(url: Column, strip_query: bool = False) -> Column:
    return _normal(url, True, strip_query)


def page_key(url: Column) -> Column:
    """For duplicates: query and fragment go, nothing else."""
    return F.regexp_replace(F.trim(url), r"[?#].*$", "")


def sitemap_key(url: Column) -> Column:
    """For sitemaps: the fragment and all trailing slashes go."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/+$", "")


def landing_key(url: Column) -> Column:
    """For campaigns: host and path without trailing slashes."""
    p = F.regexp_replace(decoded_path(url), "/+$", "")
    return F.concat(host(url), F.when(p == "", "/").otherwise(p))


def rule_key(url: Column) -> Column:
    """For redirect rules: host and path; one slash stays one slash."""
    p = decoded_path(url)
    return F.concat(host(url), F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p))


def query_pairs(url: Column) -> Column:
    """``array<struct<key, value>>``; pairs with a semicolon or a broken escape are dropped."""
    raw = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.contains(";"))
    pairs = F.transform(
        raw,
        lambda p: F.struct(
            F.try_url_decode(F.regexp_replace(p, "=.*$", "")).alias("key"),
            F.try_url_decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value"),
        ),
    )
    return F.filter(pairs, lambda e: e["key"].isNotNull() & e["value"].isNotNull())


def first_value(pairs: Column, key: str) -> Column:
    """The first value of a key, empty if there is none."""
    return F.coalesce(F.get(F.filter(pairs, lambda e: e["key"] == key), 0)["value"], F.lit(""))


_REFERENCE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are carried out: segments go on a stack, ``..`` takes one off, and nothing leaves the root."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    stack = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda held, s: F.when(s == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(s == ".", held).otherwise(F.array_append(held, s)),
    )
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(stack, F.lit(""))).otherwise(stack)
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """A reference taken relative to a base, as RFC 3986 has it in 5.2 (strict)."""
    ref, at = F.trim(reference), F.trim(base)
    own = lambda n: F.regexp_extract(ref, _REFERENCE, n)
    of = lambda n: F.regexp_extract(at, _REFERENCE, n)
    before = lambda c: F.regexp_replace(c, "#.*$", "")
    has_scheme, has_host = own(1) != "", ref.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    host_of_base = at.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    merged = F.when(host_of_base & (of(3) == ""), F.concat(F.lit("/"), own(3))).otherwise(F.concat(F.regexp_extract(of(3), "^.*/", 0), own(3)))
    path = F.when(has_scheme | has_host, without_dots(own(3))).when(own(3) == "", of(3)).when(own(3).startswith("/"), without_dots(own(3))).otherwise(without_dots(merged))
    keeps = ~has_scheme & ~has_host & (own(3) == "") & ~before(ref).contains("?")  # the base's query stays
    asked = F.when(keeps, F.when(before(at).contains("?"), F.concat(F.lit("?"), of(4))).otherwise("")).when(before(ref).contains("?"), F.concat(F.lit("?"), own(4))).otherwise("")
    host = F.when(has_host, F.concat(F.lit("//"), own(2))).when(~has_scheme & host_of_base, F.concat(F.lit("//"), of(2))).otherwise("")
    return F.concat(F.when(has_scheme, own(1)).otherwise(of(1)), F.lit(":"), host, path, asked, F.when(ref.contains("#"), F.concat(F.lit("#"), own(5))).otherwise(""))
