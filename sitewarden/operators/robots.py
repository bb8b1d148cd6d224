"""robots.txt as a table of rules, and which rule decides for a path.

A file is parsed by column expressions into ``robots_rules``; the group of the
most specific agent token decides, within it the longest pattern, and allowing
wins a tie. Without a readable file, a missing status or a server error shuts
everything, anything else opens everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from . import signatures as S
from .crawl_rules import flat
from .rules import found, issue


def with_rules(robots: DataFrame) -> DataFrame:
    """``robots(scheme, host, status, body)``, one row per host, with ``found``, ``sitemaps`` and ``rules``."""
    one = robots.dropDuplicates(["scheme", "host"])
    lines = F.filter(
        F.transform(F.split(F.coalesce("body", F.lit("")), "\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))),
        lambda x: x.contains(":"),
    )
    fields = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    # agents in a row open a group; a rule line closes the list of agents. A line is marked at both ends, so one split finds where groups begin
    mark = lambda x: F.when(x["k"] == "user-agent", "u").when(x["k"] == "allow", "a").otherwise("d")
    told = F.transform(F.filter(fields, lambda x: x["k"].isin("user-agent", "allow", "disallow")), lambda x: F.concat(mark(x), x["v"], mark(x)))
    groups = F.split(F.array_join(told, "\n"), r"(?<=[ad]\n)(?=u)")

    def ruled(group: Column) -> Column:
        each = F.split(group, "\n")
        value = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
        said = F.filter(each, lambda x: ~F.startswith(x, F.lit("u")) & (F.length(x) > 2))
        rules = lambda g: F.transform(said, lambda x: F.struct(F.lower(value(g)).alias("agent"), F.startswith(x, F.lit("a")).alias("allow"), value(x).alias("pattern")))
        return F.flatten(F.transform(F.filter(each, lambda x: F.startswith(x, F.lit("u"))), rules))

    agents = F.transform(F.filter(fields, lambda x: x["k"] == "user-agent"), lambda x: F.lower(x["v"]))
    there = (F.col("status") == 200) & (F.trim(F.coalesce("body", F.lit(""))) != "")
    return one.select(
        "scheme",
        "host",
        "status",
        F.coalesce(there, F.lit(False)).alias("found"),
        F.transform(F.filter(fields, lambda x: (x["k"] == "sitemap") & (x["v"] != "")), lambda x: x["v"]).alias("sitemaps"),
        F.reverse(F.array_sort(F.transform(F.flatten(F.transform(groups, ruled)), _parsed))).alias("rules"),
        F.array_distinct(agents).alias("agents"),
    )


def _parsed(rule: Column) -> Column:
    """A rule ready to match: what a path begins with, what follows in order between stars, and whether the end is fixed."""
    fixed = F.endswith(rule["pattern"], F.lit("$"))
    parts = F.split(F.when(fixed, F.substring(rule["pattern"], F.lit(1), F.length(rule["pattern"]) - 1)).otherwise(rule["pattern"]), r"\*")
    return F.struct(
        F.length(rule["pattern"]).alias("n"), rule["allow"].alias("allow"), rule["agent"].alias("agent"), F.get(parts, F.lit(0)).alias("head"),
        F.slice(parts, F.lit(2), F.size(parts)).alias("rest"), fixed.alias("fixed"),
    )


def _matches(path: Column, rule: Column) -> Column:
    """Whether a path matches a parsed rule, without an expression built for it.

    After the head, each part between stars is looked for from where the last
    one ended, and the first place is the best; an end that is fixed holds the
    last part at the end, not before that place.
    """
    rest, n = rule["rest"], F.length(path)
    inner = F.when(rule["fixed"], F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)

    def step(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, path, at)
        return F.when((at == 0) | (part == ""), at).when(found > 0, found + F.length(part)).otherwise(F.lit(0))

    at = F.aggregate(inner, F.length(rule["head"]) + 1, step)  # one past what is used up; 0: a part is missing
    last = F.element_at(rest, -1)
    ends = (at > 0) & F.endswith(path, last) & (n - F.length(last) + 1 >= at)
    plain = F.when(rule["fixed"], path == rule["head"]).otherwise(F.lit(True))
    return F.startswith(path, rule["head"]) & F.when(F.size(rest) == 0, plain).when(rule["fixed"], ends).otherwise(at > 0)


def _group(agents: Column, agent: Column) -> Column:
    """The most specific of a file's agents that an agent's token begins with."""
    token = F.regexp_extract(F.lower(agent), "^[^/ ]*", 0)
    own = F.filter(agents, lambda a: (a != "*") & F.startswith(token, a))
    best = F.array_max(F.transform(own, lambda a: F.struct(F.length(a).alias("n"), a.alias("a"))))["a"]
    return F.coalesce(best, F.lit("*"))


def allowed(path: Column, agent: Column, robots: str = "r") -> Column:
    """Whether the agent may fetch the path; ``robots`` names the struct that ``with_rules`` made, null if none is known.

    A host's rules come longest first, of equal length those that allow, so the
    first of the agent's group that matches decides and no other is tried.
    """
    r = lambda name: F.col(f"{robots}.{name}")
    group = _group(r("agents"), agent)
    first = lambda said, x: F.when(said.isNull() & (x["agent"] == group), F.when(_matches(path, x), x["allow"])).otherwise(said)
    verdict = F.aggregate(r("rules"), F.lit(None).cast("boolean"), first)
    closed = (r("status") == 0) | (r("status") >= 500)
    return F.when(F.col(robots).isNull(), F.lit(True)).when(~r("found"), ~closed).otherwise(F.coalesce(verdict, F.lit(True)))


def _key(rule: Column) -> Column:
    """The longest text that a path must hold for a parsed rule to match, and where: as a whole, in front, at the end or anywhere."""
    rest, head = rule["rest"], F.struct(F.length(rule["head"]).alias("n"), F.lit(2).alias("place"), rule["head"].alias("text"))
    tail = F.when(rule["fixed"] & (F.size(rest) > 0), F.size(rest) - 1)
    parts = F.transform(rest, lambda x, i: F.struct(F.length(x).alias("n"), F.when(i == tail, 1).otherwise(0).alias("place"), x.alias("text")))
    longest = F.array_max(F.concat(F.array(head), parts))
    whole = rule["fixed"] & (F.size(rest) == 0)
    return F.struct(F.when(whole, 3).otherwise(longest["place"]).alias("place"), F.when(whole, rule["head"]).otherwise(longest["text"]).alias("text"))


def _held(path: Column, kind: Column) -> Column:
    """What a path has at a place, in a length."""
    n, place, size = kind["n"], kind["place"], F.length(path)
    every = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(path, i, n))
    texts = F.when(place == 2, F.array(F.substring(path, F.lit(1), n))).when(place == 1, F.array(F.right(path, n))).otherwise(F.array_distinct(every))
    texts = F.when(place == 3, F.array(path)).when(size < n, F.array().cast("array<string>")).otherwise(texts)
    return F.transform(texts, lambda t: F.struct(place.alias("place"), t.alias("text")))


def verdicts(asked: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``asked(scheme, host, path)`` of hosts that ``with_rules`` has, each once, with ``ok``: what ``allowed`` says, by joins.

    A rule is met by the paths that hold its longest text, so a host's paths and
    rules may both be many: they are never paired but where one may match.
    """
    host = ["scheme", "host"]
    known = rules.select(*host, "found", ((F.col("status") == 0) | (F.col("status") >= 500)).alias("closed"))
    groups = rules.where("found").select(*host, _group(F.col("agents"), F.lit(agent)).alias("group"), "rules")
    own = groups.select(*host, "group", F.explode("rules").alias("rule")).where("rule.agent = group")
    own = own.select(*host, F.struct("rule.n", "rule.allow").alias("says"), "rule", _key(F.col("rule")).alias("key"))
    kind = F.struct(F.col("key.place").alias("place"), F.when(F.col("key.place") == 3, 0).otherwise(F.length("key.text")).alias("n"))
    kinds = own.groupBy(*host).agg(F.collect_set(kind).alias("kinds"))  # places, and lengths that paths have
    paths = asked.select(*host, "path").distinct()
    places = paths.join(kinds, host).select(*host, "path", F.explode("kinds").alias("kind"))
    pieces = places.select(*host, "path", _held(F.col("path"), F.col("kind")).alias("keys")).select(*host, "path", F.explode("keys").alias("key"))
    met = pieces.join(own, [*host, "key"]).where(_matches(F.col("path"), F.col("rule")))
    said = met.groupBy(*host, "path").agg(F.max("says")["allow"].alias("allow"))  # the longest decides, allowing wins a tie
    ok = F.when(~F.col("found"), ~F.col("closed")).otherwise(F.coalesce("allow", F.lit(True)))
    return paths.join(known, host).join(said, [*host, "path"], "left").select(*host, "path", F.col("found"), ok.alias("ok"))


def robots_path(url: Column) -> Column:
    p = F.when(U.path(url) == "", "/").otherwise(U.path(url))
    return F.concat(p, F.when(U.query(url) != "", F.concat(F.lit("?"), U.query(url))).otherwise(""))


def robots_issues(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    rules = with_rules(robots)
    at = F.concat(F.lit("host "), F.col("host"))
    n = F.size("sitemaps")
    hosts = flat(
        rules,
        found(
            issue("robots", "info", "robots-missing", ~F.col("found"), url=at, status=F.col("status")),
            issue("robots", "info", "robots-no-sitemap-declared", F.col("found") & (n == 0), url=at),
            issue("robots", "info", "robots-sitemaps-declared", F.col("found") & (n > 0), url=at, sitemaps=F.col("sitemaps")),
        ),
    )
    url = F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("requested_url"))
    asked = pages.select(url.alias("u")).select("u", U.scheme(F.col("u")).alias("scheme"), U.host(F.col("u")).alias("host"), robots_path(F.col("u")).alias("path"))
    shut = verdicts(asked, rules, agent).where("found AND NOT ok")
    hit = asked.join(shut, ["scheme", "host", "path"], "left_semi")
    return hosts.unionAll(flat(hit, F.array(issue("robots", "warning", "robots-crawled-disallowed", url=F.col("u")))))


def ai_access(robots: DataFrame) -> DataFrame:
    rules = with_rules(robots)
    held = rules.where("found").select("host", F.struct(*rules.columns).alias("r"), F.explode(F.array(*map(F.lit, S.AI_AGENTS))).alias("agent"), F.lit(0).alias("_"))
    shut = held.where(~allowed(F.lit("/"), F.col("agent"))).groupBy("host").agg(F.sort_array(F.collect_set("agent")).alias("blocked"))
    return flat(shut, F.array(issue("geo", "info", "geo-ai-crawler-blocked", url=F.concat(F.lit("host "), F.col("host")), blocked=F.col("blocked"))))


def llms_txt(responses: DataFrame, seed: str) -> DataFrame:
    """``responses(url, final_url, status, content_type, body)`` of the seed host's llms.txt, or none; issues name the file."""
    at = F.concat(F.regexp_extract(F.lit(seed), "^([a-z]+://[^/?#]*)", 1), F.lit("/llms.txt"))
    body = F.lower(F.trim(F.coalesce("body", F.lit(""))))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    page = body.rlike("^(<!doctype|<html|<[?]xml)") | kind.contains("text/html") | kind.contains("application/xhtml")
    moved = F.coalesce(U.index_key(F.col("final_url")) != U.index_key(F.col("url")), F.lit(False)) & (F.col("final_url") != "")
    good = (F.col("status") == 200) & (body != "") & ~page & ~moved
    one = responses.agg(F.coalesce(F.max(good), F.lit(False)).alias("ok"))
    return flat(one, found(issue("geo", "info", "geo-llms-txt", F.col("ok"), url=at), issue("geo", "info", "geo-no-llms-txt", ~F.col("ok"), url=at)))
