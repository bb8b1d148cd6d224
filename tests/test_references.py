"""References and robots rules against their definitions."""

import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from sitewarden.functions import urls as U
from sitewarden.operators import robots

#: The examples of RFC 3986, 5.4, for the base http://a/b/c/d;p?q.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
    "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x",
    "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def resolved(spark, pairs):
    rows = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    return [r.u for r in rows.select("i", U.resolve(F.col("b"), F.col("r")).alias("u")).orderBy("i").collect()]


def test_examples_of_the_standard(spark):
    assert resolved(spark, [("http://a/b/c/d;p?q", r) for r in EXAMPLES]) == list(EXAMPLES.values())
    assert resolved(spark, [("http://a", "x/../y"), ("http://a?q", ""), ("http://u@A:8/x#f", "y")]) == ["http://a/y", "http://a?q", "http://u@A:8/y"]


def test_random_references(spark):
    rng = random.Random(5)
    made = lambda: "".join(rng.choice(["a", "b", "/", ".", "..", "/./", "/../", "?x/../y", ""]) for _ in range(rng.randint(1, 6)))
    pairs = [("http://h.example/one/two/three", r) for r in (made() for _ in range(400)) if not r.startswith("//") and "//" not in r.split("?")[0]]
    assert resolved(spark, pairs) == [urljoin(b, r) for b, r in pairs]


def test_rules_of_robots(spark):
    """Many rules of every form, each path decided by the longest that matches, against expressions."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    rules = {(rng.choice(["Allow", "Disallow"]), "/" + "*".join(word(rng.randint(0, 3)) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "$"])) for _ in range(300)}
    paths = sorted({"/" + word(rng.randint(0, 9)) for _ in range(600)})

    def verdict(path):
        hits = []
        for kind, pattern in rules:
            fixed = pattern.endswith("$")
            expression = ".*".join(map(re.escape, (pattern[:-1] if fixed else pattern).split("*"))) + ("$" if fixed else "")
            if re.match(expression, path):
                hits.append((len(pattern), kind == "Allow"))
        return max(hits)[1] if hits else True

    for some in (rules, list(rules)[:12]):
        rules = some
        body = "User-agent: *\n" + "\n".join(f"{k}: {p}" for k, p in sorted(some))
        known = robots.with_rules(spark.createDataFrame([("http", "h", 200, body)], "scheme string, host string, status int, body string"))
        asked = spark.createDataFrame([(p,) for p in paths], "path string").join(known.select(F.struct(*known.columns).alias("r")))
        got = {r.path: r.ok for r in asked.select("path", robots.allowed(F.col("path"), F.lit("bot")).alias("ok")).collect()}
        assert got == {p: verdict(p) for p in paths}
        assert "rlike" not in asked.select(robots.allowed(F.col("path"), F.lit("bot")))._jdf.queryExecution().toString().lower()


def test_an_agent_is_listed_once(spark):
    rows = [(s, "h", 200, "User-agent: GPTBot\nDisallow: /") for s in ("http", "https")]
    found = robots.ai_access(spark.createDataFrame(rows, "scheme string, host string, status int, body string")).collect()
    assert [r.data for r in found] == ['{"blocked":["GPTBot"]}']
