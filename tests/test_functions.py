import pytest
from pyspark.sql import functions as F

from sitewarden.functions import text as T
from sitewarden.functions import urls as U


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "url, key, slash",
    [
        ("HTTPS://Shop.Example/A/", "https://shop.example/A", "https://shop.example/A/"),
        ("http://shop.example:80", "http://shop.example/", "http://shop.example/"),
        ("https://shop.example:443/a#x", "https://shop.example/a", "https://shop.example/a"),
        ("https://u:p@shop.example:8443/a?b=1#c", "https://shop.example:8443/a?b=1", "https://shop.example:8443/a?b=1"),
        (" https://shop.example/a// ", "https://shop.example/a/", "https://shop.example/a//"),
        ("http://[::1]:80/x", "http://[::1]/x", "http://[::1]/x"),
    ],
)
def test_index_key(spark, url, key, slash):
    assert one(spark, url, U.index_key) == key
    assert one(spark, url, U.keep_slash) == slash


@pytest.mark.parametrize("url, name", [("http://a.b:81/", "a.b"), ("http://[::1]:81/", "::1"), ("http://[::1]/", "::1"), ("http://A.b", "a.b")])
def test_hostname(spark, url, name):
    assert one(spark, url, U.hostname) == name


def test_other_keys(spark):
    assert one(spark, "https://A.example/x/?q#f", U.page_key) == "https://A.example/x/"
    assert one(spark, "https://a.example/x//#f", U.sitemap_key) == "https://a.example/x"
    assert one(spark, "https://A.example:1/x/?q", U.landing_key) == "a.example:1/x"
    assert one(spark, "https://a.example/f%C3%BCr", U.rule_key) == "a.example/für"
    assert one(spark, "https://a.example/", U.rule_key) == "a.example/"


def test_query_pairs(spark):
    pairs = one(spark, "/?a=1+2&b=%zz&c&d=x;y&A=%C3%BC", U.query_pairs)
    assert [(p["key"], p["value"]) for p in pairs] == [("a", "1 2"), ("c", ""), ("A", "ü")]


def test_text(spark):
    assert one(spark, "a b\x1fc　d", T.word_count) == 3
    assert one(spark, "The red shoes, red für x ab", T.tokens) == ["red", "shoes", "für"]
    assert [one(spark, s, T.is_question) for s in ("How to", "pay now?", "Howto", "", '"Why" not')] == [True, True, False, False, True]
    assert [one(spark, s, T.redact) for s in ("abcd", "abcdef")] == ["****", "ab**ef"]


def test_rendering(spark):
    from sitewarden.functions import render as R

    assert one(spark, '{"present": true, "entries": [{"a": 1}, [2]]}', R.data_layer) == (True, ['{"a":1}', "[2]"])
    assert one(spark, "nothing", R.data_layer) is None
    assert one(spark, "foobar", R.fnv64) == 0x85944171F73967E8 - (1 << 64)
    assert one(spark, "foobar", lambda c: R.pick(c, 5)) == 0x85944171F73967E8 % 5
