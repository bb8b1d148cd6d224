"""Redirect rules checked against responses and a sitemap."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.schema import REDIRECT_RULES


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with exactly the ten columns, or an error."""
    return spark.read.schema(REDIRECT_RULES).option("enforceSchema", "false").csv(path, header=True)


def absolute(value: Column, domain: str) -> Column:
    raw = F.trim(value)
    base = domain if "://" in domain else f"https://{domain}"
    return F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit(base), F.when(raw.startswith("/"), "").otherwise("/"), raw))


def scope(original: Column, target: Column, domain: str) -> Column:
    host = U.hostname(absolute(target, domain))
    own = urlsplit(domain if "://" in domain else f"https://{domain}").hostname or ""
    return (
        F.when(original.contains("(?P<") | F.trim(original).startswith("https?://") | target.contains("{"), "dynamic")
        .when((host == own) | host.endswith("." + own), "in-scope")
        .otherwise("external")
    )


def same(a: Column, b: Column, any_scheme: Column, any_slash: Column) -> Column:
    """Host and path agree, and the scheme unless it may differ; queries don't matter."""
    cut = lambda p: F.when(any_slash, F.regexp_replace(p, "/+$", "")).otherwise(p)
    return (U.host(a) == U.host(b)) & (cut(U.decoded_path(a)) == cut(U.decoded_path(b))) & (any_scheme | (U.scheme(a) == U.scheme(b)))


def check(rules: DataFrame, responses: DataFrame, listed: DataFrame, domain: str) -> DataFrame:
    """One row per rule, in order of ``row_id``: scope, verdict, notes and the facts behind them.

    ``responses(url, status_code, final_url, hops, err)``; ``listed(loc)`` are the sitemap's URLs.
    Only rules in scope are looked up.
    """
    c = F.col
    numbered = rules if "row_id" in rules.columns else rules.withColumn("row_id", F.monotonically_increasing_id())
    flag = lambda name: F.upper(F.coalesce(c(name), F.lit(""))) == "TRUE"
    r = numbered.withColumns({"scope": scope(c("Original URL"), c("Redirect to"), domain), "source": absolute(c("Original URL"), domain), "target": absolute(c("Redirect to"), domain)})
    inside = c("scope") == "in-scope"
    src = responses.select(c("url").alias("su"), c("status_code").alias("source_status"), c("final_url").alias("source_final"), c("hops"), c("err").alias("source_err"))
    tgt = responses.select(c("url").alias("tu"), c("status_code").alias("target_status"), c("err").alias("target_err"))
    keys = listed.select(U.rule_key(c("loc")).alias("k")).distinct()
    r = r.join(src, inside & (c("source") == c("su")), "left").join(tgt, inside & (c("target") == c("tu")), "left")
    r = r.join(keys.withColumnRenamed("k", "k1"), U.rule_key(c("source")) == c("k1"), "left").join(keys.withColumnRenamed("k", "k2"), U.rule_key(c("target")) == c("k2"), "left")
    lost = c("su").isNull() | (F.coalesce(c("source_err"), F.lit("")) != "")
    gone = c("tu").isNull() | (F.coalesce(c("target_err"), F.lit("")) != "")
    match = same(c("source_final"), c("target"), flag("Ignore protocol"), flag("Ignore trailing slash"))
    live, off = c("hops") == 0, flag("Disable if page exists")
    note = lambda when, level, text: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(level).alias("level"), text.alias("text")))
    bad = c("source_status") >= 400
    facts = F.array(
        note(bad, 2, F.concat(F.lit("source answers "), c("source_status").cast("string"))),
        note(~bad & live & off, 1, F.lit("the page still exists, so the rule is off")),
        note(~bad & live & ~off, 2, F.lit("the source doesn't redirect")),
        note(~bad & ~live & ~match, 2, F.concat(F.lit("redirects to "), c("source_final"))),
        note(gone, 2, F.lit("target can't be fetched")),
        note(~gone & (c("target_status") >= 400), 2, F.concat(F.lit("target answers "), c("target_status").cast("string"))),
        note(c("k1").isNotNull(), 1, F.lit("the source is still in the sitemap")),
        note(c("k2").isNull(), 1, F.lit("the target isn't in the sitemap")),
    )
    notes = F.when(~inside, F.array_compact(F.array(F.when(F.lit(False), facts[0])))).when(lost, F.array(F.struct(F.lit(2).alias("level"), F.lit("source can't be fetched").alias("text")))).otherwise(F.array_compact(facts))
    r = r.withColumn("n", notes)
    level = F.coalesce(F.array_max(F.transform("n", lambda x: x["level"])), F.lit(0))
    return r.select(
        *numbered.columns,
        "scope",
        F.when(inside, F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("error")), level + 1)).alias("verdict"),
        F.when(inside & ~lost, c("source_status")).alias("source_status"),
        F.when(inside & ~lost, c("source_final")).alias("source_final_url"),
        F.when(inside & ~lost, match).alias("source_matches_target"),
        F.when(inside & ~lost & ~gone, c("target_status")).alias("target_status"),
        (inside & ~lost & c("k1").isNotNull()).alias("original_in_sitemap"),
        (inside & ~lost & c("k2").isNotNull()).alias("target_in_sitemap"),
        F.array_join(F.transform("n", lambda x: x["text"]), "; ").alias("notes"),
    )


def write_results(results: DataFrame, path: str) -> None:
    text = lambda x: F.upper(F.col(x).cast("string"))
    shown = results.withColumns({x: text(x) for x in ("source_matches_target", "original_in_sitemap", "target_in_sitemap")})
    shown.orderBy("row_id").drop("row_id").write.mode("overwrite").csv(path, header=True)
