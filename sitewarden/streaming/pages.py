"""Page rules on a stream of responses; what looks across pages is judged over the stored pages when the stream is through.

A page counts once: repeats of its final key within ``delay`` of event time are
dropped, by state that the watermark bounds and that survives a restart with
the query's checkpoint. Pages are written once, beside their issues, so the
rules that need a whole crawl run over that table afterwards (``rest``).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls as U
from ..operators import crawl_rules, rules
from ..plans import audit
from ..sources.html import with_features

#: Analyzers whose rules need one page and nothing of the crawl it belongs to.
STREAMED = [n for n in audit.ORDER if n in rules.PAGE_RULES and n not in ("perf", "wordpress")]
TIME, DELAY = "fetched_at", "1 hour"


def streamed(options: audit.Options) -> list[str]:
    """The selected analyzers that a stream can run; one that was asked for by name and can't is an error."""
    names, _ = audit.select(options)
    if refused := [n for n in options.enabled if n in audit.ORDER and n not in STREAMED]:
        raise ValueError(f"{', '.join(refused)}: judged over a whole crawl, not on a stream")
    return [n for n in names if n in STREAMED]


def once(pages: DataFrame, time: str = TIME, delay: str = DELAY) -> DataFrame:
    """Each page once, by its final key; pages later than the watermark are dropped. A table has no watermark: it keeps one of each."""
    keyed = pages.withColumn("_key", U.index_key(F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("requested_url"))))
    if not pages.isStreaming:
        return keyed.dropDuplicates(["_key"]).drop("_key")
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def page_issues(pages: DataFrame, options: audit.Options | None = None) -> DataFrame:
    """Issues of page rules, of a stream or a table alike."""
    options = options or audit.Options()
    made = dict(rules.PAGE_RULES) | {"aeo": lambda: rules.aeo(options.answer_lead), "geo": lambda: rules.geo(options.quotable_density)}
    arrays = [made[n]() for n in streamed(options)]
    return crawl_rules.flat(with_features(pages), F.concat(*arrays))


def start(pages: DataFrame, out: str, checkpoint: str, options: audit.Options | None = None, time: str = TIME, delay: str = DELAY, stored: str | None = None) -> StreamingQuery:
    """Appends the issues of each new page to ``out`` and, if asked, the pages themselves to ``stored``.

    ``time`` names the column of event time; pages without one are taken as they come, repeats included.
    """
    options = options or audit.Options()
    streamed(options)  # refuses what it can't do before anything runs
    fresh = once(pages, time, delay) if time in pages.columns else pages

    def write(batch: DataFrame, number: int) -> None:
        """A batch that is repeated after a failure replaces its own files."""
        held = batch
        if stored:
            batch.write.mode("overwrite").parquet(f"{stored}/batch={number}")
            held = batch.sparkSession.read.schema(batch.schema).parquet(f"{stored}/batch={number}")
        page_issues(held, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rest(spark: SparkSession, stored: str, options: audit.Options | None = None) -> DataFrame:
    """Issues of the rules that look across pages, over the pages that a stream stored."""
    options = options or audit.Options()
    names, _ = audit.select(options)
    late = [n for n in names if n not in STREAMED]
    pages = once(spark.read.parquet(stored).drop("batch"))  # what came again after the state of its key was let go
    return audit.audit(audit.prepare(pages), replace(options, enabled=late))
