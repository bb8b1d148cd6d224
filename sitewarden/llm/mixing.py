"""Mixing sources to target weights by systematic sampling (native only).

Every source gets a target in words; its documents share one expected number
of copies, ``target / size``. Within a source the expected copies are prefix
summed, one random offset is added, and a document is emitted once per integer
boundary its interval crosses.

A source may hold a third of all rows, so its order is not one sort: rows are
dealt to chunks of about ``CHUNK`` rows by a hash of the id, each chunk is
ordered on its own (by size, upwards and downwards in turn, which keeps the
words taken close to the target), and the chunk counts are prefix summed to
give every document its place in the source.

Defined results: null texts have size 0; null sources are one source, ordered
last; null ids and repeated rows are ordinary rows and get their own copies;
of rows that are equal in size, id and text, ``mix`` goes on by all other
columns, so reruns agree (maps can't be compared and don't count); an empty
table gives no rows; a source without words has target 0 and its
documents are not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
CHUNK = 2048
BROADCAST_SOURCES = 50_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Targets for ``(source, source_size, n_docs)``, one row per source.

    With ``total`` to share, a source gets ``min(cap, level * weight)``. Sorted
    by ``cap / weight``, sources fill up in that order, so the level follows
    from prefix sums: it is the one of the first source that it doesn't fill, and the
    largest of those that don't fill theirs.
    The windows run over one row per source, never over documents.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(everything) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), place + 1)
    s = sources.select(
        "source",
        "source_size",
        "n_docs",
        weight.alias("weight"),
        (F.col("source_size") * MAX_REPEAT).cast("double").alias("cap"),
    )
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * SHARE
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(whole)
    return s.select(
        "source",
        "source_size",
        "n_docs",
        F.round(F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))), 6).alias("target"),
    )


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def copies(docs: DataFrame, *along: str) -> DataFrame:
    """Every row with ``size, source_size, target, n_copies``.

    ``along`` names narrow columns to pass along, which also order what is
    equal otherwise. The per-source table is broadcast only where a count shows
    it to be small; otherwise it is joined by shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    tie = F.md5(F.coalesce("text", F.lit(""))).alias("tie")
    rows = scratch.keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), tie, *along), "sizes")  # the texts are read once
    per_source = scratch.keep(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))), "sources"
    ).withColumnRenamed("source", "s")
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    known = rows.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.col("tie"))
    known = known.withColumn("chunk", F.floor(_draw(F.lit(SEED), ident) * F.ceil(F.col("n_docs") / CHUNK)))
    way = F.when(F.col("chunk") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    in_chunk = Window.partitionBy("source", "chunk").orderBy(way, F.col("doc_id").asc_nulls_first(), "tie", *along)
    ranked = known.withColumn("k", F.row_number().over(in_chunk))
    earlier = Window.partitionBy("cs").orderBy("cc").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        known.groupBy(F.col("source").alias("cs"), F.col("chunk").alias("cc"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("cs", "cc", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    placed = ranked.join(offsets, F.col("source").eqNullSafe(F.col("cs")) & (F.col("chunk") == F.col("cc"))).drop("cs", "cc")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k = F.col("base") + F.col("k")
    start = _draw(F.lit(SEED), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    return placed.withColumn("n_copies", F.floor(start + rate * k) - F.floor(start + rate * (k - 1))).drop(
        "n_docs", "chunk", "tie", "k", "base"
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated or left out.

    Copies are decided on narrow rows, named by 128 bits of hash over all
    columns; whole rows are shuffled once, when the copies come home. Rows that
    are equal in everything share theirs out.
    """
    comparable = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    seals = [F.xxhash64(F.lit(i), *comparable).alias(f"seal_{i}") for i in (1, 2)]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    taken = copies(docs.select("doc_id", "source", "text", *seals), "seal_1", "seal_2").groupBy(F.col("seal_1").alias("t1"), F.col("seal_2").alias("t2"))
    taken = taken.agg(F.sum("n_copies").alias("n"), F.count(F.lit(1)).alias("m")).where("n > 0")
    both = docs.select(row, *seals).hint("merge").join(taken.hint("merge"), (F.col("seal_1") == F.col("t1")) & (F.col("seal_2") == F.col("t2")))
    share = F.row_number().over(Window.partitionBy("seal_1", "seal_2").orderBy("seal_1", "seal_2"))
    each = both.withColumn("times", F.expr("n div m") + F.when(share <= F.col("n") % F.col("m"), 1).otherwise(0))
    return each.select(F.explode(F.expr("array_repeat(row, cast(times as int))")).alias("row")).select("row.*")
