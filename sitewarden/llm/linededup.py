"""Removal of repeated three-line windows (line dedup).

Lines are split at line feeds; a line without a word is no line of a window.
Every window of three consecutive lines is hashed (128 bits: two 64-bit hashes
of the three line hashes), windows found more than once anywhere are looked up
globally, and of each the earliest occurrence, by document id, then text hash,
then place, stays. All lines covered by later occurrences are removed, the
covered places of overlapping windows merged first.

Windows leave a document as array rows, so texts are shuffled only once, when
removals are brought home. Frequent windows are pre-aggregated and joined as a
written table, which lets Spark split their partitions.

Defined results: null and empty texts and texts of fewer than three lines stay
as they are; rows that repeat both id and text are one document and get the
same result; a null id is an id of its own that sorts first; columns other than
``doc_id`` and ``text`` pass through ``dedup`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, let

WIDTH = 3


def _solid(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def windows(docs: DataFrame) -> DataFrame:
    """``doc_id, seal, at, h1, h2, covers``: one row per window.

    ``at`` counts lines with a word from 0; ``covers`` has the window's places among all lines.
    """
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    solid = F.filter(numbered, lambda p: _solid(p["x"]))
    hashed = F.transform(solid, lambda p: F.struct(p["i"].alias("i"), F.xxhash64(p["x"]).alias("a"), F.hash(p["x"]).alias("b")))
    held = let(
        hashed,
        lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (WIDTH - 1), F.lit(0))),
            lambda x, i: F.struct(
                i.alias("at"),
                F.xxhash64(x["a"], F.get(h, i + 1)["a"], F.get(h, i + 2)["a"]).alias("h1"),
                F.xxhash64(x["b"], F.get(h, i + 2)["a"], F.get(h, i + 1)["b"], x["a"], F.get(h, i + 2)["b"]).alias("h2"),
                F.array(x["i"], F.get(h, i + 1)["i"], F.get(h, i + 2)["i"]).alias("covers"),
            ),
        ),
    )
    rows = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("seal"), F.explode(held).alias("w"))
    return rows.select("doc_id", "seal", "w.at", "w.h1", "w.h2", "w.covers")


def removals(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, seal, gone``: the places, among all lines, that a document loses."""
    found = scratch.keep(windows(docs), "windows")
    repeated = scratch.keep(
        found.groupBy(F.col("h1").alias("r1"), F.col("h2").alias("r2"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "seal", "at")).alias("first"))
        .where("n > 1")
        .select("r1", "r2", F.col("first.doc_id").alias("fd"), F.col("first.seal").alias("fs"), F.col("first.at").alias("fa")),
        "repeated",
    )
    later = found.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).where(
        ~(F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("seal") == F.col("fs")) & (F.col("at") == F.col("fa")))
    )
    return later.groupBy("doc_id", "seal").agg(F.array_distinct(F.flatten(F.collect_list("covers"))).alias("gone"))


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``row`` (the input row with its text cleaned), ``n_lines`` and ``n_removed_lines``."""
    gone = scratch.keep(
        removals(docs, scratch).select(F.col("doc_id").alias("gd"), F.col("seal").alias("gs"), "gone"), "removals"
    )
    scratch.drop("windows", "repeated")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    held = docs.select(row.alias("row"), F.col("doc_id").alias("kd"), F.xxhash64("text").alias("ks"))
    # merged at every size: a plan that turns from broadcast to shuffle as the table grows can't be projected
    both = held.join(gone.hint("merge"), F.col("kd").eqNullSafe(F.col("gd")) & (F.col("ks") == F.col("gs")), "left")
    parts = F.split("row.text", "\n")
    cleaned = let(
        parts,
        lambda p: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone")), lambda i: F.get(p, i)), "\n"
        ),
    )
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(cleaned)
    return both.select(
        F.col("row").withField("text", text).alias("row"),
        F.coalesce(F.size(F.filter(parts, _solid)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"),
    )
