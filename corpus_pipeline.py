"""From raw documents to packed training windows, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on everything that its
predecessor kept, and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of
``documents``. Nulls, repeated rows and empty tables are what the operators'
docstrings say; a document that line dedup empties altogether goes.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.llm import jaccard, linededup, mixing, packing, quality
from sitewarden.llm.common import Scratch, swept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy accepts."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; emptied documents go."""
    cleaned = linededup.dedup(docs, Scratch(spark)).where("n_removed_lines = 0 OR n_removed_lines < n_lines")
    row = F.col("row")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.char_length("row.text").cast(kind)
        row = row.withField("n_chars", F.when(F.col("n_removed_lines") > 0, length).otherwise(F.col("row.n_chars")))
    return cleaned.select(row.alias("row")).select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, of equal ids the smallest hash of a text, null ids last.

    Rows are told apart by a number of their own, so unlike texts under one id
    all stay, and rows without an id are compared like any other.
    """
    scratch, row = Scratch(spark), "_".join(["row", *docs.columns])
    rows = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard.join(rows.select(F.col(row).alias("doc_id"), "text"), scratch).select(F.col("doc_id").alias("n"), "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("bare"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(row).alias("n"))
    ranked = rows.select(F.col(row).alias("of"), rank.alias("rank")).join(found, F.col("of") == F.col("n"))
    first = scratch.keep(ranked.groupBy("component_id").agg(F.min("rank").alias("first")).select(F.col("first.n").alias("keep")), "kept")
    return rows.join(first.hint("merge"), F.col(row) == F.col("keep"), "left_semi").drop(row)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def nnls_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows, with their ids."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", source_mixing),
    ("nnls_packing", nnls_packing),
]

#: The token stage can't be written in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with swept():  # a stage's own tables go when its result is written
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
