"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

import public_tokenizers

from . import caps, chains, crosstok, ctw, jaccard, langid, linededup, mixing, packing, quality, sortmeans, suffix, tokens
from .common import Scratch, table
from .sql import ORACLE


def op1_nnls_packing(spark, sf_dir):
    """Pieces of all documents in windows of 2048 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_line_dedup(spark, sf_dir):
    """What three-line windows remove from every document."""
    cleaned = linededup.dedup(table(spark, sf_dir, "documents"), Scratch(spark))
    return cleaned.select(
        "row.doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256")
    )


def op3_suffix_dedup(spark, sf_dir):
    """What repeated 200-byte strings remove from every document."""
    found = suffix.dedup(table(spark, sf_dir, "documents"), Scratch(spark))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_source_mixing(spark, sf_dir):
    """Words every document contributes to the mix."""
    return mixing.copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken")
    )


def op5_quality_rules(spark, sf_dir):
    """Measurements, failure bits and the verdict of the current policy."""
    return quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))


def op6_language_id(spark, sf_dir):
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs, Scratch(spark)))


def op7_collinear_chains(spark, sf_dir):
    """Passages that a document shares with an earlier one, word places and equal words."""
    return chains.passages(table(spark, sf_dir, "documents"), Scratch(spark))


def op8_ngram_jaccard(spark, sf_dir):
    """Set size and component of every document at similarity 0.75."""
    return jaccard.join(table(spark, sf_dir, "documents"), Scratch(spark))


def op9_token_counts(spark, sf_dir):
    """Tokens of every document under the byte-level vocabulary."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_cap_filters(spark, sf_dir):
    """Links and component of every embedding at cosine 0.95."""
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op11_context_trees(spark, sf_dir):
    """Log probability of every document, by counts of words and by weighted context trees."""
    return ctw.score(table(spark, sf_dir, "documents"), Scratch(spark))


def op12_sort_means(spark, sf_dir):
    """Centre of every 64-dimensional embedding after five exact rounds."""
    return sortmeans.cluster(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op13_token_alignment(spark, sf_dir):
    """Groups and links between two tokenizers in every document, with corpus counts of linked ids."""
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return crosstok.align(table(spark, sf_dir, "documents"), Scratch(spark), *paths)


QUERIES = {
    "op1_nnls_packing": op1_nnls_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_collinear_chains": op7_collinear_chains,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_token_counts": op9_token_counts,
    "op10_cap_filters": op10_cap_filters,
    "op11_context_trees": op11_context_trees,
    "op12_sort_means": op12_sort_means,
    "op13_token_alignment": op13_token_alignment,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
