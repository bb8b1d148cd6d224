"""Quality rules as a bitmask ledger (native expressions only).

``ledger`` measures every text once, evaluates every rule once and stores the
outcome as bits of ``fail_bits``. Policies are masks over those bits, so a new
policy version, or the effect of leaving one rule out, never reads text again.

Defined results: a null text counts as an empty one and fails ``few_words``;
every input row, repeated ones included, gives one row; null ids stay null;
columns of the input other than ``doc_id`` and ``text`` are ignored, so their
names cannot clash; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, let

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 14 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "duplicate_lines", "n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines"),
)
BASE_MASK = 0b11

#: Version -> bits that reject. New versions are added, old ones never change.
POLICIES = {1: 0b000011, 2: 0b111111}
CURRENT = 2


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows whose three words occur twice or more."""

    def spread(grams: Column) -> Column:
        # equal windows become neighbours; their places, in order, are merged
        ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        places = let(
            ranked,
            lambda r: F.sort_array(
                F.transform(
                    F.filter(
                        r,
                        lambda e, j: F.coalesce(e["g"] == F.get(r, j - 1)["g"], F.lit(False))
                        | F.coalesce(e["g"] == F.get(r, j + 1)["g"], F.lit(False)),
                    ),
                    lambda e: e["i"],
                )
            ),
        )
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            places,
            start,
            lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")),
            lambda a: a["n"],
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(
        hashed,
        lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)),
        ),
    )
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(spread(g)))


def measure(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """One row per document: the column ``carry`` and the measurements."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    split = docs.select(
        carry,
        words.alias("words"),
        lines.alias("lines"),
        F.char_length(bare).alias("word_chars"),
        (F.char_length(bare) - F.char_length(F.translate(bare, SYMBOLS, ""))).alias("n_symbols"),
    )
    return split.select(
        carry,
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: str = "doc_id") -> DataFrame:
    """Measurements and ``fail_bits``: bit ``r.bit`` is set where rule ``r`` fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, carry).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy version."""
    return led.withColumns(
        {
            "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0,
            "kept": F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0,
        }
    )


def ablation(led: DataFrame, version: int = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, and that only it rejects.

    One pass groups the ledger by its bits; at most ``2 ** len(rules)`` rows
    remain, from which every ablation follows without the documents.
    """
    mask = POLICIES[version]
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = F.array(
        *(F.struct(F.lit(1 << r.bit).cast("long").alias("bit"), F.lit(r.name).alias("rule")) for r in rules if mask >> r.bit & 1)
    )
    each = counts.select("bits", "n", F.explode(named).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )


def keep_good(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs``, all columns untouched, that the policy accepts.

    The whole row travels beside its verdict, so no join is needed and repeated
    rows, null ids and columns named like a measurement cannot mix.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    led = ledger(docs.select("text", row.alias("row")), carry="row")
    return apply_policy(led, version).where("kept").select("row.*")
