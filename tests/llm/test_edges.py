"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitewarden.llm import caps, chains, crosstok, ctw, jaccard, langid, linededup, mixing, packing, quality, sortmeans, suffix, tokens
from sitewarden.llm.common import Scratch

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon\nzeta eta theta\niota kappa\nlambda mu", "en", "a", 5),
    (1, "alpha beta gamma delta epsilon\nzeta eta theta\niota kappa\nlambda mu", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id here", "de", None, 3),
    (None, None, None, "b", None),
    (4, "   \n\t ", "de", "b", 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, "same id", "fr", "c", 1),
    (6, "same id, other text", "fr", "c", 1),
    (7, "日本語 <|endoftext|> é́ \x00 x", "ja", "c", 1),
]
CLASH = "n_words long, row string, gone string, tie long, size long, node long, kept string, n string"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return base.selectExpr("*", *(f"cast(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in CLASH.split(", ")))


OPERATORS = {
    "op1": lambda d, s: packing.pack(d, WORD),
    "op2": lambda d, s: linededup.dedup(d, s),
    "op3": lambda d, s: suffix.dedup(d, s),
    "op4": lambda d, s: mixing.copies(d),
    "op4 mix": lambda d, s: mixing.mix(d),
    "op5": lambda d, s: quality.apply_policy(quality.ledger(d)),
    "op5 ablation": lambda d, s: quality.ablation(quality.ledger(d)),
    "op5 keep": lambda d, s: quality.keep_good(d),
    "op6": lambda d, s: langid.predict(d, langid.fit(d, s)),
    "op7": lambda d, s: chains.passages(d, s),
    "op8": lambda d, s: jaccard.join(d, s),
    "op9": lambda d, s: tokens.token_counts(d, BYTE),
    "op11": lambda d, s: ctw.score(d, s),
    "op13": lambda d, s: crosstok.align(d, s, BYTE, PIECE),
}
EACH_ROW = ("op2", "op3", "op4", "op5", "op6", "op8", "op9", "op11", "op13")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, name):
    rows = OPERATORS[name](docs, Scratch(spark)).collect()
    if name in EACH_ROW:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, docs, name):
    empty = docs.where("false").repartition(2)
    got = OPERATORS[name](empty, Scratch(spark)).collect()
    assert all(r.asDict().get("n_failed") == 0 or not r for r in got)


def test_defined_results(spark, docs):
    s = Scratch(spark)
    by = lambda rows, c: {r.doc_id: r[c] for r in rows if r.doc_id is not None}
    assert {r.doc_id: r.lang_pred for r in OPERATORS["op6"](docs, s).collect()}[2] == "und"
    joined = jaccard.join(docs, s).collect()
    assert by(joined, "component_id")[2] == 2 and by(joined, "n_shingles")[3] == 0
    assert all(r.component_id is None for r in joined if r.doc_id is None)
    cut = suffix.dedup(docs, s).collect()
    assert [r.n_bytes for r in cut if r.doc_id == 2] == [0]
    assert by(quality.ledger(docs).collect(), "n_words")[4] == 0
    assert by(tokens.token_counts(docs, BYTE).collect(), "n_tokens")[2] == 0
    lines = linededup.dedup(docs, s).select("row.doc_id", "n_removed_lines").collect()
    assert [r.n_removed_lines for r in lines if r.doc_id == 1] == [0, 0]


@pytest.mark.parametrize("rows", [True, False])
def test_stages(spark, docs, rows):
    d, scratch = docs if rows else docs.where("false"), Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = d
        d = scratch.keep(stage(spark, d, ""), name)
        if name != "nnls_packing":
            assert d.columns == before.columns
        d.count()


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], None), (4, None, 2), (5, [float("nan"), 1.0], 2), (6, [1.0, None], 2), (7, [1.0, 0.0], 3), (7, [1.0, 0.0], 3), (None, [1.0, 0.0], 3), (8, [1.0, 0.0, 0.0], 3), (9, [0.0, 1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit("x"))
    got = caps.near_duplicates(v, Scratch(spark)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == [
        (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 3, 1, False), (7, 3, 1, False), (8, 0, 8, True), (9, 0, 9, True),
    ]
    assert caps.near_duplicates(v.where("false"), Scratch(spark)).count() == 0


def test_vectors_in_centres(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 2), (3, [float("nan"), 1.0], 2), (4, [1.0, None], 2), (None, [1.0, 0.0], 3), (5, [1.0, 0.0, 0.0], 3), (6, [0.0, 1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"cluster": F.lit("x"), "v": F.lit(1)})
    got = sortmeans.cluster(v, Scratch(spark), k=2, dims=2, rounds=2).collect()
    assert {r.vec_id for r in got} == {None, 1, 6} and len(got) == 4
    assert sortmeans.cluster(v.where("false"), Scratch(spark), dims=2).count() == 0


def test_vectors_under_one_id(spark):
    """An id of two vectors, and components whose squares leave the range of doubles."""
    rows = [(7, [1.0, 0.0]), (7, [0.999, 0.02]), (8, [1.0, 0.01]), (9, [0.0, 1.0]), (10, [1e200, 1e198]), (11, [1e-200, 0.0]), (12, [0.0, -1e-310])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = caps.near_duplicates(v, Scratch(spark)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (7, 4, 7, True), (7, 4, 7, True), (8, 4, 7, False), (9, 0, 9, True), (10, 4, 7, False), (11, 4, 7, False), (12, 0, 12, True),
    ]


def test_numerals_are_no_letters(spark):
    assert langid.letter_runs("½ ² Ⅷ ① 3 _") == [] and langid.letter_runs("Ab½c² é") == ["ab", "c", "é"]
    rows = [(i, "eins zwei drei", "de") for i in range(20)] + [(50, "½ ② Ⅷ 77", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(d, langid.fit(d, Scratch(spark))).where("doc_id = 50").first()
    assert (got.lang_pred, got.score) == ("und", 0.0)
