"""Language identification with interpolated Kneser-Ney character models.

One model per language over the letters of lower-cased words, words padded by
a start and an end symbol. N-grams are 64-bit hashes in sorted arrays, one per
order for all languages, beside a matrix of discounted probabilities and one of
interpolation weights, a column per language. A text gets, per language, the
cross-entropy per symbol over all its words; the lowest wins.

The models are fitted on a bounded sample: of each language, documents are kept
by a hash of their id so that ``SAMPLE`` are expected; a fifth of them is held
back to calibrate a temperature (for ``score``, the probability of the winner)
and, per language, the cross-entropy above which a prediction is marked
``rejected``. Every text is scored whole. Words that were scored before are
remembered, within bounds, since a word's sum depends on nothing else.

Defined results: ``und`` and score 0 for a null text, one without a letter, or
where nothing could be learned; ties go to the first language by code point;
null ids are predicted, not learned from, and not held out; rows that repeat
are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import U, mix, numbers, slices, text_bytes, words

ORDER = 5
SAMPLE = 1200  # expected documents of each language that models are fitted on
START, END = 2, 3
REMEMBERED = 500_000
_LETTERS = re.compile(r"[^\W\d_]+")
_C = numbers(3, 11)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letter_runs(text: str) -> list[str]:
    """The longest stretches of letters (``str.isalpha``); numerals such as fractions are none."""
    runs = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [part for r in runs for part in "".join(c if c.isalpha() else " " for c in r).split()]


def _symbols(runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs padded in a row: symbol, place in its run, and where runs begin."""
    joined = "".join(chr(START) + r + chr(END) for r in runs)
    symbol = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    size = np.array([len(r) + 2 for r in runs], np.int64)
    begin = np.cumsum(size) - size
    return symbol, np.arange(len(symbol)) - np.repeat(begin, size), begin


def _grams(symbol: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the ``k``-grams that end at each place, for ``k`` from 1; valid from place ``k - 1`` of a run."""
    out = [mix(symbol * _C[0] + _C[1])]
    for _ in range(order - 1):
        longer = out[-1].copy()
        longer[1:] = mix(out[-1][:-1] * _C[2] + symbol[1:])
        out.append(longer)
    return out


class Model:
    """``keys[k]``, ``prob[k]``, ``weight[k]`` for order ``k + 1``; columns follow ``langs``."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.keys, self.prob, self.weight = [], [], []
        self.base = np.ones(len(langs))  # what one unseen symbol has
        self.heat, self.limit = 1.0, np.full(len(langs), np.inf)

    @classmethod
    def fit(cls, counts: dict[str, Counter]) -> Model:
        """``counts``: per language, how often each letter run occurs."""
        model = cls(sorted(counts))
        tables = [cls._tables(counts[lang]) for lang in model.langs]
        for k in range(ORDER):
            keys = np.unique(np.concatenate([np.concatenate([t[k][0], t[k][2]]) for t in tables]))
            prob, weight = np.zeros((len(keys), len(tables))), np.ones((len(keys), len(tables)))
            for j, t in enumerate(tables):
                prob[np.searchsorted(keys, t[k][0]), j] = t[k][1]
                weight[np.searchsorted(keys, t[k][2]), j] = t[k][3]
            model.keys.append(keys)
            model.prob.append(prob.astype(np.float32))
            model.weight.append(weight.astype(np.float32))
        model.base = np.array([t[-1] for t in tables]) / 256
        return model

    @staticmethod
    def _tables(runs: Counter) -> list:
        """Per order: grams, their discounted probability, contexts of the next order, their weight; then the unigram weight."""
        names = list(runs)
        symbol, place, begin = _symbols(names)
        often = np.repeat(np.array([runs[n] for n in names], np.int64), np.diff(np.append(begin, len(symbol))))
        grams = _grams(symbol)
        out, first = [], 0.0
        held: list[tuple[np.ndarray, np.ndarray]] = []  # contexts and weights for the order below
        for k in range(ORDER):
            ok = (place >= max(k, 1)) if k else place >= 1
            if k == ORDER - 1:
                gram, at = grams[k][ok], np.flatnonzero(ok)
                unique, index, inverse = np.unique(gram, return_index=True, return_inverse=True)
                count = np.bincount(inverse.ravel(), often[ok])
            else:
                longer = place >= k + 1  # what can be extended to the left counts its distinct extensions
                _, one = np.unique(grams[k + 1][longer], return_index=True)
                ends = np.flatnonzero(longer)[one]
                starts = np.flatnonzero(ok & (place == k))  # what begins a run cannot: it counts as often as it occurs
                at = np.concatenate([ends, starts])
                value = np.concatenate([np.ones(len(ends)), often[starts]])
                unique, index, inverse = np.unique(grams[k][at], return_index=True, return_inverse=True)
                count = np.bincount(inverse.ravel(), value)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            ends = at[index]
            context = grams[k - 1][ends - 1] if k else np.zeros(len(ends), U)
            names_c, of = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(of.ravel(), count), np.bincount(of.ravel())
            prob = np.maximum(count - discount, 0) / total[of.ravel()]
            weights = discount * kinds / total
            if k:
                held.append((names_c, weights))
            else:
                first = float(weights[0]) if len(weights) else 1.0
            out.append([unique, prob])
        for k in range(ORDER):
            c, w = held[k] if k < len(held) else (np.zeros(0, U), np.zeros(0))
            out[k] += [c, w]
        return [*out, first]

    def entropy(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each run: the negative log probability (nats) in every language, and its symbols."""
        symbol, place, begin = _symbols(runs)
        p = np.tile(self.base, (len(symbol), 1))
        before = None  # weights of the order, from the gram that ends one place earlier
        for k, gram in enumerate(_grams(symbol)):
            keys = self.keys[k]
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            there = keys[at] == gram
            if k:
                there &= place >= k
            seen = np.where(there[:, None], self.prob[k][at], 0)
            if k:
                ok = (place >= k)[:, None]
                p = np.where(ok, seen + before * p, p)
            else:
                p = seen + p
            weight = np.where(there[:, None], self.weight[k][at], 1)
            before = np.ones_like(weight)
            before[1:] = weight[:-1]
        loss = -np.log(np.maximum(p, 1e-30))
        loss[place == 0] = 0
        return np.add.reduceat(loss, begin), np.diff(np.append(begin, len(symbol))) - 1


class Scorer:
    """Scores texts with a model and remembers the words it met."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[int, int] = {}
        self.rows = np.zeros((0, len(model.langs) + 1))

    def _learn(self, texts: list[str]) -> np.ndarray:
        runs = [letter_runs(t) for t in texts]
        out = np.zeros((len(texts), len(self.model.langs) + 1))
        flat = [r for rs in runs for r in rs]
        if flat:
            loss, n = self.model.entropy(flat)
            np.add.at(out, np.repeat(np.arange(len(texts)), [len(r) for r in runs]), np.column_stack([loss, n]))
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropies of each text, and its symbols."""
        data, offsets = text_bytes(column)
        hashes, text, starts, ends = words(data, offsets)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known, self.rows = {}, self.rows[:0]
        names = unique.tolist()
        new = [i for i, h in enumerate(names) if h not in self.known]
        if new:
            raw = data.tobytes()
            some = [raw[starts[j] : ends[j]].decode("utf-8", "replace") for j in first[new]]
            size = len(self.rows)
            self.rows = np.concatenate([self.rows, *(self._learn(some[i : i + 20_000]) for i in range(0, len(some), 20_000))])
            self.known.update((names[i], size + j) for j, i in enumerate(new))
        at = np.array([self.known[h] for h in names], np.int64)
        total = np.zeros((len(column), self.rows.shape[1]))
        if len(text):
            has, begin = np.unique(text, return_index=True)
            total[has] = np.add.reduceat(self.rows[at[inverse.ravel()]], begin)
        n = total[:, -1]
        return total[:, :-1] / np.maximum(n, 1)[:, None], n


_scorers: dict = {}


def _scorer(shared) -> Scorer:
    model = shared.value
    if _scorers.get("model") is not model:
        _scorers.update(model=model, scorer=Scorer(model))
    return _scorers["scorer"]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often letter runs occur: ``lang, run, n``."""
    counts: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.update((lang, r) for r in letter_runs(text or ""))
    items = list(counts.items())
    columns = [pa.array([k[0] for k, _ in items], pa.string()), pa.array([k[1] for k, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["lang", "run", "n"])


def _entropies(docs: DataFrame, shared, langs: int) -> DataFrame:
    """``doc_id, lang, held_out, has, ce``: symbols and cross-entropies of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = ["doc_id", "lang", "held_out"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    ce, n = scorer.score(part.column("text"))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * langs, pa.int32()), pa.array(ce.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n.astype(np.int64)), lists], names=[*kept, "n", "ce"])

    return docs.select(*kept, "text").mapInArrow(work, f"doc_id {kind}, lang string, held_out boolean, n long, ce array<double>")


def fit(docs: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """A calibrated model from the documents that may be learned from."""
    spark = docs.sparkSession
    may = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in may.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not sizes:
        return Model([])
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sizes.items()))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    drawn = scratch.keep(may.where(draw < share).withColumn("tune", F.pmod(F.xxhash64("doc_id", F.lit("tune")), F.lit(5)) == 0), "sample")
    counts: dict[str, Counter] = {k: Counter() for k in sizes}

    def count(some: DataFrame) -> None:
        rows = some.select("lang", "text").mapInArrow(_counts, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
        for lang, run, n in rows.toPandas().itertuples(index=False):  # bounded by the sample
            counts[lang][run] = n

    count(drawn.where("NOT tune"))
    bare = [k for k, v in counts.items() if not v]
    if bare:  # languages of few documents are fitted on those set aside
        count(drawn.where(F.col("tune") & F.col("lang").isin(*bare)))
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return Model([])
    with np.errstate(over="ignore"):
        model = Model.fit(counts)
    tune = drawn.where(F.col("tune") & ~F.col("lang").isin(*bare)).withColumn("held_out", F.lit(False))
    seen = _entropies(tune, spark.sparkContext.broadcast(model), len(model.langs)).where("n > 0").toPandas()
    known = seen[seen["lang"].isin(model.langs)] if len(seen) else seen
    if len(known):
        ce = np.vstack(known["ce"])
        true = np.array([model.langs.index(x) for x in known["lang"]])
        best = None
        for heat in (1, 2, 4, 8, 16, 32):
            z = -ce * heat
            nll = np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) - (z[np.arange(len(z)), true] - z.max(1)))
            if best is None or nll < best:
                best, model.heat = nll, float(heat)
        for j in range(len(model.langs)):
            own = ce[true == j, j]
            if len(own) >= 20:
                model.limit[j] = float(np.quantile(own, 0.995)) * 1.05
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected, cross_entropy`` for every row."""
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    if not model.langs:
        return marked.select(
            "doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy")
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = _entropies(marked, shared, len(model.langs))
    low = F.array_min("ce")
    place = F.array_position("ce", low).cast("int")
    names = F.array(*map(F.lit, model.langs))
    limits = F.array(*(F.lit(float(x)) for x in model.limit))
    odds = F.aggregate("ce", F.lit(0.0), lambda s, x: s + F.exp((low - x) * model.heat))
    none = F.col("n") == 0
    return scored.select(
        "doc_id",
        "held_out",
        F.when(none, "und").otherwise(F.element_at(names, place)).alias("lang_pred"),
        F.when(none, 0.0).otherwise(1 / odds).alias("score"),
        (none | (low > F.element_at(limits, place))).alias("rejected"),
        F.when(~none, low).alias("cross_entropy"),
    )
