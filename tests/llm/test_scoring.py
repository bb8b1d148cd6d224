"""Context trees and token alignment against their definitions, written out plainly."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sitewarden.llm import crosstok, ctw
from sitewarden.llm.common import Scratch

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (900, None), (901, ""), (902, "  \n "), (903, "x"), (None, "no id but words"), (None, "no id but words"), (904, "Ünï ▁ code 日本 \x00 é́ Ａ"),
    (905, "  two  spaces and\ta tab \n end "), (906, "<|endoftext|> <s> x"), (907, "a" * 3000), (908, "trailing "), (908, "same id"), (909, "\x1c a\x1f b \x85 c　d ᠎ e"),
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))).capitalize() + rng.choice(["", ".", "\n"])) for i in range(120)] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS batch", "'x' AS pairs", "2 AS held_out").repartition(3)


class Trees:
    """Context trees by the definition, over dictionaries."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        for t in texts:
            for context, byte in self.steps(t):
                for known, bit in self.bits(byte):
                    for d in range(ctw.DEPTH + 1):
                        self.n[context[:d], known][bit] += 1
        self.children = defaultdict(list)
        for context, known in self.n:
            if context:
                self.children[context[:-1], known].append((context, known))
        self.w = {}

    @staticmethod
    def steps(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        raw = (" ".join(re.findall(r"[^\x20\x09-\x0D]+", lower)) + "\n").encode()
        before = bytes(ctw.DEPTH - 1) + b"\n" + raw
        return [(before[i : i + ctw.DEPTH][::-1], raw[i]) for i in range(len(raw))]

    @staticmethod
    def bits(byte):
        return [((1 << j) | byte >> (8 - j), byte >> (7 - j) & 1) for j in range(8)]

    @staticmethod
    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weight(self, node):
        if node not in self.w:
            k = self.block(*self.n[node])
            below = self.children.get(node)
            self.w[node] = np.logaddexp(k, sum(map(self.weight, below))) - math.log(2) if below else k
        return self.w[node]

    def p(self, context, known, bit, d=0):
        node = (context[:d], known)
        if node not in self.n:
            return None
        own = (self.n[node][bit] + 0.5) / (sum(self.n[node]) + 1)
        deeper = self.p(context, known, bit, d + 1) if d < ctw.DEPTH else None
        if deeper is None:
            return own
        a = math.exp(self.block(*self.n[node]) - math.log(2) - self.weight(node))
        return a * own + (1 - a) * deeper

    def score(self, text):
        return sum(math.log10(self.p(c, known, bit) or 0.5) for c, byte in self.steps(text) for known, bit in self.bits(byte))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


@pytest.mark.parametrize("batch", [ctw.BATCH, 700])
def test_context_trees(spark, docs, rows, batch):
    trees = Trees([t for i, t in rows if not held(i)])
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens(t))
    want = sorted(((i is None, i or 0, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t))), held(i), base(t), trees.score(t)) for i, t in rows)
    got = ctw.score(docs, Scratch(spark), batch).collect()
    assert {r.train_tokens for r in got} == {total}
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known), r.held_out, r.base_score, r.score) for r in got)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9)
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-3)


def test_decisions_are_distributions():
    """Seen or not, the probabilities of all bytes after a context sum to one."""
    trees = Trees(["abab abba baab", "bab a"])
    for context in (b"ba\n\0\0", b"zzzzz", b"ab ba", b"\n\0\0\0\0"):
        whole = sum(math.prod(trees.p(context, known, bit) or 0.5 for known, bit in trees.bits(byte)) for byte in range(256))
        assert abs(whole - 1) < 1e-9


def test_block_is_any_order():
    rng = random.Random(1)
    for _ in range(30):
        bits = [rng.random() < 0.3 for _ in range(rng.choice([3, 50, 9000]))]
        n, log = [0, 0], 0.0
        for b in bits:
            log += math.log((n[b] + 0.5) / (sum(n) + 1))
            n[b] += 1
        assert abs(log - ctw.block(np.array([n[0]]), np.array([n[1]]))[0]) < 1e-6 * (1 - log)


def test_few_texts(spark, docs):
    assert ctw.score(docs.where("false"), Scratch(spark)).count() == 0
    only = ctw.score(docs.where("doc_id = 0"), Scratch(spark)).first()
    assert held(0) or only.n_known == only.n_tokens
    none = spark.createDataFrame([(next(i for i in range(99) if held(i)), "ab c")], "doc_id long, text string")
    r = ctw.score(none, Scratch(spark)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and abs(r.score - 5 * 8 * math.log10(0.5)) < 1e-9


def test_near_the_source(spark):
    """Held-out texts of words made of 1 to 5 parts out of 40: close to the entropy of what makes them."""
    rng = random.Random(4)
    parts = ["".join(rng.choice("abdefghiklmnoprstuvw") for _ in range(rng.randint(2, 4))) for _ in range(40)]
    rows = [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(60))) for i in range(400)]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).where("held_out").collect()
    assert len(got) > 20 and 1 < -sum(r.score for r in got) / (len(got) * 60 * (math.log10(5) + 3 * math.log10(40))) < 1.06


def aligned(rows):
    """Every text encoded whole; all pairs of every group."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(crosstok._byte_letters())}
    a_bytes = {i: bytes(letters.get(c, 63) for c in t) for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, held_by = [], Counter()
    for _, text in rows:
        groups = []
        if text:
            x, y, raw = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text), f" {text}".encode()
            if b"".join(a_bytes[i] for i in x) == raw == b"".join(map(piece, y)):
                ends = lambda sizes: np.cumsum(list(sizes))
                ea, eb = ends(len(a_bytes[i]) for i in x), ends(len(piece(i)) for i in y)
                cuts = np.intersect1d(ea, eb)
                ga, gb = np.searchsorted(cuts, ea), np.searchsorted(cuts, eb)
                groups = [([x[i] for i in np.flatnonzero(ga == g)], [y[i] for i in np.flatnonzero(gb == g)]) for g in range(len(cuts))]
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        held_by.update(set(links))
        out.append((groups, links))
    best = defaultdict(int)
    for (p, _), n in held_by.items():
        best[p] = max(best[p], n)
    shown = lambda groups: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    digest = lambda groups: hashlib.sha256(shown(groups).encode()).hexdigest() if groups else ""
    return sorted(
        ((i is None, i or 0), sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(ls), sum(held_by[x] == best[x[0]] for x in ls), sum(held_by[x] for x in ls), digest(gs))
        for (i, _), (gs, ls) in zip(rows, out, strict=True)
    )


def test_alignment(spark, docs, rows):
    got = crosstok.align(docs, Scratch(spark), BYTE, PIECE).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == aligned(rows)
    assert crosstok.align(docs.where("false"), Scratch(spark), BYTE, PIECE).count() == 0


def test_alignment_in_small_batches(spark, monkeypatch):
    """Batches end and memories are dropped in the middle; groups of many tokens."""
    rng = random.Random(8)
    made = ["".join(rng.choice("aeiou日éзx-  \n\t1") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = list(enumerate(made + ["=" * 500, "ab" * 400, "\n" * 50]))
    aligner = crosstok.Aligner((BYTE, PIECE))
    dictionaries, shown = [], []
    monkeypatch.setattr(crosstok, "UNITS", 40)
    for k in range(0, len(rows), 7):
        part = rows[k : k + 7]
        batch = crosstok._Batch(aligner, pa.int64())
        batch.add(pa.array([i for i, _ in part]), [t for _, t in part], 1)
        out = pa.Table.from_batches(list(batch.emit()))
        own = out.filter(pa.compute.is_valid(out.column("pairs")))
        if own.num_rows:
            dictionaries.append(dict(zip(own.column("pairs")[0].as_py(), own.column("held")[0].as_py(), strict=True)))
        shown += out.filter(pa.compute.invert(pa.compute.is_valid(out.column("pairs")))).select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).to_pylist()
    want = aligned(rows)
    assert [tuple(r.values()) for r in shown] == [(w[0][1], *w[1:5], w[7]) for w in want]
    assert sum(sum(d.values()) for d in dictionaries) > 0 and len(aligner.shown) < 200
