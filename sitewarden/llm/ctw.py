"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words, a space between them and a line feed at the
end, as UTF-8. Each byte is eight binary decisions. A decision is made at a
node: up to ``DEPTH`` bytes before it, and the bits of its own byte that are
known. A node counts the zeros and ones of the training texts; the
Krichevsky-Trofimov estimator gives its counts the probability ``K``, and it is
weighted as ``W = (K + product of its children's W) / 2``, where children reach
one byte further back (``W = K`` at the last depth). Weights come from all
training bytes at once, since ``K`` depends on counts alone. A decision then has
the probability ``a k + (1 - a) p``: ``k`` is the node's own estimate, ``p`` what
the child on its way gives, ``a = K / 2 W``. Where training never went the way
stops: the last seen node's own estimate is taken (an empty child would say one
half).

The tree is as large as the corpus makes it, so no machine holds it. Texts are
dealt into batches of some 32 MB. A batch asks once for each distinct n-gram
(context and byte) and each distinct word it has, as sorted arrays; requests
are summed by key, subtrees under two bytes are worked out where their contexts
meet (at most 256 ** 4 n-grams, whatever the corpus), the two upper depths from
sums of at most 65,280 nodes on the driver, and answers go back to the batches.

Defined results: a null text is an empty one (its end is a token); documents
without an id are scored, learned from and not held out; rows that repeat are
rows of their own; words are compared by 63 bits of hash; without training
documents every decision has one half and every token ``log10(0.1 / 0.1)``;
other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import SPACE, U, mix, slices, text_bytes, words

DEPTH, UPPER = 5, 2
#: Bytes of text of a batch, of what is worked on at once, and per part that keys are dealt to.
BATCH, PIECE, PART = 32 << 20, 1 << 20, 4 << 20
SLICE = 1 << 18
END, GAP = 10, 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Marks the key of a word; n-grams have six bytes.
WORD = U(1 << 63)
_FEW = 4096
_HALVES = np.array([math.lgamma(n + 0.5) - math.lgamma(0.5) for n in range(_FEW)])
_WHOLES = np.array([math.lgamma(n + 1.0) for n in range(_FEW)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _log_gamma(n: np.ndarray, add: float, table: np.ndarray, less: float) -> np.ndarray:
    x = np.maximum(n, _FEW) + add
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - less
    return np.where(n < _FEW, table[np.minimum(n, _FEW - 1).astype(np.int64)], far)


def block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log probability that the KT estimator gives to so many zeros and ones, in any order."""
    own = partial(_log_gamma, add=0.5, table=_HALVES, less=math.lgamma(0.5))
    return own(zeros) + own(ones) - _log_gamma(zeros + ones, 1.0, _WHOLES, 0.0)


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are modelled, texts in a row, and how many each text has."""
    n = len(offsets) - 1
    ends = offsets[1:] + np.arange(n)
    longer = np.insert(data, offsets[1:], END)
    at_end = np.zeros(len(longer), bool)
    at_end[ends] = True
    kept = np.flatnonzero(~SPACE[longer] | at_end)
    gaps = np.flatnonzero((np.diff(kept) > 1) & ~at_end[kept[1:]] & ~at_end[kept[:-1]]) + 1
    out = np.insert(_LOWER[longer[kept]], gaps, GAP)
    places = np.searchsorted(kept, ends)
    places += np.searchsorted(gaps, places, "right")
    return out, np.diff(places, prepend=-1)


def grams(stream: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each byte: the bytes before it, the last one first, then itself. Before a text stands one end and then nothing."""
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(stream)) - np.repeat(begin, sizes)
    wide, out = stream.astype(U), np.zeros(len(stream), U)
    for back in range(1, DEPTH + 1):
        out <<= U(8)
        out[back:] |= wide[:-back]
        early = np.flatnonzero(place < back)
        out[early] = out[early] >> U(8) << U(8) | np.where(place[early] == back - 1, U(END), U(0))
    return out << U(8) | wide


def _bits(byte: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The decision number ``j`` of bytes: what is known before it (from 1), and the bit."""
    return U(1 << j) | (byte >> U(8 - j)), (byte >> U(7 - j) & U(1)).astype(bool)


class Level:
    """All nodes of one depth and one decision, ascending."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, n: np.ndarray, j: int):
        known, bit = _bits(byte, j)
        node = context << U(8) | known
        new = np.ones(len(node), bool)
        new[1:] = node[1:] != node[:-1]
        first = np.flatnonzero(new)
        self.node, self.of, self.bit = node[first], np.cumsum(new) - 1, bit
        self.ones = np.add.reduceat(np.where(bit, n, 0), first)
        self.zeros = np.add.reduceat(np.where(bit, 0, n), first)

    def estimate(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the node's estimate of its bit, and whether training came here."""
        total = (self.zeros + self.ones)[self.of]
        return (np.where(self.bit, self.ones[self.of], self.zeros[self.of]) + 0.5) / (total + 1), total > 0


def weigh(k: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``log W`` and ``a`` of nodes from their ``log K`` and the sum of their children's ``log W``."""
    w = np.logaddexp(k, children) - math.log(2)
    return w, np.exp(k - math.log(2) - w)


def subtrees(keys: np.ndarray, n: np.ndarray, low: int = UPPER) -> tuple[np.ndarray, list[Level], list[np.ndarray]]:
    """What depths ``low`` to ``DEPTH`` say of every bit (-1: never seen), and the nodes of depth ``low`` with their ``log W``.

    ``keys`` are distinct n-grams, ascending, with all of each context's extensions.
    """
    said = np.full((len(keys), 8), -1.0)
    row = np.arange(len(keys))  # of each key, at the present depth
    below: list[tuple[np.ndarray, np.ndarray]] = []
    own, counts = keys, n
    for depth in range(DEPTH, low - 1, -1):
        context, byte = own >> U(8), own & U(255)
        levels = [Level(context, byte, counts, j) for j in range(8)]
        weights = []
        for j, level in enumerate(levels):
            k = block(level.zeros, level.ones)
            if depth == DEPTH:
                weights.append(k)
                share = None
            else:
                node, w = below[j]
                up = np.searchsorted(level.node, (node >> U(16)) << U(8) | node & U(255))
                w, share = weigh(k, np.bincount(up, w, len(level.node)))
                weights.append(w)
            mine, seen = level.estimate()
            mine, seen = mine[row], seen[row]
            if share is None:
                said[:, j] = np.where(seen, mine, -1)
            else:
                a, deeper = share[level.of][row], said[:, j]
                said[:, j] = np.where(seen, np.where(deeper < 0, mine, a * mine + (1 - a) * deeper), -1)
        below = [(level.node, w) for level, w in zip(levels, weights, strict=True)]
        if depth > low:
            shorter = (own >> U(16)) << U(8) | byte  # without the byte furthest back
            own, up = np.unique(shorter, return_inverse=True)
            counts = np.bincount(up, counts, len(own)).astype(np.int64)
            row = up[row]
    return said, levels, [w for _, w in below]


class Upper:
    """Depths 1 and 0, from the sums of nodes of depth 1."""

    def __init__(self, rows: list[tuple[int, int, int, float]]):
        """``rows``: node (last byte and known bits), zeros, ones, sum of its children's ``log W``."""
        self.share, self.p = np.zeros((2, 256, 256)), np.full((2, 256, 256, 2), 0.5)
        self.seen = np.zeros((2, 256, 256), bool)
        root: dict[int, list] = {}
        for node, zeros, ones, children in rows:
            c, known = node >> 8, node & 255
            w = self._put(1, c, known, zeros, ones, children)
            at = root.setdefault(known, [0, 0, 0.0])
            at[0], at[1], at[2] = at[0] + zeros, at[1] + ones, at[2] + w
        for known, (zeros, ones, children) in root.items():
            self._put(0, 0, known, zeros, ones, children)

    def _put(self, depth: int, c: int, known: int, zeros: int, ones: int, children: float) -> float:
        w, a = weigh(block(np.array([zeros]), np.array([ones])), np.array([children]))
        self.share[depth, c, known] = a[0]
        self.p[depth, c, known] = [(zeros + 0.5) / (zeros + ones + 1), (ones + 0.5) / (zeros + ones + 1)]
        self.seen[depth, c, known] = zeros + ones > 0
        return float(w[0])

    def cost(self, keys: np.ndarray, said: np.ndarray) -> np.ndarray:
        """Bits that each n-gram's byte takes."""
        byte, last = keys & U(255), (keys >> U(8 * DEPTH) & U(255)).astype(np.int64)
        total = np.zeros(len(keys))
        for j in range(8):
            known, bit = _bits(byte, j)
            known, bit, p = known.astype(np.int64), bit.astype(np.int64), said[:, j].astype(np.float64)
            for depth, c in ((1, last), (0, np.zeros_like(last))):
                a, own = self.share[depth, c, known], self.p[depth, c, known, bit]
                p = np.where(self.seen[depth, c, known], np.where(p < 0, own, a * own + (1 - a) * p), -1)
            total -= np.log2(np.where(p < 0, 0.5, p))
        return total


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys_, counts_ = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys_, kind="stable")
    keys_, counts_ = keys_[order], counts_[order]
    new = np.ones(len(keys_), bool)
    new[1:] = keys_[1:] != keys_[:-1]
    first = np.flatnonzero(new)
    return keys_[first], np.add.reduceat(counts_, first) if len(first) else counts_


class Tally:
    """Distinct keys and their counts, gathered slice by slice."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | bool) -> None:
        """``counts``: which keys are counted, as numbers 0 and 1 (for keys whose top bit is free), or whether all are."""
        marked = not isinstance(counts, bool)
        for k in range(0, len(keys), SLICE):
            some = np.sort(keys[k : k + SLICE] << U(1) | counts[k : k + SLICE] if marked else keys[k : k + SLICE])
            new = np.ones(len(some), bool)
            new[1:] = some[1:] != some[:-1]
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(some)))
            some = some[first]
            if marked:
                some, n = some >> U(1), n * (some & U(1)).astype(np.int64)
            elif not counts:
                n = n * 0
            self.keys.append(some)
            self.counts.append(n)
            self.waiting += len(some)
        if self.waiting > 1 << 22:
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, U), np.zeros(0, np.int64)
        keys, counts = _merged(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [keys], [counts], 0
        return keys, counts


def _word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, text, _, _ = words(data, offsets)
    return hashes | WORD, text


def _asked(texts: list[tuple[pa.Array, np.ndarray]], shards: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct n-grams and words of texts, with their counts in those that are learned from, in parts by key."""
    found, named = Tally(), Tally()
    with np.errstate(over="ignore"):
        for column, own in texts:
            data, offsets = text_bytes(column)
            out, sizes = stream(data, offsets)
            found.add(grams(out, sizes), np.repeat(own, sizes).astype(U))
            keys, text = _word_keys(data, offsets)
            counts = own[text]  # a word's key has no bit left to mark what counts
            named.add(keys[counts], True)
            named.add(keys[~counts], False)
        keys, n = (np.concatenate(x) for x in zip(found.done(), named.done(), strict=True))
        shard = (mix(keys) % U(shards)).astype(np.int32)
    return [(name, keys[part], n[part]) for name, part in _parts(shard)]


def _parts(of: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The places of each number, which keep their order."""
    order = np.argsort(of, kind="stable")
    names, first = np.unique(of[order], return_index=True)
    return list(zip(names.tolist(), np.split(order, first[1:]), strict=True)) if len(of) else []


def _requests(docs: DataFrame, shards: int, batch_bytes: int) -> DataFrame:
    """Rows of texts, each with the number of its batch, and rows of what a batch asks for (``shard`` isn't null)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "text", "batch", "shard", "keys", "counts"]

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = uuid.uuid4().int >> 65
        for own in held:
            n = len(own)
            columns = [*(own.column(c) for c in names[:3]), pa.array(np.full(n, batch)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        id_type, text_type = (held[0].schema.field(c).type for c in ("doc_id", "text"))
        for shard, keys, n in _asked([(own.column("text"), ~own.column("held_out").to_numpy(zero_copy_only=False)) for own in held], shards):
            columns = [pa.nulls(1, id_type), pa.nulls(1, pa.bool_()), pa.nulls(1, text_type), pa.array([batch], pa.int64()), pa.array([shard], pa.int32())]
            columns += [pa.array([_packed(keys)], pa.binary()), pa.array([_packed(n)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, most=PIECE):
                held.append(part)
                size += part.column("text").nbytes
                if size >= batch_bytes:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return docs.mapInArrow(work, f"doc_id {kind}, held_out boolean, text string, batch long, shard int, keys binary, counts binary")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: what sorted keys and small counts share lies together and compresses."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _unpacked(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _arrays(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [_unpacked(x.as_py(), kind) for x in table.column(column)]


def _summed(requests: pa.Table, shards: int) -> pa.Table:
    """Keys of a part with their counts over all batches: one row of words (``place`` null), and n-grams by the place of their subtree."""
    shard = requests.column("shard")[0].as_py()
    keys, n = _merged(_arrays(requests, "keys", U), _arrays(requests, "counts", np.int64))
    word = keys >= WORD
    with np.errstate(over="ignore"):
        place = (mix(keys[~word] >> U(8 * (DEPTH - UPPER + 1))) % U(shards)).astype(np.int32)
    rows = [(shard, None, _packed(keys[word]), _packed(n[word]), int((n[word] > 0).sum()), int(n[word].sum()))]
    rows += [(shard, p, _packed(keys[~word][part]), _packed(n[~word][part]), 0, 0) for p, part in _parts(place)]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["shard", "place", "keys", "counts", "kinds", "total"])


#: Logarithms are summed as whole numbers, so that no order of summing shows.
_UNIT = 1024.0


def _deep(sums: pa.Table, shards: int) -> pa.Table:
    """Subtrees of a place: what they say of each n-gram, by part; and, in the first row, sums for the depth above."""
    keys, n = _merged(_arrays(sums, "keys", U), _arrays(sums, "counts", np.int64))
    said, levels, weights = subtrees(keys, n)
    node, zeros, ones, w = [], [], [], []
    for level, weight in zip(levels, weights, strict=True):
        above = (level.node >> U(16)) << U(8) | level.node & U(255)
        some, up = np.unique(above, return_inverse=True)
        add = lambda x, up=up, some=some: np.bincount(up, x, len(some)).round().astype(np.int64)
        node.append(some.astype(np.int64))
        zeros.append(add(level.zeros))
        ones.append(add(level.ones))
        w.append(add(weight * _UNIT))
    with np.errstate(over="ignore"):
        shard = (mix(keys) % U(shards)).astype(np.int32)
    parts = _parts(shard)
    blank = [None] * (len(parts) - 1)
    longs = pa.list_(pa.int64())
    columns = [pa.array([name for name, _ in parts], pa.int32())]
    columns += [pa.array([_packed(x) for x in own], pa.binary()) for own in ([keys[p] for _, p in parts], [said[p].astype(np.float32).ravel() for _, p in parts])]
    columns += [pa.array([np.concatenate(x), *blank], longs) for x in (node, zeros, ones, w)]
    return pa.table(columns, names=["shard", "keys", "said", "node", "zeros", "ones", "w"])


def _answer(requests: pa.Table, model: pa.Table, upper) -> pa.Table:
    """For each request: bits of its n-grams, counts of its words."""
    keys, values = [], []
    for i, own in enumerate(_arrays(model, "keys", U)):
        keys.append(own)
        raw = model.column("said")[i].as_py()
        if raw is None:
            values.append(_unpacked(model.column("counts")[i].as_py(), np.int64).astype(np.float64))
        else:
            values.append(upper.value.cost(own, _unpacked(raw, np.float32).reshape(-1, 8)).astype(np.float32).astype(np.float64))
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    asked = _arrays(requests, "keys", U)
    found = [values[np.searchsorted(keys, x)] for x in asked]
    split = [int((x < WORD).sum()) for x in asked]
    columns = [requests.column("batch"), requests.column("keys"), pa.array([_packed(v[:k].astype(np.float32)) for v, k in zip(found, split, strict=True)], pa.binary())]
    columns.append(pa.array([_packed(v[k:].astype(np.int64)) for v, k in zip(found, split, strict=True)], pa.binary()))
    return pa.table(columns, names=["batch", "keys", "bits", "known"])


class Lookup:
    """Values of keys in hash tables: what finds its place taken goes to the next, half as large."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        left = np.arange(len(keys))
        seed = 0
        while len(left):
            shift = U(64 - max(4, int(2 * len(left)).bit_length()))
            factor = U(0x9E3779B97F4A7C15 + 2 * seed * seed)
            at = keys[left] * factor >> shift
            own, names = np.zeros(1 << int(U(64) - shift), U), np.zeros(1 << int(U(64) - shift), values.dtype)
            own[at] = keys[left]
            placed = own[at] == keys[left]
            names[at[placed]] = values[left[placed]]
            self.tables.append((factor, shift, own, names))
            left = left[~placed]
            seed += 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Every key is known to be somewhere."""
        out = np.zeros(len(keys), self.tables[0][3].dtype if self.tables else np.float64)
        for k in range(0, len(keys), SLICE):
            part, left = keys[k : k + SLICE], None
            for factor, shift, own, names in self.tables:
                some = part if left is None else part[left]
                at = some * factor >> shift
                there = own[at] == some
                if left is None:
                    out[k : k + SLICE] = names[at]
                    left = np.flatnonzero(~there)
                else:
                    out[k + left[there]] = names[at[there]]
                    left = left[~there]
                if not len(left):
                    break
        return out


def _score(docs: pa.Table, answers: pa.Table, train: int, kinds: int, ends: int) -> pa.Table:
    keys = _arrays(answers, "keys", U)
    bits, known = _arrays(answers, "bits", np.float32), _arrays(answers, "known", np.int64)
    split = [len(x) for x in bits]
    gram = Lookup(np.concatenate([k[:s] for k, s in zip(keys, split, strict=True)]), np.concatenate(bits))
    word = Lookup(np.concatenate([k[s:] for k, s in zip(keys, split, strict=True)]), np.concatenate(known))
    out = []
    lowest = math.log10(train + 0.1 * (kinds + 1))
    with np.errstate(over="ignore"):
        for texts in (part.column("text") for batch in docs.select(["text"]).to_batches() for part in slices(batch, most=PIECE)):
            data, offsets = text_bytes(texts)
            flat, sizes = stream(data, offsets)
            cost = gram.of(grams(flat, sizes))
            total = np.add.reduceat(cost.astype(np.float64), np.cumsum(sizes) - sizes)
            names, text = _word_keys(data, offsets)
            count = word.of(names)
            n = np.bincount(text, minlength=len(texts))
            base = np.bincount(text, np.log10(count + 0.1) - lowest, len(texts)) + math.log10(ends + 0.1) - lowest
            have = np.bincount(text, count > 0, len(texts)).astype(np.int64) + int(ends > 0)
            out.append((n + 1, have, base, -total * math.log10(2), total / sizes))
    n, have, base, score, rate = (np.concatenate(x) for x in zip(*out, strict=True))
    columns = [docs.column("doc_id"), docs.column("held_out"), pa.array(n.astype(np.int64)), pa.array(have), pa.array(np.full(len(n), train, np.int64)), pa.array(base), pa.array(score), pa.array(rate)]
    return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])


def score(docs: DataFrame, scratch: Scratch, batch_bytes: int = BATCH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``, one row per input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    sizes = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("ends")).first()
    parts = 1 + (sizes["bytes"] or 0) // min(PART, batch_bytes)
    table = scratch.keep(_requests(rows, parts, batch_bytes), "requests", "zstd")
    requests = table.where("shard IS NOT NULL").select("batch", "shard", "keys", "counts")
    summed, deep = (partial(f, shards=parts) for f in (_summed, _deep))
    sums = requests.groupBy("shard").applyInArrow(lambda t: summed(t), "shard int, place int, keys binary, counts binary, kinds long, total long")
    sums = scratch.keep(sums, "sums")
    n_words = sums.agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total")).first()
    ends = sizes["ends"]
    train, kinds = (n_words["total"] or 0) + ends, (n_words["kinds"] or 0) + int(ends > 0)
    said = sums.where("place IS NOT NULL").groupBy("place").applyInArrow(
        lambda t: deep(t), "shard int, keys binary, said binary, node array<long>, zeros array<long>, ones array<long>, w array<long>"
    )
    said = scratch.keep(said, "said")
    nodes = said.where("node IS NOT NULL").select(F.explode(F.arrays_zip("node", "zeros", "ones", "w")).alias("x")).select("x.*")
    top = nodes.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "w"))).orderBy("node").collect()  # at most 256 * 255 rows
    upper = docs.sparkSession.sparkContext.broadcast(Upper([(r["node"], r["zeros"], r["ones"], r["w"] / _UNIT) for r in top]))
    model = said.select("shard", "keys", "said", F.lit(None).cast("binary").alias("counts")).unionByName(
        sums.where("place IS NULL").select("shard", "keys", F.lit(None).cast("binary").alias("said"), "counts")
    )
    answers = requests.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(lambda a, b: _answer(a, b, upper), "batch long, keys binary, bits binary, known binary")
    texts = table.where("shard IS NULL").select("doc_id", "held_out", "text", "batch")
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda a, b: _score(a, b, train, kinds, ends), schema)
