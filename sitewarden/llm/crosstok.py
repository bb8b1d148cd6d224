"""Alignment of two tokenizers over every text: groups, links, and corpus counts of linked ids.

Texts are encoded twice, as byte-level BPE (A, ``" " + text``) and as pieces
(B, which adds the space itself). A two-pointer merge of the cumulative ends of
both token lists closes a group wherever both end. A text is taken apart where
a space follows something that isn't white space: the byte-level pre-tokenizer
has a boundary there, and no piece holds a space mark behind another character
(checked when the file is read), so both lists end there and no group spans it.
What the merge gives for such a unit is remembered, within bounds.

A task emits, per batch of some 16 MB of text, its documents as counts of units
and one dictionary: the links of each unit, and in how many documents each
linked pair of ids occurs. Spark sums the pairs, takes each id's highest count
(a row per id of a vocabulary, so that table is bounded and broadcast) and
returns counts to the batches that asked, where documents add up their units.
No text is encoded twice and no occurrence is shuffled.

Defined results: a text that is null, empty, or not the same bytes as the
tokens of A or B has zeros and an empty digest, and its links count nowhere;
every row is a document of its own, repeated or with a null id; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import slices
from .tokens import _byte_letters, encoder

#: Text of a batch, units that a worker remembers, and the bytes they may take.
BATCH, UNITS, WEIGHT = 16 << 20, 250_000, 160 << 20
_SPLIT = re.compile(r"(?<=\S) ")
_LOOSE = re.compile(r"\s ")
MARK = "▁"
B_BITS = 16


def merge(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int]]:
    """Where groups of two token lists over the same bytes end: the pointer that is behind moves on, and where both ends meet a group closes."""
    closed, i, j, end_a, end_b = [], 0, 0, 0, 0
    n, m = len(a), len(b)
    while i < n or j < m:
        if end_a <= end_b:
            end_a += a_sizes[a[i]]
            i += 1
        else:
            end_b += b_sizes[b[j]]
            j += 1
        if end_a == end_b:
            closed.append((i, j))
    return closed


def _links(x: list[int], y: list[int], found: dict[int, int]) -> None:
    """Adds how often each pair of ids is linked in a group; repeated ids are counted, not paired one by one."""
    other = Counter(y).items()
    for p, n in Counter(x).items():
        for q, m in other:
            code = p << B_BITS | q
            found[code] = found.get(code, 0) + n * m


class Aligner:
    """Both encoders, and what they gave for the units met so far."""

    def __init__(self, paths: tuple[str, str]):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.a = Tokenizer.from_file(paths[0])
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        byte = {c: b for b, c in enumerate(_byte_letters())}
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.a_shown, self.b_shown = list(map(str, range(len(self.a_bytes)))), list(map(str, range(len(self.b_bytes))))
        self.apart = all(MARK not in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.b.get_piece_size()))
        self.alone = self.b.piece_to_id(MARK)
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def forget(self) -> None:
        """``sizes`` has tokens of A and B, groups and links of each unit; unit ``u`` has the pairs ``begin[u]`` to ``begin[u + 1]``."""
        self.known: dict[str, int] = {}
        self.sizes, self.begin, self.pairs, self.times = array("q"), array("q", [0]), array("I"), array("q")
        self.shown: list[str] = []
        self.good = bytearray()
        self.weight = 0

    def units(self, text: str) -> list[str]:
        """The text without its added space, cut before spaces that follow something else; each part lacks its first space."""
        if not self.apart:
            return [text]
        if not _LOOSE.search(text) and text[0] != " ":
            return text.split(" ")
        first, *rest = _SPLIT.split(f" {text}")
        return [first[1:], *rest]

    def learn(self, units: list[str]) -> None:
        """Encodes units that aren't known yet."""
        encoded_a = self.a.encode_batch_fast([f" {u}" for u in units], add_special_tokens=False)
        encoded_b = self.b.encode(units, num_threads=1)
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        a_shown, b_shown = self.a_shown, self.b_shown
        for unit, whole, y in zip(units, encoded_a, encoded_b, strict=True):
            x, y = whole.ids, y if unit else [self.alone]
            raw = f" {unit}".encode()
            good = b"".join(map(a_bytes, x)) == raw and b"".join(map(b_bytes, y)) == raw
            closed = merge(x, y, self.a_sizes, self.b_sizes) if good else []
            found: dict[int, int] = {}
            shown, i, j = [], 0, 0
            for k, m in closed:
                if k - i == 1 == m - j:
                    p, q = x[i], y[j]
                    shown.append(f"{a_shown[p]}|{b_shown[q]}")
                    code = p << B_BITS | q
                    found[code] = found.get(code, 0) + 1
                else:
                    left, right = x[i:k], y[j:m]
                    shown.append(f"{','.join([a_shown[p] for p in left])}|{','.join([b_shown[q] for q in right])}")
                    if len(left) * len(right) > 16:
                        _links(left, right, found)
                    else:
                        for p in left:
                            for q in right:
                                code = p << B_BITS | q
                                found[code] = found.get(code, 0) + 1
                i, j = k, m
            text = ";".join(shown)
            self.known[unit] = len(self.shown)
            self.shown.append(text)
            self.good.append(good)
            self.sizes.extend((len(x), len(y), len(closed), sum(found.values())))
            self.pairs.extend(found)
            self.times.extend(found.values())
            self.begin.append(len(self.pairs))
            self.weight += 300 + len(unit) + len(text) + 12 * len(found)


_KINDS = "batch long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, times binary, pairs array<long>, held array<long>, unit_begin binary, unit_pairs binary, unit_times binary"


class _Batch:
    """Documents of a batch, until it is emitted."""

    def __init__(self, aligner: Aligner, id_type: pa.DataType):
        self.aligner, self.id_type = aligner, id_type
        self.bytes, self.ids, self.rows, self.docs = 0, [], [], []

    def add(self, ids: pa.Array, texts: list[str | None], size: int) -> None:
        aligner = self.aligner
        taken = [aligner.units(t) if t else [] for t in texts]
        new = {u for units in taken for u in units} - aligner.known.keys()
        new = sorted(new)
        for k in range(0, len(new), 5_000):
            aligner.learn(new[k : k + 5_000])
        sizes = np.frombuffer(aligner.sizes, np.int64).reshape(-1, 4)
        find, good, shown = aligner.known.__getitem__, aligner.good, aligner.shown
        for units in taken:
            at = np.fromiter(map(find, units), np.int64, len(units))
            once, n = np.unique(at, return_counts=True)
            if not len(at) or not all(map(good.__getitem__, once.tolist())):
                self.rows.append((0, 0, 0, 0, ""))
                self.docs.append((at[:0].astype(np.int32), n[:0].astype(np.int32)))
                continue
            digest = hashlib.sha256(";".join(map(shown.__getitem__, at.tolist())).encode()).hexdigest()
            self.rows.append((*(n @ sizes[once]).tolist(), digest))
            self.docs.append((once.astype(np.int32), n.astype(np.int32)))
        del sizes  # the array can grow again
        self.ids.append(ids)
        self.bytes += size

    def emit(self) -> Iterator[pa.RecordBatch]:
        aligner, batch = self.aligner, uuid.uuid4().int >> 65
        every = np.concatenate([u for u, _ in self.docs]) if self.docs else np.zeros(0, np.int32)
        used = np.unique(every)
        begin, pairs, times = (np.frombuffer(x, kind) if len(x) else np.zeros(0, kind) for x, kind in ((aligner.begin, np.int64), (aligner.pairs, np.uint32), (aligner.times, np.int64)))
        first, size = begin[used], begin[used + 1] - begin[used]
        own = np.concatenate([[0], np.cumsum(size)])
        flat = np.repeat(first - own[:-1], size) + np.arange(own[-1])
        codes, at = np.unique(pairs[flat], return_inverse=True)
        at, times = at.astype(np.int32), times[flat]
        del flat, every
        held = np.zeros(len(codes), np.int64)
        for k in range(0, len(self.docs), 200):  # each document counts a pair once
            part = self.docs[k : k + 200]
            unit = np.searchsorted(used, np.concatenate([u for u, _ in part]))
            doc = np.repeat(np.arange(len(part)), [len(u) for u, _ in part])
            n = size[unit]
            if not n.sum():
                continue
            some = np.cumsum(n)
            pair = at[np.repeat(own[:-1][unit] - (some - n), n) + np.arange(some[-1])]
            both = np.unique(np.repeat(doc, n) * len(codes) + pair)
            held += np.bincount(both % len(codes), minlength=len(codes))
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], self.id_type)
        none, rows = [None] * len(ids), list(zip(*self.rows, strict=True)) or [[]] * 5
        numbers = [pa.array(x, pa.int64()) for x in rows[:4]]
        binary = lambda x: pa.array(x, pa.binary())
        longs = pa.list_(pa.int64())
        units = [np.searchsorted(used, u).astype(np.int32).tobytes() for u, _ in self.docs]
        occurs = [n.astype(np.int32).tobytes() for _, n in self.docs]
        columns = [ids, pa.array([batch] * len(ids), pa.int64()), *numbers, pa.array(rows[4], pa.string()), binary(units), binary(occurs), pa.array(none, longs), pa.array(none, longs), *[binary(none)] * 3]
        names = ["doc_id", *(x.split()[0] for x in _KINDS.split(", "))]
        for k in range(0, len(ids), 5000):
            yield pa.RecordBatch.from_arrays([c.slice(k, 5000) for c in columns], names=names)
        if len(codes):
            blank = [pa.nulls(1, c.type) for c in columns]
            blank[1] = pa.array([batch], pa.int64())
            blank[9], blank[10] = pa.array([codes.astype(np.int64)], longs), pa.array([held], longs)
            blank[11:] = [binary([x.tobytes()]) for x in (own.astype(np.int64), at.astype(np.int32), times)]
            yield pa.RecordBatch.from_arrays(blank, names=names)
        if len(aligner.shown) > UNITS or aligner.weight > WEIGHT // 2:
            aligner.forget()
        self.bytes, self.ids, self.rows, self.docs = 0, [], [], []


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents and, per batch, one of its dictionary (``pairs`` isn't null)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(Aligner, (path_a, path_b)) as aligner:
            mine = None
            for batch in batches:
                for part in slices(batch, most=1 << 20):
                    mine = mine or _Batch(aligner, part.column("doc_id").type)
                    mine.add(part.column("doc_id"), part.column("text").to_pylist(), part.column("text").nbytes)
                    if mine.bytes >= BATCH or aligner.weight > WEIGHT:
                        yield from mine.emit()
            if mine and mine.ids:
                yield from mine.emit()

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {_KINDS}")


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, n, best_a, best_b`` over the corpus: documents that hold the pair, and whether none of its A (B) id's pairs has more."""
    pairs = links.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
    counts = pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("n"))
    sides = counts.withColumn("a", F.shiftright("pair", B_BITS)).withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    for side in ("a", "b"):  # as many rows as a vocabulary has ids
        top = sides.groupBy(F.col(side).alias("of")).agg(F.max("n").alias(f"top_{side}"))
        sides = sides.join(F.broadcast(top), F.col(side) == F.col("of")).drop("of")
    return sides.selectExpr("pair", "n", "n = top_a AS best_a", "n = top_b AS best_b")


def _numbers(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of arrays in bytes, and how many each row has."""
    raw = [x.as_py() or b"" for x in column]
    return np.frombuffer(b"".join(raw), kind), np.array([len(x) // np.dtype(kind).itemsize for x in raw], np.int64)


def _totals(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a batch with the counts that came back for its pairs."""
    of = left.column("pairs").is_valid()
    docs, own = left.filter(pa.compute.invert(of)), left.filter(of)
    unit, sizes = _numbers(docs.column("units"), np.int32)
    occurs, _ = _numbers(docs.column("times"), np.int32)
    sums = np.zeros((docs.num_rows, 3), np.int64)
    if own.num_rows:
        pair = right.column("pair").to_numpy()
        order = np.argsort(pair)
        values = np.column_stack([right.column(c).to_numpy().astype(np.int64) for c in ("best_a", "best_b", "n")])[order]
        asked = own.column("pairs")[0].values.to_numpy()
        values = values[np.searchsorted(pair[order], asked)]
        begin, at, times = (np.frombuffer(own.column(c)[0].as_py(), kind) for c, kind in (("unit_begin", np.int64), ("unit_pairs", np.int32), ("unit_times", np.int64)))
        running = lambda x, ends: np.diff(np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(x, 0)])[ends], axis=0)
        per_unit = running(values[at] * times[:, None], begin)
        sums = running(per_unit[unit] * occurs[:, None].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for j, name in enumerate(("n_best", "n_best_b", "count_sum")):
        kept = kept.append_column(name, pa.array(sums[:, j]))
    return kept.append_column("groups_sha256", docs.column("groups_sha256"))


def align(docs: DataFrame, scratch: Scratch, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256``, one row per input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    links = scratch.keep(encoded(docs, path_a, path_b), "links", "zstd")
    counts = scratch.keep(pair_counts(links), "counts")
    asked = links.where("pairs IS NOT NULL").select(F.col("batch").alias("to"), F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string"
    return links.groupBy("batch").cogroup(answers.groupBy("to")).applyInArrow(_totals, schema)
