"""Packing token sequences into windows by non-negative least squares.

Documents are encoded and cut at the window: whole windows stand alone, and
what remains of a document is a piece shorter than the window. Piece lengths
are counted in ``STEP``-token classes, shallow combinations of at most three
classes that fill a window exactly are enumerated, and non-negative least
squares gives how often to use each so that the histogram is met. Rounded
down, the counts are packed; the pieces left over are cut greedily into the
gaps of those windows and then into windows of their own. What is left at the
very end of a partition goes into windows whose lengths are powers of two,
which need no padding.

A task packs the documents of its own partition in shards of ``SHARD`` tokens,
so there is no shuffle, memory is bounded by a shard and one document, and a
lost task is packed again alike. The leftover of a shard joins the next one.

Defined results: a null or empty text is the closing id alone; repeated rows
and null ids are documents like any other; an empty table has no pieces; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import WordEncoder, encoder

WINDOW = 2048
STEP = 64
SHARD = 1 << 21
CLOSING = 1


def combinations(classes: int) -> np.ndarray:
    """Every multiset of one to three classes whose sum is ``classes``, as columns."""
    found = [(classes,)]
    found += [(a, classes - a) for a in range(1, classes // 2 + 1)]
    found += [(a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    out = np.zeros((classes, len(found)))
    for j, combo in enumerate(found):
        for c in combo:
            out[c - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """``argmin |a x - b|`` over ``x >= 0`` by the active-set method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= 1e-9 * (1 + np.abs(b).max()):
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            best = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if best.min() > 0:
                x[:] = 0
                x[at] = best
                break
            low = best <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - best[low], 1e-300))
            x[at] += step * (best - x[at])
            free[at[low & (x[at] <= 1e-12)]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(lengths: list[int], window: int = WINDOW, step: int = STEP) -> tuple[list[list[int]], list[int]]:
    """Windows (lists of piece numbers) that fit by class, and the pieces left over."""
    classes = window // step
    of = [(n + step - 1) // step for n in lengths]
    stacks: list[list[int]] = [[] for _ in range(classes + 1)]
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):  # the longest of a class go first
        stacks[of[i]].append(i)
    columns = combinations(classes)
    counts = np.floor(nnls(columns, np.array([len(s) for s in stacks[1:]], float)) + 1e-9).astype(int)
    windows = []
    for j in np.argsort(-counts, kind="stable"):
        need = [(c + 1, int(k)) for c, k in enumerate(columns[:, j]) if k]
        for _ in range(counts[j]):
            if any(len(stacks[c]) < k for c, k in need):
                break
            windows.append([stacks[c].pop() for c, k in need for _ in range(k)])
    rest = [i for s in stacks for i in s]
    gaps = sum(window - sum(lengths[i] for i in w) for w in windows)
    have = sum(lengths[i] for i in rest)
    while windows and have < gaps:  # too little to fill the gaps: a window gives its pieces back
        last = windows.pop()
        used = sum(lengths[i] for i in last)
        gaps, have = gaps - (window - used), have + used
        rest += last
    return windows, sorted(rest, key=lambda i: -lengths[i])


class Packer:
    """Takes documents, gives pieces ``(doc, start, length, window, offset)``.

    ``doc`` numbers the documents as they came; windows are numbered from 0.
    """

    def __init__(self, window: int = WINDOW):
        self.window, self.n, self.held = window, 0, []

    def _next(self) -> int:
        self.n += 1
        return self.n - 1

    def shard(self, docs: list[tuple[int, int]], last: bool) -> list[tuple[int, int, int, int, int]]:
        """``docs``: number and length. ``last``: nothing may be held back."""
        out, pieces = [], self.held
        for doc, n in docs:
            whole = n // self.window * self.window
            out += [(doc, s, self.window, self._next(), 0) for s in range(0, whole, self.window)]
            if n > whole:
                pieces.append((doc, whole, n - whole))
        windows, rest = plan([p[2] for p in pieces], self.window)
        left = [pieces[i] for i in reversed(rest)]  # taken from the end: the longest first

        def take(room: int, w: int, at: int) -> None:
            while room and left:
                doc, start, n = left.pop()
                used = min(n, room)
                out.append((doc, start, used, w, at))
                if n > used:
                    left.append((doc, start + used, n - used))
                room, at = room - used, at + used

        for members in windows:
            w, at = self._next(), 0
            for i in members:
                doc, start, n = pieces[i]
                out.append((doc, start, n, w, at))
                at += n
            take(self.window - at, w, at)
        remaining = sum(p[2] for p in left)
        while remaining >= self.window:
            take(self.window, self._next(), 0)
            remaining -= self.window
        if last:
            for power in reversed(range(self.window.bit_length())):
                if remaining >> power & 1:
                    take(1 << power, self._next(), 0)
        self.held = left
        return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, closing: int = CLOSING) -> DataFrame:
    """One row per piece; ``ids`` holds its ids as little-endian 32-bit numbers.

    Columns: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(WordEncoder, path) as words:
            yield from packed(batches, words)

    def packed(batches: Iterator[pa.RecordBatch], words: WordEncoder) -> Iterator[pa.RecordBatch]:
        packer = Packer(window)
        base = TaskContext.get().partitionId() << 36
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        known: dict[int, tuple] = {}  # number -> id and ids, of documents that are not packed yet
        fresh: list[tuple[int, int]] = []
        count = tokens = 0
        id_arrow = None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal fresh, tokens
            pieces = packer.shard(fresh, last)
            for i in range(0, len(pieces), 20_000):
                part = pieces[i : i + 20_000]
                columns = [
                    pa.array([known[d][0] for d, *_ in part], id_arrow),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([known[d][1][s : s + n].tobytes() for d, s, n, _, _ in part], pa.binary()),
                    pa.array([len(known[d][1]) for d, *_ in part], pa.int64()),
                    pa.array([base + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            held = {p[0] for p in packer.held}
            for d in [d for d in known if d not in held]:
                del known[d]
            fresh, tokens = [], 0

        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, sizes = words.encode([t or "" for t in some.column("text").to_pylist()], closing)
                ids, end = ids.astype("<u4"), 0
                for doc_id, n in zip(some.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                    known[count] = (doc_id, ids[end : end + n])
                    fresh.append((count, n))
                    count, end = count + 1, end + n
                tokens += end
                if tokens >= SHARD:
                    yield from flush(False)
        if id_arrow is not None:
            yield from flush(True)

    schema = f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(work, schema)
