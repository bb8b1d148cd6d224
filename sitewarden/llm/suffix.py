"""Removal of every byte covered by a repeated 200-byte string, with suffix arrays.

Two equal ``LENGTH``-byte strings hold the same ``K``-byte strings, so both
choose the same one, the leftmost of smallest hash: their *anchor*. A document
is cut into runs of string starts with one anchor (about 85 bytes apart).

1. Runs are counted by the hash of their anchor. An anchor found once settles
   its run: nothing in it repeats. An anchor whose runs are all alike (by 96
   more bits over all their bytes) settles them too: everything in them repeats.
2. The runs left, at the borders of repeated passages, are compared exactly.
   One run of each kind brings its bytes, cut into blocks aligned at the
   anchor. The blocks of a batch of anchors form one sequence, whose suffix
   array is built by linear grouping (``suffix_array``). Suffixes that agree in
   ``CORE`` blocks are one class; strings of the same class are equal if the
   bytes before and after the blocks are.
3. An anchor with more than ``HOT`` kinds of runs (the border of a passage in
   very many documents) is too large for one task. Its strings are counted in a
   shuffle by 128 bits of hash, two 64-bit hashes of their bytes, and looked up
   again, so which way an anchor goes changes nothing in the result.

Documents are told apart by 96 bits of hash over id and text.

A byte-level suffix array of the corpus would need all text in one order, and
some 5 microseconds a byte in Python; the runs make it a few symbols for each
border of a repeated passage, in batches that any executor can hold.

Defined results: nulls are empty; texts shorter than ``LENGTH`` bytes keep
everything; equal rows, also under one id, repeat each other; null ids are
ordinary; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import U, mix, numbers, slices, text_bytes

LENGTH, K = 200, 32
WIDTH = LENGTH - K + 1
SEGMENT = 1 << 17  # string starts looked at together
PLACE = 20  # bits of a place in a segment
BLOCK, CORE = 32, 5
HOT = 1024
BATCH_STARTS = 1 << 16  # string starts compared at once: about 20 MB

_BYTE = numbers(256, 3)
_STEP = numbers(8, 4)


class _Ranges:
    """Hashes of byte ranges from prefix sums of ``byte * power``."""

    def __init__(self, seed: int):
        base = int(numbers(1, seed)[0])
        self.byte = numbers(256, seed + 1)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[U(1)], np.full(SEGMENT + LENGTH, U(base))]))
            self.inverse = np.cumprod(np.concatenate([[U(1)], np.full(SEGMENT + LENGTH, U(pow(base, -1, 1 << 64)))]))

    def __call__(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        prefix = np.zeros(len(data) + 1, U)
        np.cumsum(self.byte[data] * self.powers[: len(data)], out=prefix[1:])
        return mix((prefix[stop] - prefix[start]) * self.inverse[start] + (stop - start).astype(U))


_FIRST, _SECOND = _Ranges(5), _Ranges(31)


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of ``text``, whose last symbol is its one smallest.

    Suffixes are first grouped by symbol. Groups are taken in descending order;
    a member's pointer leads to the nearest earlier suffix in a smaller group.
    Suffixes that are pointed at move, out of the groups they are in, into new
    groups right above, those with more pointers higher. In the end the members
    of a group share their longest Lyndon prefix, and one ascending pass along
    the pointers emits the order inside every group.
    """
    n = len(text)
    order = np.argsort(np.array(text), kind="stable").tolist()
    at = [0] * n  # of each suffix, its place in order
    group = [0] * n  # and the first place of its group
    size = [0] * n  # of the group that begins at a place
    begin = 0
    for r, i in enumerate(order):
        if r and text[i] != text[order[r - 1]]:
            begin = r
        at[i], group[i] = r, begin
        size[begin] += 1
    before = [-1] * n
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end] if end - g == 1 else sorted(order[g:end])
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[c]:
                moved.setdefault(group[j], []).append(j)
            for q, some in moved.items():
                if len(some) == size[q]:
                    continue  # the whole group: it stays where it is
                for j in some:
                    size[q] -= 1
                    last = q + size[q]
                    other = order[last]
                    order[at[j]], at[other] = other, at[j]
                    order[last], at[j] = j, last
                first = q + size[q]
                size[first] = len(some)
                for j in some:
                    group[j] = first
        end = g
    free, done = list(range(n)), [False] * n
    out = [0] * n
    out[0], done[n - 1] = n - 1, True
    for r in range(n):
        i = out[r] - 1
        while i >= 0 and not done[i]:
            done[i] = True
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            i = before[i]
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of every run: text, first start in it, starts, anchor after the first start, hash of anchor and two of the run."""
    valid = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    valid[offsets[:-1][long]] += 1
    valid[offsets[1:][long] - LENGTH + 1] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    for s in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[s : s + SEGMENT + LENGTH - 1]
        ok = valid[s : s + len(part) - LENGTH + 1]
        if not ok.any():
            continue
        h = _BYTE[part]
        reach = 1
        while reach < K:
            h = h[:-reach] * _STEP[reach.bit_length()] + h[reach:]
            reach *= 2
        h = mix(h)
        low = ((h >> U(PLACE)) << U(PLACE)) | np.arange(len(h), dtype=U)
        reach = 1
        while reach * 2 <= WIDTH:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (WIDTH - reach)], low[WIDTH - reach :])
        anchor = (low & U((1 << PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])]))
        stop = np.append(new[1:], len(anchor))
        some = ok[new]
        new, stop = new[some], stop[some]
        a = anchor[new]
        whole, other = (ranges(part, new, stop + LENGTH - 1) for ranges in (_FIRST, _SECOND))
        text = np.searchsorted(offsets, new + s, "right") - 1
        yield text, new + s - offsets[text], stop - new, a - new, h[a], mix(whole * _STEP[0] + (a - new).astype(U)), (other >> U(32)).astype(np.uint32)


def runs(docs: DataFrame) -> DataFrame:
    """``anchor, kind, kind2, doc, doc2, start, n, at``: the runs of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    doc, doc2 = part.column("doc").to_numpy(), part.column("doc2").to_numpy()
                    for text, start, n, at, anchor, kind, kind2 in _runs(*text_bytes(part.column("text"))):
                        columns = [anchor.view(np.int64), kind.view(np.int64), kind2.view(np.int32), doc[text], doc2[text]]
                        columns += [start.astype(np.int64), n.astype(np.int16), at.astype(np.int16)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["anchor", "kind", "kind2", "doc", "doc2", "start", "n", "at"]
    return keyed(docs).select("doc", "doc2", "text").mapInArrow(
        work, "anchor long, kind long, kind2 int, doc long, doc2 int, start long, n short, at short"
    )


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(F.col("doc_id"), text).alias("doc"), F.hash(text, F.col("doc_id")).alias("doc2"))


def _intervals(hit: np.ndarray, run: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged stretches of string starts: run, first and last start. Input in order of run and place."""
    run, place = run[hit], place[hit]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)]) if len(run) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(run)) - 1 if len(first) else first
    return run[first], place[first], place[last]


def _starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and place of every string start of runs with ``n`` starts."""
    run = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return run, np.arange(len(run), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)


def repeated_starts(group: np.ndarray, pieces: list[bytes], at: np.ndarray, n: np.ndarray, copies: np.ndarray):
    """Run and place of the string starts that occur twice or more within a group of runs.

    ``pieces`` are the bytes of the runs, ``at`` their anchors, ``copies`` how
    often each occurs.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    at, n = at.astype(np.int32), n.astype(np.int32)
    sizes = np.array([len(p) for p in pieces], np.int32)
    base = (np.cumsum(sizes) - sizes).astype(np.int32)
    lead = at % BLOCK  # the first aligned block begins here
    blocks = (sizes - lead) // BLOCK
    run, k = _starts(blocks)
    where = base[run] + lead[run] + k * BLOCK
    rows = np.zeros((len(run), BLOCK + 16), np.uint8)
    rows[:, :8] = np.ascontiguousarray(group[run].astype(np.int64)).view(np.uint8).reshape(-1, 8)
    rows[:, 8:16] = np.ascontiguousarray((k - at[run] // BLOCK).astype(np.int64)).view(np.uint8).reshape(-1, 8)
    for j in range(BLOCK):
        rows[:, 16 + j] = data[where + j]
    _, symbol = np.unique(rows.view(np.dtype((np.void, BLOCK + 16))).ravel(), return_inverse=True)
    # each run closes with a symbol of its own, below all others; the very last is the smallest
    closed = np.cumsum(blocks + 1)
    sequence = np.zeros(int(closed[-1]), np.int64)
    place = np.arange(len(run)) + run
    sequence[place] = symbol.ravel() + len(pieces) + 1
    sequence[closed - 1] = len(pieces) - 1 - np.arange(len(pieces))
    order = np.array(suffix_array(sequence.tolist()))
    padded = np.concatenate([sequence, np.full(CORE, -1)])
    alike = np.ones(len(order) - 1, bool)
    for j in range(CORE):
        alike &= padded[order[1:] + j] == padded[order[:-1] + j]
    number = np.cumsum(np.concatenate([[0], ~alike]))
    of = np.empty(len(order), np.int64)
    of[order] = number
    many = np.bincount(number)[of] > 1
    # every string start: the first aligned block at or after it, and the bytes around the core
    r, p = _starts(n)
    first = np.maximum(0, -(-(p - lead[r]) // BLOCK))
    core = (closed - blocks - 1)[r] + first
    weight = copies[r]
    may = many[core]
    r, p, first, core, weight = r[may], p[may], first[may], core[may], weight[may]
    if not len(r):
        return r, p
    f = lead[r] + first * BLOCK - p
    around = LENGTH - CORE * BLOCK
    begin = base[r] + p
    keys = np.zeros((len(r), 16 + around), np.uint8)
    keys[:, :8] = np.ascontiguousarray(of[core]).view(np.uint8).reshape(-1, 8)
    keys[:, 8:16] = np.ascontiguousarray(f.astype(np.int64)).view(np.uint8).reshape(-1, 8)
    for j in range(around):  # byte by byte: no table of places is built
        keys[:, 16 + j] = data[begin + np.where(j < f, j, j + CORE * BLOCK)]
    _, which = np.unique(keys.view(np.dtype((np.void, keys.shape[1]))).ravel(), return_inverse=True)
    hit = np.bincount(which.ravel(), weight)[which.ravel()] > 1
    return r[hit], p[hit]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``anchor, doc, doc2, start, n, at, copies, piece``, sorted by anchor: the repeated intervals of single runs.

    Whole anchors are compared, as many at once as have ``BATCH_STARTS`` string starts.
    """
    names = ["doc", "doc2", "begin", "end"]

    def settle(rows: pa.Table) -> pa.RecordBatch:
        group, start, n, at, copies = (rows.column(c).to_numpy().astype(np.int64) for c in ("anchor", "start", "n", "at", "copies"))
        run, place = repeated_starts(group, rows.column("piece").to_pylist(), at, n, copies)
        run, first, last = _intervals(copies[run] == 1, run, place)
        doc, doc2 = rows.column("doc").to_numpy()[run], rows.column("doc2").to_numpy()[run]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, doc2, start[run] + first, start[run] + last + LENGTH)], names=names)

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        anchors, n = held.column("anchor").to_numpy(), held.column("n").to_numpy().astype(np.int64)
        edge = np.append(np.flatnonzero(np.diff(anchors)) + 1, len(anchors))
        upto, begin, base = np.cumsum(n)[edge - 1], 0, 0
        for end, starts in zip(edge[:-1].tolist(), upto.tolist(), strict=False):  # the last anchor may go on
            if starts - base >= BATCH_STARTS:
                yield settle(held.slice(begin, end - begin))
                begin, base = end, starts
        held = held.slice(begin).combine_chunks()
    if held is not None and held.num_rows:
        yield settle(held)


def strings(hot: DataFrame) -> DataFrame:
    """``h1, h2, doc, doc2, place, copies``: every string of hot runs by two hashes of its bytes."""
    string = F.expr(f"substring(piece, cast(i + 1 as int), {LENGTH})")
    each = hot.select("doc", "doc2", "start", "copies", "piece", F.explode(F.expr("sequence(0, n - 1)")).alias("i")).withColumn("s", string)
    return each.select(
        F.xxhash64(F.lit(1), "s").alias("h1"), F.xxhash64(F.lit(2), "s").alias("h2"), "doc", "doc2", (F.col("start") + F.col("i")).alias("place"), "copies"
    )


def repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, doc2, begin, end``: repeated byte ranges; those of a document may overlap."""
    found = scratch.keep(runs(docs), "runs")
    sides = [f(c).alias(f"{n}_{c}") for c in ("kind", "kind2") for n, f in (("lo", F.min), ("hi", F.max))]
    anchors = scratch.keep(
        found.groupBy(F.col("anchor").alias("k"))
        .agg(F.count(F.lit(1)).alias("m"), *sides)
        .where("m > 1")
        .selectExpr("k", "lo_kind = hi_kind AND lo_kind2 = hi_kind2 AS same"),
        "anchors",
    )
    shared = scratch.keep(found.join(anchors, F.col("anchor") == F.col("k")).drop("k"), "shared")
    scratch.drop("runs", "anchors")
    whole = F.col("start").alias("begin"), (F.col("start") + F.col("n") + LENGTH - 1).alias("end")
    out = shared.where("same").select("doc", "doc2", *whole)
    mixed = shared.where("NOT same").drop("same")
    one = F.min(F.struct("doc", "doc2", "start", "n", "at")).alias("one")
    kinds = scratch.keep(
        mixed.groupBy(F.col("anchor").alias("k"), F.col("kind").alias("kk"), F.col("kind2").alias("kk2"))
        .agg(F.count(F.lit(1)).alias("copies"), one)
        .select("k", "kk", "kk2", "copies", "one.*"),
        "kinds",
    )
    copied = kinds.where("copies > 1").select("k", "kk", "kk2")
    alike = (F.col("anchor") == F.col("k")) & (F.col("kind") == F.col("kk")) & (F.col("kind2") == F.col("kk2"))
    out = out.unionAll(mixed.join(copied, alike).select("doc", "doc2", *whole))
    load = scratch.keep(kinds.groupBy(F.col("k").alias("lk")).agg(F.count(F.lit(1)).alias("load")), "load")
    wanted = kinds.join(load, F.col("k") == F.col("lk")).select(
        F.col("k").alias("anchor"), F.col("doc").alias("wd"), F.col("doc2").alias("wd2"), "start", "n", "at", "copies", (F.col("load") > HOT).alias("hot")
    )
    # each document brings its pieces: one row per document that has any
    per_doc = wanted.groupBy("wd", "wd2").agg(F.collect_list(F.struct("anchor", "start", "n", "at", "copies", "hot")).alias("want"))
    texts = keyed(docs).select("doc", "doc2", F.encode("text", "utf-8").alias("bytes"))
    own = (F.col("wd") == F.col("doc")) & (F.col("wd2") == F.col("doc2"))
    pieces = per_doc.hint("merge").join(texts, own).select("doc", "doc2", "bytes", F.explode("want").alias("w"))
    pieces = pieces.select(
        "w.*", "doc", "doc2", F.expr(f"substring(bytes, cast(w.start + 1 as int), cast(w.n + {LENGTH - 1} as int))").alias("piece")
    )
    pieces = scratch.keep(pieces.dropDuplicates(["anchor", "doc", "doc2", "start"]), "pieces")
    scratch.drop("load")
    cold = pieces.where("NOT hot").drop("hot")
    out = out.unionAll(
        cold.repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(_compare, "doc long, doc2 int, begin long, end long")
    )
    hot = pieces.where("hot")
    if not hot.isEmpty():
        every = scratch.keep(strings(hot), "strings")
        twice = every.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.sum("copies").alias("m")).where("m > 1").select("k1", "k2")
        twice = scratch.keep(twice, "twice")
        out = out.unionAll(
            every.join(twice, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
            .where("copies = 1")
            .select("doc", "doc2", F.col("place").alias("begin"), (F.col("place") + LENGTH).alias("end"))
        )
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the ranges of each document and keeps the other bytes."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part in slices(batch, "bytes"):
            spans, kept, sizes = [], [], []
            for data, ranges in zip(part.column("bytes"), part.column("ranges").to_pylist(), strict=True):
                data = data.as_py()
                merged: list[list[int]] = []
                for r in sorted((r["begin"], r["end"]) for r in ranges or []):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                spans.append([{"begin": a, "end": b} for a, b in merged])
                edges = [0, *(x for m in merged for x in m), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if merged else data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed byte ranges and the bytes that stay, for every row."""
    ranges = repeated(docs, scratch).groupBy(F.col("doc").alias("rd"), F.col("doc2").alias("rd2")).agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))  # equal rows share a key: each range once
    ranges = scratch.keep(ranges, "ranges")
    scratch.drop("shared", "kinds", "pieces", "strings", "twice")
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = (F.col("doc") == F.col("rd")) & (F.col("doc2") == F.col("rd2"))
    both = keyed(docs).join(ranges.hint("merge"), own, "left")
    return both.select("doc_id", F.encode("text", "utf-8").alias("bytes"), "ranges").mapInArrow(
        _spans, f"doc_id {kind}, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"
    )
