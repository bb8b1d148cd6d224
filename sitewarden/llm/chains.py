"""Fuzzy repeated passages by collinear chaining (substring dedup).

1. Seeds are minimizers: of every ``SPAN`` consecutive hashed ``K``-word strings
   the one of smallest hash. Passages that agree in ``K + SPAN - 1`` words in a
   row share one.
2. A seed found in several documents ties each of them to the first document
   (smallest id) that has it, so a passage that very many documents share gives
   one pair per document, not one per pair of documents.
   Every window of ``LEAST`` words is tied, too, to the first document that has
   it, so an exact repeat counts even where its seeds lead to other documents.
   Windows go in runs that share their smallest ``WIDE``-word string; only runs
   whose string occurs in runs of several kinds are looked at window by window.
3. The matches of a pair are chained: in order of place, a Fenwick tree over
   the other document's places gives the best chain to go on from, where gaps
   cost ``GAP`` per skipped word of either side. A chain has two matches at
   least: ``LEAST`` equal words in a row hold two seeds, as two disjoint runs
   of ``K + SPAN - 1`` words fit in them.
4. Chains are cut at gaps of over ``APART`` words and aligned on the words
   themselves: seeds and like gaps word by word, other gaps by edit distance,
   and both ends are extended by the best alignment of ``FLANK`` words of
   either side, all chains of a batch at once. Every stretch of the alignment that spans ``LEAST`` words with
   enough of them equal is a passage by itself, whatever lies beside it.
5. Seeds that lie in no passage then are tied again, to every earlier document
   that has them, and step 3 and 4 run on these ties: the parts of a passage may
   occur in earlier documents that have nothing else of it. As a chain takes
   two seeds, those of more than ``FEW`` documents, such as those of a common
   line, are looked up by twos that a chain may join (other seeds of few
   documents among them), and never by one alone. The documents of a two are
   compared in tiles, each open one with every earlier one; a pair is left out only if the words
   around the seeds can't hold a stretch of ``LEAST`` words with enough of them
   equal, in whatever order. Twos that more than ``SIDE`` documents have, such as
   those of a common line, are looked up together with a rare word around: of two
   stretches of ``n`` words that make a passage, the rarest word they share is
   among the ``(1 - SHARE) * n + 1`` rarest of both, as what is rarer is lacking on
   the other side. So documents that share the line only don't meet. A key
   that still has very many documents is cut into tiles: its time grows with their
   square, its memory doesn't.
6. Every passage is reported. ``inner`` marks those whose words all lie within
   a passage that the same document shares with an earlier document yet: of
   near copies, each names as many others as their first one has words changed,
   and without the inner ones what is covered of a document stays the same.

Words are compared by 64-bit hash, ASCII letters in lower case.

Defined results: null and short texts have no passages; rows that share an id
are one document to the pairing (passages within it are not reported); rows
with a null id are left out, as a pair could not name them; other columns are
ignored; repeated rows give no passage twice. Ids must be numbers or strings
that Spark can cast to ``long``.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import U, mix, numbers, slices, smallest, text_bytes, words

K, SPAN = 6, 6
GAP = 0.05
LEAST = 40
WIDE = 20  # words of the string that windows of LEAST words are found by
SHARE = 0.8  # of the longer side's words that must be equal
FLANK = LEAST  # words beyond a chain's ends that it may be extended by
APART = 64  # words of either side without a seed that a chain may hold
WANTS = 256
FEW = 16  # documents of a seed that are tied to each other without a look at the words around it
SIDE = 1 << 12  # documents of a seed on either side of a tile
LISTED = 64  # rows of a tile whose pairs are listed all at once
COMMON = 1 << 15  # words that are told apart by how often they occur around seeds
BITS = 1 << 11  # of the sketch of the words around a seed
BLOCK = 8  # words around a seed that are counted together at first
SCHEMA = "doc_id long, other_doc_id long, start long, end long, other_start long, other_end long, n_equal long"
_STEP = int(numbers(1, 21)[0])


def _seeds(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the row of all words) of the seeds, and their hashes."""
    n = len(hashes) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    grams = hashes[:n].copy()
    for j in range(1, K):
        grams = grams * U(_STEP) + hashes[j : j + n]
    grams = mix(grams)
    inside = text[:n] == text[K - 1 : K - 1 + n]
    rank = np.where(inside, grams >> U(1), U(0xFFFFFFFFFFFFFFFF))
    best = smallest(rank, SPAN)
    reach = len(best)
    best = best[inside[:reach] & inside[SPAN - 1 : SPAN - 1 + reach] & (text[:reach] == text[SPAN - 1 : SPAN - 1 + reach])]
    best = best[np.diff(best, prepend=-1) > 0]
    return best, grams[best]


def _first(*keys: np.ndarray) -> np.ndarray:
    """Whether a row is the first with its keys."""
    order = np.lexsort(keys[::-1])
    first = np.ones(len(order), bool)
    first[order[1:]] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return first


def seeds(docs: DataFrame) -> DataFrame:
    """``seed, doc, place, first``: ``first`` where the document has the seed for the first time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    data, offsets = text_bytes(part.column("text"))
                    hashes, text, _, _ = words(data, offsets)
                    place, seed = _seeds(hashes, text)
                    of = text[place] if len(place) else place
                    begin = np.searchsorted(text, np.arange(part.num_rows))
                    first = _first(of, seed)
                    doc = part.column("doc_id").to_numpy(zero_copy_only=False)
                    columns = [pa.array(seed.view(np.int64)), pa.array(doc[of], pa.int64()), pa.array((place - begin[of]).astype(np.int32)), pa.array(first)]
                    yield pa.RecordBatch.from_arrays(columns, names=["seed", "doc", "place", "first"])

    return _texts(docs).mapInArrow(work, "seed long, doc long, place int, first boolean")


def _whole(batches: Iterator[pa.RecordBatch], least: int, *names: str) -> Iterator[pa.Table]:
    """Rows in order of ``names`` as tables of about ``least`` rows that end where these change."""
    held: list[pa.RecordBatch] = []
    count, enough = 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= enough:
            rows = pa.Table.from_batches(held)
            last = np.logical_and.reduce([(c := rows.column(n).to_numpy()) == c[-1] for n in names])
            whole = int(np.searchsorted(last, True))
            if whole:
                yield rows.slice(0, whole).combine_chunks()
            held, count = rows.slice(whole).combine_chunks().to_batches(), rows.num_rows - whole
            enough = max(least, 2 * count)
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where rows in order of ``keys`` begin with others, and where they end."""
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in keys])
    return np.flatnonzero(np.concatenate([[True], new, [True]]))


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of seed: those of seeds of several documents, with the first of these, its first place and their number."""
    for rows in _whole(batches, 100_000, "seed"):
        seed, doc, place, first = (rows.column(c).to_numpy() for c in ("seed", "doc", "place", "first"))
        edge = _edges(seed)
        several = np.repeat(np.diff(edge) > 1, np.diff(edge))
        seed, doc, place, first = (c[several] for c in (seed, doc, place, first))
        if not len(seed):
            continue
        order = np.lexsort((place, doc, seed))
        seed, doc, place, first = seed[order], doc[order], place[order], first[order]
        edge = _edges(seed)
        begin, size = edge[:-1], np.diff(edge)
        keep = np.repeat(doc[begin] < doc[edge[1:] - 1], size)
        n = np.add.reduceat(first, begin, dtype=np.int32)
        columns = [seed, doc, place, first, *(np.repeat(c, size) for c in (doc[begin], place[begin], n))]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["seed", "doc", "place", "first", "hub", "there", "n"])


def _strings(hashes: np.ndarray, *sizes: int) -> Iterator[np.ndarray]:
    """Hashes of all strings of so many words, for each of ``sizes``."""
    powers, n = {1: hashes}, 1
    while 2 * n <= max(sizes):
        grams = powers[n]
        powers[2 * n] = mix(grams[: max(0, len(grams) - n)] * U(_STEP) + grams[n:])
        n *= 2
    for size in sizes:
        most = max(0, len(hashes) - size + 1)
        out, at = np.zeros(most, U), 0
        for k in sorted(powers, reverse=True):
            if size - at >= k:
                out, at = mix(out * U(_STEP) + powers[k][at : at + most]), at + k
        yield out


def _runs(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of ``LEAST``-word windows whose smallest ``WIDE``-word string is the same one.

    That string's hash, the first window's place, how many windows, and two hashes of all words of the run.
    """
    count = len(hashes) - LEAST + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, none.astype(U), none.astype(np.uint32)
    grams, windows = _strings(hashes, WIDE, LEAST)
    best = smallest(grams, LEAST - WIDE + 1)
    place = np.flatnonzero(text[:count] == text[LEAST - 1 :])
    best = best[place]
    new = np.ones(len(place), bool)
    new[1:] = (best[1:] != best[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(place)))
    # the first and the last window of a run hold all its words, as it has LEAST - WIDE + 1 windows at most
    first, last = windows[place[begin]], windows[place[begin] + n - 1] if len(n) else windows[:0]
    return grams[best[begin]], place[begin], n, mix(first * U(_STEP) + last), (mix(last * U(_STEP) + first + n.astype(U)) >> U(32)).astype(np.uint32)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def runs(docs: DataFrame) -> DataFrame:
    """``gram, kind, kind2, doc, place, n``: every window of ``LEAST`` words, in runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    data, offsets = text_bytes(part.column("text"))
                    hashes, text, _, _ = words(data, offsets)
                    gram, place, n, kind, kind2 = _runs(hashes, text)
                    of = text[place] if len(place) else place
                    begin = np.searchsorted(text, np.arange(part.num_rows))
                    doc = part.column("doc_id").to_numpy(zero_copy_only=False)
                    columns = [gram.view(np.int64), kind.view(np.int64), kind2.view(np.int32), doc[of].astype(np.int64), (place - begin[of]).astype(np.int32), n.astype(np.int16)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "kind", "kind2", "doc", "place", "n"])

    return _texts(docs).mapInArrow(work, "gram long, kind long, kind2 int, doc long, place int, n short")


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of their string: those that an earlier document has, with the first that has it; where runs of a string differ, each kind once as a ``want``."""
    for rows in _whole(batches, 100_000, "gram"):
        gram, kind, kind2, doc, place, n = (rows.column(c).to_numpy() for c in ("gram", "kind", "kind2", "doc", "place", "n"))
        edge = _edges(gram)
        several = np.repeat(np.minimum.reduceat(doc, edge[:-1]) < np.maximum.reduceat(doc, edge[:-1]), np.diff(edge))
        gram, kind, kind2, doc, place, n = (c[several] for c in (gram, kind, kind2, doc, place, n))
        if not len(gram):
            continue
        order = np.lexsort((place, doc, kind2, kind, gram))
        gram, kind, kind2, doc, place, n = (c[order] for c in (gram, kind, kind2, doc, place, n))
        edge = _edges(gram)
        last = edge[1:] - 1
        same = np.repeat((kind[edge[:-1]] == kind[last]) & (np.minimum.reduceat(kind2, edge[:-1]) == np.maximum.reduceat(kind2, edge[:-1])), np.diff(edge))
        edge = _edges(gram, kind, kind2)
        begin, of = edge[:-1], np.repeat(edge[:-1], np.diff(edge))
        tied = np.flatnonzero(doc != doc[of])
        want = begin[~same[begin]]
        at, to = np.concatenate([tied, want]), np.concatenate([of[tied], want])
        columns = [np.arange(len(at)) >= len(tied), gram[at], doc[at], doc[to], place[at], place[to], n[at]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["want", "gram", "doc", "hub", "place", "there", "n"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc, text, want``: the windows of the wanted runs."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column("text"))
                hashes, text, _, _ = words(data, offsets)
                windows = next(_strings(hashes, LEAST))
                want = part.column("want")
                flat, of = want.flatten(), np.repeat(np.arange(part.num_rows), want.value_lengths().to_numpy())
                gram, place, n = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
                begin = np.searchsorted(text, np.arange(part.num_rows + 1))
                ok = begin[of] + place + n - 1 + LEAST <= begin[of + 1]  # else they are another row's of that id
                gram, place, n, of = gram[ok], place[ok], n[ok], of[ok]
                run = np.repeat(np.arange(len(n)), n)
                at = place[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                doc = part.column("doc").to_numpy()
                gram, window = gram[run], windows[begin[of[run]] + at].view(np.int64)
                order = np.argsort(at, kind="stable")  # a document may bring several runs of one string
                first = np.empty(len(at), bool)
                first[order] = _first(of[run][order], gram[order], window[order])
                columns = [gram, window, doc[of[run]], at.astype(np.int32), first]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "window", "doc", "place", "first"])


def _window_ties(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, hub, place, there``: both ends of every window of ``LEAST`` words, tied to the first document that has it.

    A run is tied to the first document that has all of it. Where runs of one
    string differ, the first document of each is tied window by window.
    """
    found = runs(docs).repartition(F.col("gram")).sortWithinPartitions("gram")
    kinds = scratch.keep(found.mapInArrow(_kinds, "want boolean, gram long, doc long, hub long, place int, there int, n short"), "kinds")
    whole = kinds.where("NOT want").select("doc", "hub", "place", "there", (F.col("n") - 1).alias("more"))
    want = kinds.where("want").groupBy("doc").agg(F.collect_list(F.struct("gram", "there", "n")).alias("want"))
    wanted = want.hint("merge").join(_texts(docs), F.col("doc") == F.col("doc_id")).select("doc", "text", "want")
    each = scratch.keep(wanted.mapInArrow(_windows, "gram long, window long, doc long, place int, first boolean"), "windows")
    low = [F.min("doc").alias("hub"), F.max("doc").alias("top"), F.min_by("place", F.when(F.col("first"), F.col("doc"))).alias("there")]
    hubs = each.groupBy(F.col("gram").alias("g"), F.col("window").alias("w")).agg(*low).where("hub < top").drop("top")
    tied = each.hint("merge").join(hubs.hint("merge"), (F.col("gram") == F.col("g")) & (F.col("window") == F.col("w")))
    ties = tied.select("doc", "hub", "place", "there", F.lit(0).alias("more")).unionAll(whole).where("doc <> hub")
    # one row for the windows of a diagonal that begin within LEAST words
    ties = ties.groupBy("doc", "hub", (F.col("there") - F.col("place")).alias("by"), F.floor(F.col("place") / LEAST).alias("near"))
    ties = ties.agg(F.min("place").alias("a"), F.max(F.col("place") + F.col("more") + LEAST - K).alias("z"))
    middle = F.array("a", F.least(F.col("a") + LEAST - K, F.col("z")), "z")
    ties = ties.select("doc", "hub", F.explode(F.array_distinct(middle)).alias("place"), "by")
    ties = scratch.keep(ties.select("doc", "hub", "place", (F.col("place") + F.col("by")).cast("int").alias("there")), "ties")
    scratch.drop("kinds", "windows")
    return ties


def chain(x: list[int], y: list[int]) -> list[list[int]]:
    """Chains of matches ``(x[i], y[i])``, sorted by ``x``; the best first, no match in two."""
    rank = {v: r for r, v in enumerate(sorted(set(y)), 1)}
    n = len(rank)
    tree: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)
    value, back = [0.0] * len(x), [-1] * len(x)
    i = 0
    while i < len(x):
        stop = i
        while stop < len(x) and x[stop] == x[i]:
            stop += 1
        for j in range(i, stop):  # matches at one place can't follow each other
            best, r = (0.0, -1), rank[y[j]] - 1
            while r:
                if tree[r] > best:
                    best = tree[r]
                r &= r - 1
            reach = best[0] - GAP * (x[j] + y[j])
            if best[1] >= 0 and reach > 0:
                value[j], back[j] = K + reach, best[1]
            else:
                value[j] = float(K)
        for j in range(i, stop):
            entry, r = (value[j] + GAP * (x[j] + y[j]), j), rank[y[j]]
            while r <= n:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = stop
    used, out = [False] * len(x), []
    for j in sorted(range(len(x)), key=lambda j: (-value[j], j)):
        links = []
        while j >= 0 and not used[j]:
            used[j] = True
            links.append(j)
            j = back[j]
        if links:
            out.append(links[::-1])
    return out


def _close(links: list[int], x: list[int], y: list[int]) -> Iterator[list[int]]:
    """A chain cut where no seed holds it together for over ``APART`` words."""
    begin = 0
    for k in range(1, len(links)):
        if max(x[links[k]] - x[links[k - 1]], y[links[k]] - y[links[k - 1]]) > APART + K:
            yield links[begin:k]
            begin = k
    yield links[begin:]


def _diagonals(chains: list[list[int]], x: list[int], y: list[int]) -> list[list[int]]:
    """The matches of each diagonal that isn't a chain by itself: a repeat within a document may draw a chain off an equal passage."""
    of: dict[int, list[int]] = {}
    for i in range(len(x)):
        of.setdefault(y[i] - x[i], []).append(i)
    known = {tuple(links) for links in chains}
    return [links for links in of.values() if len(links) > 1 and tuple(links) not in known]


def _chains(batches: Iterator[pa.RecordBatch], diagonals: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows ``doc, hub, place, there`` in order: the chains of each pair, their matches as bytes."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(c).to_numpy() for c in ("doc", "hub", "place", "there")]
        new = np.logical_or.reduce([np.append(True, c[1:] != c[:-1]) for c in columns])  # a match may come from a seed and from a window
        doc, hub, place, there = (c[new] for c in columns)
        known = rows.column("known").to_numpy()[new] if diagonals else np.zeros(len(doc), bool)  # pairs of such matches only were chained before
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hub[1:] != hub[:-1]), [True]]))
        # matches that ascend in small steps are one chain: a step left out would save no gap
        dx, dy = np.diff(place.astype(np.int64)), np.diff(there.astype(np.int64))
        odd = np.concatenate([[0], np.cumsum((dx <= 0) | (dy <= 0) | (GAP * (dx + dy) >= K))])
        out: list[tuple] = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a == 1 or known[a:b].all():
                continue
            x, y = place[a:b].tolist(), there[a:b].tolist()
            found = [list(range(b - a))] if odd[b - 1] == odd[a] else chain(x, y)
            if diagonals and odd[b - 1] != odd[a]:
                found += _diagonals(found, x, y)
            for links in (part for links in found for part in _close(links, x, y)):
                xs, ys = [x[i] for i in links], [y[i] for i in links]
                if len(links) > 1:
                    out.append((doc[a], hub[a], xs[0], xs[-1] + K, ys[0], ys[-1] + K, np.array(xs, "<i4").tobytes(), np.array(ys, "<i4").tobytes()))
        names = ["doc", "hub", "x0", "x1", "y0", "y1", "xs", "ys"]
        kinds = [pa.int64()] * 6 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(8)], names=names)

    for rows in _whole(batches, 100_000, "doc"):
        yield settle(rows)


def _table(a: np.ndarray, b: np.ndarray, like: int) -> np.ndarray:
    """Scores of the best alignments of the beginnings of ``a[r]`` and ``b[r]``: ``like`` for an equal word, any other step costs one."""
    n, s = a.shape
    steps = np.arange(b.shape[1] + 1, dtype=np.int16)
    score = np.empty((s + 1, n, len(steps)), np.int16)
    score[0] = -steps
    for i in range(1, s + 1):
        row, above = score[i], score[i - 1]
        row[:, 0] = -i
        same = (b == a[:, i - 1 : i]).view(np.int8) * np.int16(like + 1) - np.int16(1)
        np.maximum(above[:, :-1] + same, above[:, 1:] - np.int16(1), out=row[:, 1:])
        row += steps
        np.maximum.accumulate(row, axis=1, out=row)
        row -= steps
    return score


def _walk(score: np.ndarray, a: np.ndarray, b: np.ndarray, like: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in ``a`` and place in ``b`` of the equal words of the alignments that end at ``(i, j)``."""
    out, at = [], np.flatnonzero((i > 0) & (j > 0))
    i, j = i.copy(), j.copy()
    while len(at):
        x, y = i[at], j[at]
        now, same = score[x, at, y], a[at, x - 1] == b[at, y - 1]
        aslant = now == score[x - 1, at, y - 1] + np.where(same, like, -1)
        down = aslant | (now == score[x - 1, at, y] - 1)
        hit = aslant & same
        out.append((at[hit], x[hit] - 1, y[hit] - 1))
        i[at], j[at] = x - down, y - (aslant | ~down)
        at = at[(i[at] > 0) & (j[at] > 0)]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([o[k] for o in out]) if out else none for k in range(3))


def _rows(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, empty: int, way: int = 1) -> np.ndarray:
    """``size`` words from ``begin`` on (or backwards), filled up with ``empty``."""
    step = np.arange(width)
    inside = step < size[:, None]
    return np.where(inside, flat[np.where(inside, begin[:, None] + way * step, 0)], U(empty))


AT_ONCE = 1 << 22  # scores held at once


def _blocks(size: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the problems, in blocks of about the same ``size``."""
    order = np.argsort(size, kind="stable")
    begin = 0
    while begin < len(order):
        most = int(size[order[begin]]) + 8
        end = min(int(np.searchsorted(size[order], most, "right")), begin + max(1, AT_ONCE // (most + 1) ** 2))
        yield order[begin:end]
        begin = end


def _ahead(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, way: int):
    """Row and place of the equal words, counted from ``x`` and ``y``, of the best alignment of beginnings of both sides."""
    width = int(min(nx.max(initial=0), ny.max(initial=0)))
    same = _rows(a, x, np.minimum(nx, ny), width, 0, way) == _rows(b, y, np.minimum(nx, ny), width, 1, way)
    run = np.minimum.accumulate(same, axis=1).sum(1)
    row = np.repeat(np.arange(len(x)), run)
    place = np.arange(len(row)) - np.repeat(np.cumsum(run) - run, run)
    out = [(row, place, place)]
    left = np.flatnonzero((run < nx) & (run < ny))
    for block in _blocks(np.maximum(nx, ny)[left] - run[left]):
        r = left[block]
        skip, m, n = run[r], nx[r] - run[r], ny[r] - run[r]
        p, q = _rows(a, x[r] + way * skip, m, int(m.max()), 0, way), _rows(b, y[r] + way * skip, n, int(n.max()), 1, way)
        score = _table(p, q, 1)
        best = score.max(2)
        i = best.argmax(0)
        some = np.flatnonzero(best[i, np.arange(len(r))] > 0)
        i = i[some]
        j = score[i, some].argmax(1)
        row, u, v = _walk(score[:, some], p[some], q[some], 1, i, j)
        out.append((r[some][row], u + skip[some][row], v + skip[some][row]))
    row, u, v = (np.concatenate([o[k] for o in out]) for k in range(3))
    return row, way * u, way * v


def align(a: np.ndarray, b: np.ndarray, ends: np.ndarray, xs: np.ndarray, ys: np.ndarray, chains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and places in ``a`` and ``b`` of the equal words along many chains, ascending.

    ``a`` and ``b`` hold the words of all rows, row ``r`` those before
    ``ends[0][r]`` and ``ends[1][r]``; ``xs`` and ``ys`` the places of all
    seeds in them, row ``r`` those before ``chains[r]``.
    """
    rows = len(chains)
    of = np.repeat(np.arange(rows), np.diff(chains, prepend=0))
    last, first = chains - 1, np.append(0, chains[:-1])
    starts = [np.append(0, e[:-1]) for e in ends]
    x, y = xs[last] + K, ys[last] + K
    found = [(r, x[r] + u, y[r] + v) for r, u, v in [_ahead(a, b, x, y, ends[0] - x, ends[1] - y, 1)]]
    x, y = xs[first] - 1, ys[first] - 1
    found += [(r, x[r] + u, y[r] + v) for r, u, v in [_ahead(a, b, x, y, xs[first] - starts[0], ys[first] - starts[1], -1)]]
    # a seed may overlap the one before it
    inner = np.ones(len(xs), bool)
    inner[first] = False
    dx, dy = np.diff(xs, prepend=0), np.diff(ys, prepend=0)
    over = np.where(inner, np.maximum(0, np.maximum(K - dx, K - dy)), 0)
    seed = np.repeat(np.arange(len(xs)), K - over)
    k = np.arange(len(seed)) - np.repeat(np.cumsum(K - over) - (K - over), K - over) + over[seed]
    found.append((of[seed], xs[seed] + k, ys[seed] + k))
    m, n = np.where(inner, dx - K + over, 0), np.where(inner, dy - K + over, 0)
    gap = np.flatnonzero((m > 0) & (n > 0))
    x, y, m, n = xs[gap] + over[gap] - m[gap], ys[gap] + over[gap] - n[gap], m[gap], n[gap]
    even = np.where(m == n, m, 0)
    g = np.repeat(np.arange(len(gap)), even)
    k = np.arange(len(g)) - np.repeat(np.cumsum(even) - even, even)
    same = a[x[g] + k] == b[y[g] + k]
    direct = (m == n) & (np.bincount(g, same, len(gap)) >= SHARE * m)
    g, k = g[same & direct[g]], k[same & direct[g]]
    found.append((of[gap[g]], x[g] + k, y[g] + k))
    other = np.flatnonzero(~direct)
    for block in _blocks(np.maximum(m, n)[other]):
        r = other[block]
        p, q = _rows(a, x[r], m[r], int(m[r].max()), 0), _rows(b, y[r], n[r], int(n[r].max()), 1)
        row, u, v = _walk(_table(p, q, 0), p, q, 0, m[r], n[r])
        found.append((of[gap[r[row]]], x[r[row]] + u, y[r[row]] + v))
    row, p, q = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.lexsort((p, row))
    return row[order], p[order], q[order]


def segments(p: np.ndarray, q: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """Passages along aligned equal words, as bounds in ``p`` and ``q``.

    The longest stretch that spans ``least`` words with ``share`` of them
    equal, cut down to its best part (a word that differs costs two equal
    ones) if that is a passage too; then what is left on both sides.
    """
    whole = lambda s, t: min(p[t] - p[s], q[t] - q[s]) + 1 >= least and t - s + 1 >= share * (max(p[t] - p[s], q[t] - q[s]) + 1)
    out, todo = [], [(0, len(p))]
    while todo:
        begin, end = todo.pop()
        found = _longest(p[begin:end], q[begin:end], least, share)
        if not found:
            continue
        s, n = begin + found[0], found[1]
        t = s + n - 1
        skipped = np.maximum(np.diff(p[s : t + 1]), np.diff(q[s : t + 1])) - 1
        if skipped.any():
            score = np.arange(n) - 2 * np.concatenate([[0], np.cumsum(skipped)])
            low = np.minimum.accumulate(score)
            v = int((score - low).argmax())
            u = int(score[: v + 1].argmin())
            if whole(s + u, s + v):
                s, t = s + u, s + v
        out.append((s, t + 1))
        todo += [(begin, s), (t + 1, end)]
    return sorted(out)


MATRIX = 512  # equal words whose stretches are judged all at once


def _longest(x: np.ndarray, y: np.ndarray, least: int, share: float) -> tuple[int, int] | None:
    """First word and number of words of the longest (of equal ones the first) stretch that is a passage."""
    fewest = max(2, int(np.ceil(share * least)))
    if len(x) < fewest:
        return None
    dx, dy = x[-1] - x[0] + 1, y[-1] - y[0] + 1
    if min(dx, dy) >= least and len(x) >= share * max(dx, dy):
        return 0, len(x)
    if len(x) <= MATRIX:
        n = np.arange(len(x)) - np.arange(len(x))[:, None] + 1
        dx, dy = x - x[:, None] + 1, y - y[:, None] + 1
        n = np.where((np.minimum(dx, dy) >= least) & (n >= share * np.maximum(dx, dy)), n, 0)
        s, t = np.unravel_index(n.argmax(), n.shape)
        return (int(s), int(n[s, t])) if n[s, t] >= fewest else None
    for n in range(len(x) - 1, fewest - 1, -1):
        dx, dy = x[n - 1 :] - x[: len(x) - n + 1] + 1, y[n - 1 :] - y[: len(y) - n + 1] + 1
        fits = (np.minimum(dx, dy) >= least) & (n >= share * np.maximum(dx, dy))
        if fits.any():
            return int(fits.argmax()), n
    return None


BATCH = 1 << 21  # words aligned at once


def _aligned(least: int, share: float):
    names = ["doc_id", "other_doc_id", "start", "end", "other_start", "other_end", "n_equal"]

    def column(part: pa.RecordBatch, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a binary column in a row, and where those of each row end."""
        data, offsets = text_bytes(part.column(name))
        return np.frombuffer(data.tobytes(), kind), offsets[1:] // np.dtype(kind).itemsize

    def passages_of(part: pa.RecordBatch) -> pa.RecordBatch:
        (a, a_ends), (b, b_ends) = column(part, "a", np.uint64), column(part, "b", np.uint64)
        (xs, chains), (ys, _) = column(part, "xs", "<i4"), column(part, "ys", "<i4")
        a_from, b_from = part.column("a_from").to_numpy(), part.column("b_from").to_numpy()
        a_first, b_first = np.append(0, a_ends[:-1]) - a_from, np.append(0, b_ends[:-1]) - b_from  # of a document's word 0
        size = np.diff(chains, prepend=0)
        row, p, q = align(a, b, np.stack([a_ends, b_ends]), xs + np.repeat(a_first, size), ys + np.repeat(b_first, size), chains)
        p, q = p - a_first[row], q - b_first[row]
        edge = np.searchsorted(row, np.arange(part.num_rows + 1))
        out = []
        for r in np.flatnonzero(np.diff(edge) >= share * least).tolist():
            x, y = p[edge[r] : edge[r + 1]], q[edge[r] : edge[r + 1]]
            out += [(r, x[s], x[t - 1] + 1, y[s], y[t - 1] + 1, t - s) for s, t in segments(x, y, least, share)]
        found = np.array(out, np.int64).reshape(-1, 6).T
        ids = [part.column(c).to_numpy()[found[0]] for c in ("doc", "hub")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*ids, *found[1:])], names=names)

    def joined(rows: pa.Table) -> pa.RecordBatch:
        """Chains with the words of either side; rows are in order of ``id``."""
        rows = rows.to_batches()[0]
        key, side = rows.column("id").to_numpy(), rows.column("side").to_numpy()
        chained = np.flatnonzero(side == 2)
        found, ok = [], np.ones(len(chained), bool)
        for k in (0, 1):
            pieces = np.append(np.flatnonzero(side == k), -1)  # of rows that share a document's id, the first one's words
            at = np.searchsorted(key[pieces[:-1]], key[chained])
            ok &= key[pieces[at]] == key[chained]
            ok &= at < len(pieces) - 1
            found.append(pieces[at])
        columns = {c: rows.column(c).take(pa.array(chained[ok])) for c in ("doc", "hub", "xs", "ys")}
        for name, at in zip("ab", found, strict=True):
            columns[name], columns[f"{name}_from"] = (rows.column(c).take(pa.array(at[ok])) for c in ("piece", "begin"))
        return pa.RecordBatch.from_pydict(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, 1, "id"):
            for part in slices(joined(rows), "a", BATCH * 8):
                yield passages_of(part)

    return work


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the wanted stretches of each document: ``id, side, begin, piece``."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column("text"))
                hashes, text, _, _ = words(data, offsets)
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                want = part.column("want")
                flat, of = want.flatten(), np.repeat(np.arange(part.num_rows), want.value_lengths().to_numpy())
                begin, end = (flat.field(i).to_numpy().astype(np.int64) for i in (2, 3))
                size = bounds[of + 1] - bounds[of]
                begin, end = np.minimum(np.maximum(0, begin - FLANK), size), np.minimum(end + FLANK, size)
                n = np.maximum(0, end - begin)
                for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) >> 20)) + 1):  # about 2 ** 20 words each
                    m = n[some]
                    edges = np.concatenate([[0], np.cumsum(m)])
                    at = np.repeat(bounds[of[some]] + begin[some] - edges[:-1], m) + np.arange(edges[-1])
                    pieces = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((8 * edges).astype(np.int32)), pa.py_buffer(hashes[at])])
                    take = pa.array(some)
                    yield pa.RecordBatch.from_arrays([flat.field(0).take(take), flat.field(1).take(take), pa.array(begin[some]), pieces], names=["id", "side", "begin", "piece"])


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of document and other document, with a mark on those that lie within a passage of an earlier other one."""
    now, begins, ends = None, [], []  # of passages that hold no other, ascending in both
    for batch in batches:
        inner = np.zeros(batch.num_rows, bool)
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "end")), strict=True)
        for i, (doc, start, end) in enumerate(rows):
            if doc != now:
                now, begins, ends = doc, [], []
            at = bisect_right(begins, start)
            if at and ends[at - 1] >= end:
                inner[i] = True
                continue
            low = bisect_left(begins, start)
            high = bisect_right(ends, end)
            begins[low:high], ends[low:high] = [start], [end]
        yield batch.append_column("inner", pa.array(inner))


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a document, its passages first, then its seeds: the seeds, marked if no passage holds their words."""
    now, begins, ends = None, [], []
    for batch in batches:
        doc, kind, place, end = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "kind", "place", "end"))
        is_open = np.ones(len(doc), bool)
        for at in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []:
            if doc[at[0]] != now:
                now, begins, ends = doc[at[0]], [], []
            own = at[kind[at] == 0]
            begins += place[own].tolist()
            ends += end[own].tolist()
            seeds_ = at[kind[at] == 1]
            if begins and len(seeds_):
                order = np.argsort(begins)
                low, high = np.array(begins)[order], np.maximum.accumulate(np.array(ends)[order])
                before = np.searchsorted(low, place[seeds_], "right") - 1
                is_open[seeds_] = (before < 0) | (high[np.maximum(before, 0)] < place[seeds_] + K)
        kept = batch.append_column("open", pa.array(is_open)).filter(pa.array(kind == 1))
        yield kept.select(["seed", "doc", "place", "first", "hub", "n", "open"])


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of seed, document and place: each open one with all documents before it that have the seed; ``known`` with the first one."""
    now, doc, before = None, None, []
    for batch in batches:
        out = []
        for seed, at, place, first, hub, is_open in zip(*(batch.column(c).to_pylist() for c in ("seed", "doc", "place", "first", "hub", "open")), strict=True):
            if seed != now:
                now, doc, before = seed, None, []
            if at != doc:
                doc, new = at, True
            if is_open:
                out += [(at, other, place, there, other == hub) for other, there in before if other != at]
            if first and new:
                before.append((at, place))
                new = False
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["doc", "hub", "place", "there", "known"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of document and place: every two different seeds that a chain may join, one of them of more than ``FEW`` documents at least.

    ``own`` if both are open, ``other`` if both are the document's first ones of their kind; ``many`` has a bit for each of more than ``FEW``.
    """
    with np.errstate(over="ignore"):
        for rows in _whole(batches, 20_000, "doc"):
            seed, doc, place, first, open_, n = (rows.column(c).to_numpy() for c in ("seed", "doc", "place", "first", "open", "n"))
            many = n > FEW
            low = np.arange(len(doc))
            step = 1
            while len(low := low[low + step < len(doc)]):
                high = low + step
                low = low[(doc[low] == doc[high]) & (place[high] - place[low] <= APART + K)]
                high = low + step
                own, other = open_[low] & open_[high], first[low] & first[high]
                keep = (own | other) & (many[low] | many[high]) & (seed[low] != seed[high])
                i, j = low[keep], high[keep]
                key = mix(mix(seed[i].view(U)) * U(_STEP) + seed[j].view(U)).view(np.int64)
                columns = [key, doc[i], place[i], place[j], own[keep], other[keep], (many[i] + 2 * many[j]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "doc", "place", "next", "open", "first", "many"])
                step += 1


def _stretches(part: pa.RecordBatch, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words around the wanted seeds (field 1 has their places): numbers of some wants, the rows they are of, their words and where those of each end."""
    data, offsets = text_bytes(part.column("text"))
    hashes, text, _, _ = words(data, offsets)
    bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
    want = part.column("want")
    of = np.repeat(np.arange(part.num_rows), want.value_lengths().to_numpy())
    place = want.flatten().field(1).to_numpy()
    keep = np.flatnonzero(bounds[of] + place + K <= bounds[of + 1])  # else it is another row's of that id
    for some in np.split(keep, np.arange(4096, len(keep), 4096)):
        at, low, high = bounds[of[some]] + place[some], bounds[of[some]], bounds[of[some] + 1]
        begin, end = np.maximum(low, at - reach), np.minimum(high, at + K + reach)
        edges = np.concatenate([[0], np.cumsum(end - begin)])
        row = np.repeat(np.arange(len(some)), end - begin)
        yield some, of[some], hashes[np.arange(edges[-1]) - edges[row] + begin[row]], edges


def _counted(reach: int):
    """Words around the wanted seeds, those of a batch that occur again in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    for _, _, word, _ in _stretches(part, reach):
                        word, n = np.unique(word, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(word[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["word", "n"])

    return work


def _rarest(rank: np.ndarray, size: np.ndarray, least: int, share: float) -> np.ndarray:
    """Which words of each row are among the rarest of a stretch, one more than it may lack of another side.

    Of two stretches that make a passage, the rarest word that they share is marked in both: what is rarer in either
    is lacking on the other side. Stretches are taken in two kinds, as the shortest that lack as many as the longest of
    their kind: what is marked by any is marked by these.
    """
    out = np.zeros(rank.shape, bool)
    for n, longest in ((least, least * 11 // 8 - 1), (least * 11 // 8, 2 * least - 1)):
        lacks = int((1 - share) * longest + 1e-9)
        count = rank.shape[1] - n + 1
        if count <= 0:
            break
        highest = np.partition(np.lib.stride_tricks.sliding_window_view(rank, n, axis=1), lacks, axis=2)[:, :, lacks]
        cover = np.full((len(rank), rank.shape[1] + n - 1), -1, rank.dtype)
        cover[:, n - 1 : n - 1 + count] = np.where(np.arange(count) + n <= size[:, None], highest, -1)
        out |= rank <= np.lib.stride_tricks.sliding_window_view(cover, n, axis=1).max(2)
    return out


def _finer(seed: np.ndarray, word: np.ndarray, edges: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and key: a two with each of the rarest words of the stretches around it."""
    known, times = common
    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
    often = np.where(known[at] == word, times[at], 0) if len(known) else np.zeros(len(word), np.int64)
    rank = np.unique((np.minimum(often, (1 << 31) - 1) << 32) + (word >> U(32)).astype(np.int64), return_inverse=True)[1].astype(np.int32)
    size = np.diff(edges)
    order = np.argsort(size, kind="stable")
    order = order[size[order] >= least]
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for some in np.split(order, np.arange(64, len(order), 64)) if len(order) else []:
        step = np.arange(size[some].max())
        place = np.minimum(edges[some][:, None] + step, edges[some + 1][:, None] - 1)
        inside = step < size[some][:, None]
        row, column = np.nonzero(_rarest(np.where(inside, rank[place], np.iinfo(np.int32).max), size[some], least, share))
        key = mix(seed[some[row]].view(U) * U(_STEP) + mix(word[place[row, column]])).view(np.int64)
        new = _first(row, key)
        rows.append(some[row[new]])
        keys.append(key[new])
    return np.concatenate(rows), np.concatenate(keys)


def _around(reach: int, least: int, share: float, common: tuple[np.ndarray, np.ndarray]):
    """The words around the wanted seeds, as numbers that tell the first of equal words from the second and so on, and the finer keys of twos of very many documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    flat = part.column("want").flatten()
                    for some, of, word, edges in _stretches(part, reach):
                        row = np.repeat(np.arange(len(some)), np.diff(edges))
                        order = np.lexsort((word, row))
                        new = np.append(True, (word[order[1:]] != word[order[:-1]]) | (row[order[1:]] != row[order[:-1]]))[: len(order)]
                        starts = np.flatnonzero(new)
                        nth = np.empty(len(order), np.int64)
                        nth[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
                        token = mix(word + nth.astype(U) * U(_STEP)).astype(np.uint16) & np.uint16(BITS - 1)
                        pieces = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(token)])
                        names = ["seed", "place", "first", "open", "owns", "others", "next", "many"]
                        fields = [flat.field(i).take(pa.array(some)) for i in range(8)]
                        wide = np.flatnonzero(fields[5].to_numpy() > 1)
                        ends = np.concatenate([[0], np.cumsum(np.diff(edges)[wide])])
                        own = np.repeat(wide, np.diff(edges)[wide])
                        at, key = _finer(fields[0].to_numpy()[wide], word[np.arange(len(own)) - ends[np.searchsorted(wide, own)] + edges[own]], ends, common, least, share)
                        order = np.argsort(at, kind="stable")
                        counts = np.bincount(wide[at], minlength=len(some)) if len(at) else np.zeros(len(some), np.int64)
                        finer = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(key[order]))
                        yield pa.RecordBatch.from_arrays([pa.array(part.column("doc").to_numpy()[of]), *fields, pieces, finer], names=["doc", *names, "around", "finer"])

    return work


def _dense(token: np.ndarray, bits: np.ndarray, least: int, share: float) -> np.ndarray:
    """Whether some ``least`` words in a row, or more, may have their share in the other side's ``bits``."""
    return _holds(np.take_along_axis(bits, token.astype(np.int64), 1), least, share)


def _holds(there: np.ndarray, least: int, share: float) -> np.ndarray:
    total = np.zeros((len(there), there.shape[1] + 1), np.float32)
    np.cumsum(there - np.float32(share), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(total[:, : total.shape[1] - least], axis=1)
    return (total[:, least:] - low).max(1) >= -1e-3


def _compared(reach: int, least: int, share: float):
    """Rows of tiles, in order: the pairs of two open seeds and an earlier document's that may share a passage around them."""
    width, fewest = 2 * reach + K, int(np.ceil(share * least))
    blocks = -(-width // BLOCK)
    fewest_blocks = (least - BLOCK + 1) // BLOCK
    slack = (1 - share) * 2 * (BLOCK - 1)

    def may_hold(token: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Whole blocks of one side's words: a passage covers some in a row and lacks no more of their words than of its own."""
        each = columns[token].reshape(blocks, BLOCK, -1).sum(1, dtype=np.uint8)
        total = np.zeros((blocks + 1, each.shape[1]), np.float32)
        np.cumsum(each - np.float32(share * BLOCK), axis=0, out=total[1:])
        low, best = total[0].copy(), np.full(each.shape[1], -np.inf, np.float32)
        for k in range(fewest_blocks, blocks + 1):
            np.minimum(low, total[k - fewest_blocks], out=low)
            np.maximum(best, total[k] - low, out=best)
        return best >= -slack - 1e-3

    def tile(doc, open_, first, token, bits) -> Iterator[np.ndarray]:
        """The pairs that are left of a tile by whole blocks."""
        own, others = (rows[np.argsort(doc[rows], kind="stable")] for rows in (np.flatnonzero(open_), np.flatnonzero(first)))
        if not len(own) or not len(others) or doc[own[-1]] <= doc[others[0]]:
            return
        fewer, more = (own, others) if len(own) < len(others) else (others, own)
        for k in range(0, len(more), 2048):
            b = more[k : k + 2048]
            columns = np.ascontiguousarray(bits[b].T).view(np.uint8)
            begin = np.zeros(len(own), int) if fewer is own else np.searchsorted(doc[b], doc[fewer], "right")
            end = np.searchsorted(doc[b], doc[fewer]) if fewer is own else np.full(len(others), len(b))
            pairs = [np.zeros((2, 0), np.int64)]
            for a, s, t in zip(fewer.tolist(), begin.tolist(), end.tolist(), strict=True):
                if s < t:
                    j = b[s:t][may_hold(token[a], columns[:, s:t])] if t - s > BLOCK else b[s:t]
                    pairs.append(np.stack([np.full(len(j), a), j]))
            found = np.concatenate(pairs, axis=1)
            yield found if fewer is own else found[::-1]

    def listed(doc, open_, first, edge) -> np.ndarray:
        """All pairs of small tiles, which end at ``edge``."""
        own, others = np.flatnonzero(open_), np.flatnonzero(first)
        bounds = np.searchsorted(others, edge)
        of = np.searchsorted(edge, own, "right") - 1
        n = bounds[of + 1] - bounds[of]
        i = np.repeat(own, n)
        j = others[np.repeat(bounds[of], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        return np.stack([i, j])[:, doc[j] < doc[i]]

    def judged(pairs: np.ndarray, token, bits) -> Iterator[np.ndarray]:
        flat = bits.ravel()
        for m in range(0, pairs.shape[1], 4096):
            p, q = pairs[:, m : m + 4096]
            for _ in range(2):
                may = _holds(flat[q[:, None] * (BITS + 1) + token[p, :width]], least, share)
                p, q = q[may], p[may]
            yield np.stack([p, q])

    def settle(rows: pa.Table) -> pa.RecordBatch:
        names = ("seed", "low", "high", "doc", "place", "next", "many", "first", "open")
        seed, low, high, doc, place, then, many, first, open_ = (rows.column(c).to_numpy() for c in names)
        data, offsets = text_bytes(rows.column("around").chunk(0))
        size = np.diff(offsets) // 2
        token = np.full((len(size), blocks * BLOCK), BITS, np.uint16)
        token[np.arange(blocks * BLOCK) < size[:, None]] = np.frombuffer(data.tobytes(), np.uint16)
        open_, first = open_ & (size >= fewest), first & (size >= fewest)
        edge = _edges(seed, low, high)
        small = np.diff(edge) <= LISTED
        # tiles of few rows that lie side by side are judged together, some 4,096 rows at once
        new = np.ones(len(small), bool)
        new[1:] = ~small[1:] | ~small[:-1] | (np.diff(edge[:-1] >> 12) > 0)
        out = [np.zeros((2, 0), np.int64)]
        for k, m in itertools.pairwise([*np.flatnonzero(new).tolist(), len(small)]):
            s, t = edge[k], edge[m]
            bits = np.zeros((t - s, BITS + 1), bool)
            np.put_along_axis(bits, token[s:t].astype(np.int64), True, 1)
            bits[:, BITS] = False
            sides = [c[s:t] for c in (doc, open_, first)]
            for pairs in [listed(*sides, edge[k : m + 1] - s)] if small[k] else tile(*sides, token[s:t], bits):
                out += [s + found for found in judged(pairs, token[s:t], bits)]
        p, q = np.concatenate(out, axis=1)
        found = np.concatenate([np.stack([doc[a], doc[b], at[a], at[b]]) for bit, at in ((1, place), (2, then)) for a, b in [(p[many[p] & bit > 0], q[many[p] & bit > 0])]], axis=1)
        found = found[:, _first(*found)]  # a seed is in many twos
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["doc", "hub", "place", "there"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, 20_000, "seed", "low", "high"):
            yield settle(rows)

    return work


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties as one row for each pair of documents of a batch, either place in half of a long."""
    for batch in batches:
        doc, hub, place, there = (batch.column(c).to_numpy() for c in ("doc", "hub", "place", "there"))
        order = np.lexsort((there, place, hub, doc))
        doc, hub, ties = doc[order], hub[order], (place[order] << 32) | there[order]
        if len(doc):
            edge = _edges(doc, hub)
            yield pa.RecordBatch.from_arrays([pa.array(doc[edge[:-1]]), pa.array(hub[edge[:-1]]), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ties))], names=["doc", "hub", "ties"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed ties in order of document, as ties in order of document, other document and places."""
    for rows in _whole(batches, 20_000, "doc"):
        lists = rows.column("ties").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ties, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        doc, hub, known = (np.repeat(rows.column(c).to_numpy(), n) for c in ("doc", "hub", "known"))
        order = np.lexsort((known, ties, hub, doc))
        doc, hub, known, ties = doc[order], hub[order], known[order], ties[order]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, hub, ties >> 32, ties & 0xFFFFFFFF, known)], names=["doc", "hub", "place", "there", "known"])


def _earlier_owners(tied: DataFrame, found: DataFrame, docs: DataFrame, scratch: Scratch, least: int, share: float) -> DataFrame:
    """``doc, hub, ties, known``: ties of seeds outside all passages to the documents before that have them, packed."""
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("first", "boolean"), ("hub", "long"), ("n", "int"))]
    covers = found.select(F.lit(None).cast("long").alias("seed"), F.col("doc_id").alias("doc"), F.col("start").alias("place"), *none, F.lit(0).alias("kind"), F.col("end"))
    rows = tied.select("seed", "doc", F.col("place").cast("long").alias("place"), "first", "hub", "n", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("end"))
    marked = covers.unionAll(rows).repartition(F.col("doc")).sortWithinPartitions("doc", "kind")
    marked = marked.mapInArrow(_open, "seed long, doc long, place long, first boolean, hub long, n int, open boolean")
    marked = scratch.keep(marked.withColumn("open", F.col("open") & (F.col("doc") != F.col("hub"))), "marked")
    some = scratch.keep(marked.where("open").select(F.col("seed").alias("s")).distinct(), "open-seeds")
    live = marked.where("open OR first").join(some, F.col("seed") == F.col("s")).select("seed", "doc", "place", "first", "hub", "n", "open")
    few = live.where(F.col("n") <= FEW).repartition(F.col("seed")).sortWithinPartitions("seed", "doc", "place").mapInArrow(_owners, "doc long, hub long, place long, there long, known boolean")
    few = few.select("doc", "hub", F.array(F.shiftleft("place", 32).bitwiseOR(F.col("there"))).alias("ties"), "known")
    near = live.repartition(F.col("doc")).sortWithinPartitions("doc", "place")
    near = scratch.keep(near.mapInArrow(_pairs, "seed long, doc long, place long, next long, open boolean, first boolean, many int"), "near")
    keys = scratch.keep(_sides(near), "keys")
    near = near.join(keys, F.col("seed") == F.col("s"))
    texts = lambda rows, *fields: rows.groupBy("doc").agg(F.collect_list(F.struct(*fields)).alias("want")).hint("merge").join(_texts(docs), F.col("doc") == F.col("doc_id")).select("doc", "text", "want")
    reach = 2 * least - 1 - K  # a stretch of 2 * least - 1 words at most, as longer ones hold two
    common = np.zeros(0, U), np.zeros(0, np.int64)
    if not keys.where("others > 1").isEmpty():
        counted = texts(near.where("others > 1"), "seed", "place").mapInArrow(_counted(reach), "word long, n long")
        top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
        word, n = top.column("word").to_numpy().view(U), top.column("n").to_numpy()
        common = word[np.argsort(word)], n[np.argsort(word)]
    each = texts(near, "seed", "place", "first", "open", "owns", "others", "next", "many")
    row = "doc long, seed long, place long, first boolean, open boolean, owns int, others int, next long, many int, around binary, finer array<long>"
    each = scratch.keep(each.mapInArrow(_around(reach, least, share, common), row), "around")
    # a two that very many documents have first is looked up with a rare word of the stretch
    finer = each.where("others > 1").withColumn("seed", F.explode("finer")).drop("finer", "owns", "others")
    keys = scratch.keep(_sides(finer.select("seed", "doc", "first", "open")), "finer-keys")
    each = each.where("others = 1").drop("finer").unionByName(finer.join(keys, F.col("seed") == F.col("s")).drop("s"))
    dealt = _dealt(each).repartition("seed", "low", "high").sortWithinPartitions("seed", "low", "high")
    compared = _compared(reach, least, share)
    rest = scratch.keep(dealt.mapInArrow(lambda batches: _packed(compared(batches)), "doc long, hub long, ties array<long>"), "rest")
    scratch.drop("near", "keys", "around", "finer-keys")
    return few.unionAll(rest.withColumn("known", F.lit(False)))


def _sides(rows: DataFrame) -> DataFrame:
    """``s, owns, others``: keys that an open row has after a document's first one, and into how many parts either side of their pairs is cut."""
    parts = lambda side: F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col(side), 1)) / SIDE)).cast("int")
    hub, top = (least(F.when(F.col(side), F.col("doc"))) for least, side in ((F.min, "first"), (F.max, "open")))
    keys = rows.groupBy(F.col("seed").alias("s")).agg(hub.alias("hub"), top.alias("top"), parts("open").alias("owns"), parts("first").alias("others"))
    return keys.where("hub < top").select("s", "owns", "others")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in tiles ``low, high`` of each key: open ones to the tiles of their part, first ones to those of theirs."""
    part = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole, cut = rows.where("owns * others = 1"), rows.where("owns * others > 1")
    own = cut.where("open").withColumns({"first": F.lit(False), "low": part("owns"), "high": all_("others")})
    other = cut.where("first").withColumns({"open": F.lit(False), "low": all_("owns"), "high": part("others")})
    dealt = whole.withColumns({"low": F.lit(0), "high": F.lit(0)}).unionByName(own).unionByName(other)
    return dealt.select("seed", "low", "high", "doc", "place", "next", "many", "first", "open", "around")


def _found(matches: DataFrame, docs: DataFrame, scratch: Scratch, name: str, least: int, share: float, packed: bool = False) -> DataFrame:
    """Passages of ``matches(doc, hub, place, there)``, or packed ones: chains, cut out of the texts, and aligned."""
    chained = matches.repartition(F.col("doc")).sortWithinPartitions(*(["doc"] if packed else ["doc", "hub", "place", "there"]))
    chained = chained.mapInArrow((lambda batches: _chains(_unpacked(batches), diagonals=True)) if packed else _chains, "doc long, hub long, x0 long, x1 long, y0 long, y1 long, xs binary, ys binary")
    chained = scratch.keep(chained.withColumn("id", F.xxhash64("doc", "hub", "x0", "y0", "xs")), f"{name}-chains")
    sides = F.array(
        F.struct(F.col("doc").alias("at"), F.lit(0).alias("side"), F.col("x0").alias("begin"), F.col("x1").alias("end")),
        F.struct(F.col("hub").alias("at"), F.lit(1).alias("side"), F.col("y0").alias("begin"), F.col("y1").alias("end")),
    )
    wanted = chained.select("id", F.explode(sides).alias("w")).select("id", "w.*")
    # a first document may be wanted by very many others: its wants are dealt to lists of about WANTS
    heavy = wanted.groupBy(F.col("at").alias("h")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > WANTS)
    heavy = scratch.keep(heavy, f"{name}-heavy")
    wanted = wanted.join(heavy, F.col("at") == F.col("h"), "left")
    wanted = wanted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / WANTS)), F.lit(0)))
    per_doc = wanted.groupBy("at", "salt").agg(F.collect_list(F.struct("id", "side", "begin", "end")).alias("want"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("d"), "text")
    pieces = per_doc.hint("merge").join(texts, F.col("at") == F.col("d")).select("text", "want")
    pieces = pieces.mapInArrow(_cut, "id long, side int, begin long, piece binary")
    rows = pieces.unionByName(chained.select("id", F.lit(2).alias("side"), "doc", "hub", "xs", "ys"), allowMissingColumns=True)
    found = rows.repartition(F.col("id")).sortWithinPartitions("id").mapInArrow(_aligned(least, share), SCHEMA)
    found = scratch.keep(found, f"{name}-found")
    scratch.drop(f"{name}-chains", f"{name}-heavy")
    return found


def passages(docs: DataFrame, scratch: Scratch, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``doc_id, other_doc_id, start, end, other_start, other_end, n_equal, inner``: passages, in words, that an earlier document has too."""
    ties = _window_ties(docs, scratch)
    tied = seeds(docs).repartition(F.col("seed")).sortWithinPartitions("seed")
    tied = scratch.keep(tied.mapInArrow(_tied, "seed long, doc long, place int, first boolean, hub long, there int, n int"), "shared")
    first = _found(ties.unionAll(tied.where("doc <> hub").select("doc", "hub", "place", "there")), docs, scratch, "first", least, share)
    scratch.drop("ties")
    # stretches that gave no passage are tied again, to all documents before theirs that have their seeds
    left = _earlier_owners(tied, first, docs, scratch, least, share)
    second = _found(left, docs, scratch, "second", least, share, packed=True)
    scratch.drop("shared", "marked", "open-seeds", "rest")
    found = first.unionAll(second).distinct()
    ordered = found.repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "other_doc_id", "start", F.col("end").desc(), "other_start", "other_end")
    return ordered.mapInArrow(_inner, f"{SCHEMA}, inner boolean")
