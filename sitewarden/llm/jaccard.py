"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections.

Two documents link when the Jaccard similarity of their distinct word shingles
reaches a threshold (whole-number arithmetic, so the edge is exact).

1. One pass over the texts gives each document its set size, 127 bits of hash
   of its set (equal sets are one *node*) and ``BANDS`` keys of ``ROWS`` minimum
   hashes. A pair at similarity ``s`` shares no key with probability
   ``(1 - s ** ROWS) ** BANDS``: 1.2e-8 at 0.75, and less above.
2. Nodes that share a key are tied to the key's smallest node, its *hub*; the
   components of these ties are *clusters*. No pair of a group is ever listed.
3. Clusters are compared in tiles of about ``TILE`` nodes. In a tile, nodes are
   ordered by size and compared within bands of sizes that can link; hashed
   bitmaps of a width that follows the band bound the overlap from above
   (``|A| + |B| - popcount(A xor B)`` over two), and what passes is decided by
   intersecting the sorted sets. Nodes that are connected already are not
   compared again.
4. A cluster of several tiles goes first by hub, the hub being in each tile of
   its nodes, so that a group of copies is one component at once. What is outside
   the cluster's largest component then meets every node of a size that it can
   link with: nodes are dealt to bands of sizes, each as wide as the threshold,
   and only tiles of the same or neighbouring bands meet.

Defined results: no word, or a null text: set size 0, linked with nothing, its
own component. Repeated rows, and rows that share an id, count under that id.
A null id cannot be linked: its component is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import Forest, components
from .hashing import U, mix, numbers, shingles, slices, text_bytes, words

SIZE = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 48, 4
TILE = 512  # nodes
TILE_GRAMS = 1 << 20  # shingles
WIDEST = 1 << 16  # bits
_COEF = numbers(BANDS * ROWS, 7).reshape(BANDS, ROWS)
_OTHER = numbers(1, 8)[0]
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    hashes, text, _, _ = words(data, offsets)
    return shingles(hashes, text, batch.num_rows, size)


def _nodes(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each set, of 63 and 64 bits; 0 for an empty one."""
    n = np.diff(bounds)
    full = n > 0
    out = np.zeros((2, len(n)), np.int64)
    if full.any():
        first, second = (np.add.reduceat(mix(x), bounds[:-1][full]) for x in (grams, grams ^ _OTHER))
        out[0, full] = (mix(first + n[full].astype(U)) >> U(1)).astype(np.int64) | 1
        out[1, full] = mix(second + first).view(np.int64)
    return out[0], out[1]


def _keys(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of each non-empty set."""
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(at), BANDS), np.int64)
    for band in range(BANDS):
        key = np.full(len(at), U(band + 1))
        for c in _COEF[band]:
            key = mix(key * c + np.minimum.reduceat(grams * c, at))
        out[:, band] = key.view(np.int64)
    return out


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, keys`` of every row; ``keys`` is empty for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    grams, bounds = _sets(part, size)
                    n = np.diff(bounds)
                    lengths = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                    keys = _keys(grams, bounds).ravel() if len(grams) else np.zeros(0, np.int64)
                    hashes = map(pa.array, _nodes(grams, bounds))
                    lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(keys))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *hashes, lists], names=names)

    names = ["doc_id", "n_shingles", "h1", "h2", "keys"]

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_shingles long, h1 long, h2 long, keys array<long>")


def _links(sets: list[np.ndarray], known: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between sets that join components; ``known`` numbers components that exist already.

    ``sets`` ascend in size. The links returned, with ``known``, have the same
    components as all links among the sets.
    """
    n = np.array([len(s) for s in sets])
    forest, found = Forest(len(sets)), []
    first: dict[int, int] = {}
    for i, k in enumerate(known.tolist()):
        forest.join(first.setdefault(k, i), i)
    label = np.array([forest.root(i) for i in range(len(sets))])
    maps, width = np.zeros((0, 0), np.uint8), 0
    lowest = 0
    for i in range(len(sets)):
        while 100 * n[lowest] < threshold * n[i]:
            lowest += 1
        if 2 * n[i] > width and width < WIDEST:  # the next band of sizes: a wider bitmap for all that can still link
            width = min(WIDEST, 1 << max(9, int(3 * n[i]).bit_length()))
            maps = np.zeros((len(sets), width // 8), np.uint8)
            for j in range(lowest, len(sets)):
                if 2 * n[j] > width and width < WIDEST:
                    break
                bits = np.zeros(width, bool)
                bits[(sets[j] >> U(40)).astype(np.int64) & (width - 1)] = True
                maps[j] = np.packbits(bits)
        others = np.arange(lowest, i)
        others = others[label[lowest:i] != label[i]]
        if not len(others):
            continue
        differ = _BITS[maps[others] ^ maps[i]].sum(1, dtype=np.int64)
        most = (n[others] + n[i] - differ) // 2
        may = (100 + threshold) * most >= threshold * (n[others] + n[i])
        others = others[may][np.argsort(-most[may], kind="stable")]  # the likeliest first
        while len(others):
            j = int(others[0])
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            others = others[1:]
            if 100 * common >= threshold * (n[i] + n[j] - common):
                found.append((i, j))
                a, b = label[i], label[j]
                label[label == max(a, b)] = min(a, b)
                others = others[label[others] != label[i]]
    return found


def _tile(size: int, threshold: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        """One tile: ``node, known, h1, text``; gives links between nodes."""
        with np.errstate(over="ignore"):
            batch = pa.RecordBatch.from_arrays([pa.array(pdf["text"], pa.string())], names=["text"])
            sets: list[np.ndarray] = []
            are: list[int] = []
            for part in slices(batch):
                grams, bounds = _sets(part, size)
                are += _nodes(grams, bounds)[0].tolist()
                sets += [grams[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            # rows that share an id bring each other's texts: a node keeps the text that is its own
            mine = {node: i for i, (node, h1) in enumerate(zip(pdf["node"], pdf["h1"], strict=True)) if are[i] == h1}
            order = sorted(mine.values(), key=lambda i: (len(sets[i]), are[i]))
            nodes, known = pdf["node"].to_numpy()[order], pdf["known"].to_numpy()[order]
            found = _links([sets[i] for i in order], known, threshold)
        return pd.DataFrame({"a": nodes[[i for i, _ in found]], "b": nodes[[j for _, j in found]]}, dtype="int64")

    return work


def _verified(members: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links within tiles of ``node, known, cluster, part``; ``texts`` has those of clustered nodes only."""
    held = members.hint("merge").join(texts, F.col("node") == F.col("tn")).select("node", "known", "cluster", "part", "h1", "text")
    return held.groupBy("cluster", "part").applyInPandas(_tile(size, threshold), "a long, b long")


def _tiles(nodes, grams):
    """Tiles that so many nodes with so many shingles need."""
    return F.ceil(F.greatest(nodes / TILE, grams / TILE_GRAMS, F.lit(1e-9)))


def join(docs: DataFrame, scratch: Scratch, size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    rows = scratch.keep(signatures(docs, size), "rows")
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("size"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = nodes.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "doc", "node").hint("merge")
    own = some.join(named, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & (F.col("doc_id") == F.col("doc")))
    keyed = own.select("node", F.explode("keys").alias("key"))
    shared = scratch.keep(
        keyed.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top"), "keys"
    )
    ties = keyed.join(shared.hint("merge"), F.col("key") == F.col("k")).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    clusters = scratch.keep(
        components(scratch, ties.distinct(), "clusters")
        .withColumnRenamed("node", "cn")
        .join(nodes, F.col("cn") == F.col("node"))
        .select("node", "h1", "doc", "size", F.col("label").alias("cluster")),
        "clusters",
    )
    counts = clusters.groupBy(F.col("cluster").alias("c")).agg(_tiles(F.count(F.lit(1)), F.sum("size")).alias("n_parts"))
    counts = scratch.keep(counts, "counts")
    # the texts of the corpus are shuffled once; tiles of both rounds take theirs from this table
    known = docs.select(F.col("doc_id").alias("d"), "text").where("text IS NOT NULL")
    texts = clusters.hint("merge").join(known, F.col("doc") == F.col("d")).select(F.col("node").alias("tn"), "h1", "text")
    texts = scratch.keep(texts, "texts")
    small = clusters.join(counts.where("n_parts = 1"), F.col("cluster") == F.col("c"))
    members = small.select("node", F.col("node").alias("known"), "cluster", F.lit("").alias("part"))
    big = scratch.keep(clusters.join(counts.where("n_parts > 1"), F.col("cluster") == F.col("c")).drop("c", "n_parts"), "big")
    large = not big.isEmpty()
    if large:
        members = members.unionAll(_by_hub(big, keyed, shared, scratch))
    links = scratch.keep(_verified(members, texts, size, threshold), "links-0")
    if large:
        links = links.unionAll(_across(big, links, texts, scratch, size, threshold))
    label = scratch.keep(components(scratch, links, "linked").withColumnRenamed("node", "ln"), "labels")
    lowest = (
        nodes.drop("size").join(label, F.col("node") == F.col("ln"), "left")
        .select("h1", "h2", "doc", F.coalesce("label", "node").alias("label"))
    )
    least = scratch.keep(lowest.groupBy(F.col("label").alias("l")).agg(F.min("doc").alias("component_id")), "least")
    final = lowest.join(least, F.col("label") == F.col("l")).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "component_id")
    final = scratch.keep(final, "final")
    scratch.drop("nodes", "keys", "clusters", "counts", "texts", "big", "near", "hubs", "bands", "links-0", "first-labels", "large", "main", "labels", "least")
    out = rows.join(final.hint("merge"), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _by_hub(big, keyed, shared, scratch) -> DataFrame:
    """``node, known, cluster, part``: each node in a tile of the smallest hub of its keys, and the hub in each of its tiles."""
    of = keyed.join(big.select(F.col("node").alias("bn"), "size", "cluster"), F.col("node") == F.col("bn"))
    near = of.join(shared.hint("merge"), F.col("key") == F.col("k")).groupBy("node", "size", "cluster").agg(F.min("hub").alias("hub"))
    near = scratch.keep(near, "near")
    hubs = near.groupBy(F.col("hub").alias("h"), F.col("cluster").alias("hc")).agg(_tiles(F.count(F.lit(1)), F.sum("size")).alias("n"))
    hubs = scratch.keep(hubs, "hubs")
    part = lambda chunk: F.concat_ws(":", F.lit("hub"), "h", chunk)
    dealt = near.join(hubs, F.col("hub") == F.col("h")).select("node", "cluster", part(F.pmod(F.xxhash64("node"), F.col("n"))).alias("part"))
    each = hubs.select("h", F.col("hc").alias("cluster"), F.explode(F.expr("sequence(0L, n - 1)")).alias("chunk"))
    both = dealt.unionAll(each.select(F.col("h").alias("node"), "cluster", part(F.col("chunk")).alias("part"))).distinct()
    return both.select("node", F.col("node").alias("known"), "cluster", "part")


def _across(big, links, texts, scratch, size, threshold) -> DataFrame:
    """Links that join what tiles of large clusters left apart.

    In each cluster, ``outside`` are the nodes not in its largest component so
    far. Each meets each node of its own band of sizes and of the two beside
    it: a band is as wide as the threshold, so others can't link. Both sides
    are dealt to parts, ``o`` and ``p``; a tile holds one of each.
    """
    label = scratch.keep(components(scratch, links, "first").withColumnRenamed("node", "ln"), "first-labels")
    band = F.floor(F.log("size") / float(np.log(100 / threshold) * (1 + 1e-9))).alias("band")
    now = scratch.keep(
        big.join(label, F.col("node") == F.col("ln"), "left").select("cluster", "node", "size", band, F.coalesce("label", "node").alias("known")), "large"
    )
    by_part = now.groupBy("cluster", "known").agg(F.count(F.lit(1)).alias("m"))
    main = by_part.groupBy(F.col("cluster").alias("mc")).agg(F.max(F.struct("m", "known")).alias("top"), F.sum("m").alias("all"))
    main = scratch.keep(main.where("top.m < all").select("mc", F.col("top.known").alias("main")), "main")
    open_ = now.join(main, F.col("cluster") == F.col("mc")).withColumn("out", F.col("known") != F.col("main"))
    out = lambda x: F.coalesce(F.sum(F.when(F.col("out"), x)), F.lit(0))
    bands = open_.groupBy("cluster", "band").agg(
        _tiles(F.count(F.lit(1)), F.sum("size")).alias("n_p"), F.when(out(F.lit(1)) > 0, _tiles(out(F.lit(1)), out(F.col("size")))).alias("n_o")
    )
    bands = scratch.keep(bands, "bands")
    left = bands.where("n_o IS NOT NULL").select(F.col("cluster").alias("bc"), F.explode(F.expr("sequence(band - 1, band + 1)")).alias("pb"), F.col("band").alias("ob"), "n_o")
    right = bands.select(F.col("cluster").alias("rc"), F.col("band").alias("rb"), "n_p")
    pairs = left.join(right, (F.col("bc") == F.col("rc")) & (F.col("pb") == F.col("rb"))).drop("rc", "rb")
    part = F.concat_ws(":", F.lit("band"), "ob", "o", "pb", "p").alias("part")
    first = open_.where("out").join(pairs, (F.col("cluster") == F.col("bc")) & (F.col("band") == F.col("ob")))
    first = first.withColumn("o", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_o"))).withColumn("p", F.explode(F.expr("sequence(0L, n_p - 1)")))
    second = open_.join(pairs, (F.col("cluster") == F.col("bc")) & (F.col("band") == F.col("pb")))
    second = second.withColumn("p", F.pmod(F.xxhash64("node"), F.col("n_p"))).withColumn("o", F.explode(F.expr("sequence(0L, n_o - 1)")))
    both = first.select("node", "known", "cluster", part).unionAll(second.select("node", "known", "cluster", part)).distinct()
    return _verified(both, texts, size, threshold)
