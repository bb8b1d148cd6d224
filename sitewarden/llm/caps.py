"""Near-duplicate embeddings through spherical-cap filters.

A filter is a direction of a structured random product code: a fixed random
rotation cuts a vector into two halves, each half has a code book of ``C`` unit
vectors, and each pair of code words is one of ``C * C`` directions. A vector is
list-decoded to all directions whose score exceeds a cap height: code words
that cannot reach it with the best partner are skipped, the rest are summed.
``TABLES`` codes are used; a vector with short lists takes its ``LEAST`` best
directions of each code instead, so that none is lonely. Vectors that share a
filter are compared in double precision.

Code books grow with the square root of the vectors, so the vectors per filter
stay about the same. Equal vectors are one class with a multiplicity. A filter
with many vectors is dealt to tiles of pairs of blocks; a pair is counted only
under its first common filter, and no pair leaves a tile: only link counts per
class and a spanning forest do. A tile gets the components as they are in the
table (not widened) and, per vector, the filters before its own.

Defined results: null vectors, zero vectors and vectors with a null or
non-finite component link with nothing and are their own component. Rows that
repeat an id are rows of their own, whatever their vectors: each has the links
of its vector, and the smallest id among those it reaches as its component. A
null id is never linked, and kept. Components are scaled before they are
squared, so very large and very small ones count like others. Other columns (labels too) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components

COSINE = 0.95
TABLES = 3
LIST = 8  # expected directions of a vector in each code
LEAST = 4
LOAD = 100  # vectors per filter aimed at
BLOCK = 1024


class Codes:
    """The product codes for ``dim`` dimensions and ``n`` vectors."""

    def __init__(self, dim: int, n: int):
        self.size = max(32, min(8192, ceil(sqrt(n * LIST / LOAD))))
        rng = np.random.default_rng(20_240_607)
        self.half = (dim + 1) // 2
        self.tables = []
        for _ in range(TABLES):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            books = [rng.standard_normal((self.size, k)) for k in (self.half, dim - self.half) if k]
            self.tables.append((turn, [b / np.linalg.norm(b, axis=1, keepdims=True) for b in books]))
        deviation = sqrt(sum(1 / dim for _ in books))  # of a score, for a random unit vector
        self.height = deviation * NormalDist().inv_cdf(1 - min(0.25, LIST / self.size ** len(books)))

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The ascending filter numbers of each row of unit vectors."""
        found = [[] for _ in unit]
        for t, (turn, books) in enumerate(self.tables):
            x = unit @ turn
            scores = [x[:, : self.half] @ books[0].T]
            scores.append(x[:, self.half :] @ books[1].T if len(books) > 1 else np.zeros((len(x), 1)))
            width = scores[1].shape[1]
            for i, (p, q) in enumerate(zip(*scores, strict=True)):
                a = np.flatnonzero(p >= self.height - q.max())
                b = np.flatnonzero(q >= self.height - p.max())
                s = p[a][:, None] + q[b][None, :]
                r, c = np.nonzero(s >= self.height)
                if len(r) < LEAST:
                    a, b = np.argsort(-p, kind="stable")[:LEAST], np.argsort(-q, kind="stable")[:LEAST]
                    s = p[a][:, None] + q[b][None, :]
                    best = np.argsort(-s, axis=None, kind="stable")[:LEAST]
                    r, c = np.unravel_index(best, s.shape)
                found[i].append(t * self.size * width + a[r] * width + b[c])
        return [np.unique(np.concatenate(f)).astype(np.int64) for f in found]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _numbers(classes: DataFrame) -> str:
    """The type of a component as Numpy names it: 4 bytes where the table has no more."""
    return "<f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def filters(classes: DataFrame, dim: int, n: int) -> DataFrame:
    """``cls, mult, vector, list, filters``: the vector and the filters as bytes, the filters as an array."""
    kind = _numbers(classes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(dim, n)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            lists = codes.decode(_unit(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cls"),
                    batch.column("mult"),
                    pa.array([x.tobytes() for x in rows], pa.binary()),
                    pa.array([x.astype("<i4").tobytes() for x in lists], pa.binary()),
                    pa.array(lists, pa.list_(pa.int64())),
                ],
                names=["cls", "mult", "vector", "list", "filters"],
            )

    return classes.select("cls", "mult", "embedding").mapInArrow(
        work, "cls long, mult long, vector binary, list binary, filters array<long>"
    )


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a symmetric relation."""
    left, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            j = front.pop()
            new = np.flatnonzero(near[j] & left)
            left[new] = False
            out += [(j, k) for k in new.tolist()]
            front += new.tolist()
    return out


def _compare(cosine: float, kind: str):
    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """One tile: counts ``(a, links)`` and links ``(a, b)``."""
        _, first, second = key
        pdf = pdf.sort_values("cls")
        x = _unit(np.frombuffer(b"".join(pdf["vector"]), kind).reshape(len(pdf), -1))
        cls, mult, block = pdf["cls"].to_numpy(), pdf["mult"].to_numpy(), pdf["block"].to_numpy()
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if first != second:
            near &= block[:, None] != block[None, :]
        earlier = [np.frombuffer(b, "<i4") for b in pdf["earlier"]]
        names, at = np.unique(np.concatenate(earlier), return_inverse=True)
        has = np.zeros((len(pdf), len(names)), np.float32)
        has[np.repeat(np.arange(len(pdf)), [len(e) for e in earlier]), at] = 1
        near &= has @ has.T == 0  # else the pair is counted under an earlier filter
        links = near @ mult
        some = links > 0
        spans = _forest(near)
        return pd.DataFrame(
            {
                "a": np.concatenate([cls[some], cls[[i for i, _ in spans]]]).astype(np.int64),
                "b": pd.array([None] * int(some.sum()) + cls[[j for _, j in spans]].tolist(), "Int64"),
                "links": pd.array(links[some].tolist() + [None] * len(spans), "Int64"),
            }
        )

    return work


def near_duplicates(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    sound = (
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))"
        " AND exists(embedding, x -> x <> 0)"
    )
    keyed = vectors.select(
        "vec_id",
        "embedding",
        F.expr(f"coalesce({sound}, false)").alias("sound"),
        F.xxhash64("embedding").alias("h1"),
        F.hash("embedding").alias("h2"),
    )
    good = keyed.where("sound")
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding"))
    classes = scratch.keep(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per dimension
    found = None
    for dim, n in sizes:
        some = _links(classes.where(F.size("embedding") == dim), dim, n, scratch, cosine)
        found = some if found is None else found.unionAll(some)
    if found is None:
        return vectors.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    found = scratch.keep(found, "found")
    label = components(scratch, found.where("b IS NOT NULL").select("a", "b"), "components")
    counts = found.where("links IS NOT NULL").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    labelled = scratch.keep(
        classes.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "cls", "mult", "low")
        .join(counts, F.col("cls") == F.col("c"), "left")
        .join(label, F.col("cls") == F.col("node"), "left")
        .select("r1", "r2", "low", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("label", "cls").alias("label")),
        "labelled",
    )
    least = labelled.groupBy(F.col("label").alias("l")).agg(F.min("low").alias("least"))
    result = scratch.keep(labelled.join(least, F.col("label") == F.col("l")).select("r1", "r2", "links", "least"), "result")
    scratch.drop("classes", "found", "labelled", *(f"{name}-{dim}" for name in ("decoded", "load") for dim, _ in sizes))
    out = keyed.drop("embedding").join(result, F.col("sound") & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("least", "vec_id"), F.lit(True)).alias("kept"),
    )


def _links(classes: DataFrame, dim: int, n: int, scratch: Scratch, cosine: float) -> DataFrame:
    decoded = scratch.keep(filters(classes.repartition(F.col("cls")), dim, n), f"decoded-{dim}")
    pairs = decoded.select(F.col("cls").alias("vc"), F.posexplode("filters").alias("rank", "filter"))
    blocks = F.ceil(F.col("m") / BLOCK)
    load = scratch.keep(
        pairs.groupBy(F.col("filter").alias("f")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("f", blocks.alias("k")), f"load-{dim}"
    )
    block = F.pmod(F.xxhash64("vc"), F.col("k"))
    dealt = pairs.join(load, F.col("filter") == F.col("f")).select("vc", "rank", "filter", "k", block.alias("block"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select(
        "vc", "rank", "filter", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    )
    held = tiles.join(decoded.drop("filters"), F.col("vc") == F.col("cls"))
    held = held.withColumn("earlier", F.expr("substring(list, 1, 4 * rank)")).drop("vc", "rank", "list")
    return held.groupBy("filter", "first", "second").applyInPandas(_compare(cosine, _numbers(classes)), "a long, b long, links long")
