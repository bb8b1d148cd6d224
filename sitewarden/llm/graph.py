"""Connected components of a table of links, by alternating star steps.

Each large-star step ties a node's larger neighbours to the smallest node it
knows, each small-star step ties its smaller ones; the links end as stars whose
centre is the smallest node of the component. Rounds grow with the logarithm of
the nodes; every round is written to the shared folder. No group is gathered:
minima are partial aggregates, and they are joined as tables whose large
partitions Spark can split.

Before the steps, tasks contract up to ``AT_ONCE`` links each to fewer ones with
the same components. Links that fit one such batch are stars then, so that small
tables take no rounds; more links are dealt to more tasks, and steps follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

AT_ONCE = 1 << 18  # links that a task contracts at once


class Forest:
    """Union-find over numbers 0 .. n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every ``AT_ONCE`` links as stars: fewer links with the same components."""

    def stars(rows: pa.Table) -> pa.RecordBatch:
        u, v = (rows.column(c).to_numpy() for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = Forest(len(nodes))
        for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            forest.join(a, b)
        root = np.array([forest.root(i) for i in range(len(nodes))], np.int64)
        own = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if count and count + batch.num_rows > AT_ONCE:
            yield stars(pa.Table.from_batches(held))
            held, count = [], 0
        held.append(batch)
        count += batch.num_rows
    if count:
        yield stars(pa.Table.from_batches(held))


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``; the label is the smallest node reachable.

    Links of a node with itself and links with a null are ignored.
    """
    edges = links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    fewer = scratch.keep(edges.mapInArrow(_contract, "u long, v long"), f"{name}-fewer")
    small = fewer.count() <= AT_ONCE  # one task's share: stars at once
    edges = scratch.keep(fewer.coalesce(1).mapInArrow(_contract, "u long, v long") if small else fewer.distinct(), f"{name}-0")
    scratch.drop(f"{name}-fewer")
    before, step = None, 0
    while not small:
        seal = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))")).first()
        if seal == before or seal[0] == 0:
            break
        before, step = seal, step + 1
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(
            both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m")).select("at", F.least("at", "m").alias("m")),
            f"{name}-low-{step}",
        )
        large = edges.join(low, F.col("v") == F.col("at")).select("u", F.col("m").alias("v")).distinct()
        least = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        stars = least.select(F.explode(F.expr("array(struct(u, m), struct(v AS u, m))")).alias("e")).select("e.u", F.col("e.m").alias("v"))
        edges = scratch.keep(stars.where("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-low-{step}", f"{name}-{step - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
