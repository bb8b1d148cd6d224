"""Exact k-means over integer vectors with sorted centres (sort-means).

Each round lists, for every centre, the other centres by their distance from
it. A vector starts at the centre it belonged to, walks that list and stops at
the first centre strictly further from its own than twice its distance: by the
triangle inequality nothing behind it is as near. All numbers are integers, so
results depend on no order of summing. A round is one Arrow pass that writes
vectors with their centre to the shared folder, and component sums that every
task adds up for itself; only those of ``k`` centres reach the driver.

Defined results: vectors that are null, don't have ``dims`` components, or hold
null or non-finite ones are left out (and components beyond ``FURTHEST``, which
no single-precision number reaches); rows that repeat, share an id or have a
null one are rows of their own (an id without a value hashes as the empty
string); with fewer than ``k`` vectors there are as many centres; other columns
are ignored. Distances and sums beyond a long are given as its largest value.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

K, DIMS, ROUNDS, SCALE = 40, 64, 5, 256
LONGEST = (1 << 63) - 1
FURTHEST = 2.0**150  # beyond the range of single-precision components
#: Components up to here keep squared distances of 64 of them exact in doubles, and in 64-bit integers.
_DOUBLE, _LONG = 1 << 22, 1 << 27


def prepared(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: kept vectors as integers, ``floor(scale * x)``, as decimals without fraction where a long is too short."""
    x = F.col("embedding")
    fine = lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf"))
    kept = vectors.where(x.isNotNull() & (F.size(x) == dims) & F.forall(x, fine))
    down = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger doubles are whole
    whole = kept.select("vec_id", F.transform(x, lambda e: down(e.cast("double") * scale)).alias("v"))
    return whole.where(F.forall("v", lambda y: F.abs(y) <= FURTHEST))


def _whole(flat: np.ndarray, dims: int) -> np.ndarray:
    """Integers of doubles, in the narrowest kind that keeps distances exact."""
    most = np.abs(flat).max(initial=0)
    if most < _DOUBLE:
        return flat.reshape(-1, dims)
    if most < _LONG:
        return flat.astype(np.int64).reshape(-1, dims)
    return np.array([int(x) for x in flat], object).reshape(-1, dims)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    difference = a - b
    return (difference * difference).sum(1)


@dataclass
class Centres:
    """Centres as integers, and for each the others by distance."""

    rows: list[tuple[int, ...]]

    def __post_init__(self):
        self.exact = np.array(self.rows, object).reshape(len(self.rows), -1)
        apart = np.array([_squares(self.exact, c) for c in self.exact], object)
        self.order = [sorted((j for j in range(len(self.rows)) if j != i), key=lambda j: (apart[i][j], j)) for i in range(len(self.rows))]
        self.reach = [[apart[i][j] for j in self.order[i]] for i in range(len(self.rows))]
        self.most = max((abs(x) for c in self.rows for x in c), default=0)

    def kind(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and centres in one kind of number that is exact for both."""
        if v.dtype == np.float64 and self.most < _DOUBLE:
            return v, self.exact.astype(np.float64)
        if v.dtype != object and self.most < _LONG:
            return v.astype(np.int64), self.exact.astype(np.int64)
        return np.array([[int(x) for x in row] for row in v], object).reshape(v.shape), self.exact

    def nearest(self, v: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each vector: its centre and squared distance, found from the centre it had; and how many distances that took."""
        v, centres = self.kind(v)
        best, at, looked = np.zeros(len(v), v.dtype), before.copy(), 0
        for c in np.unique(before):
            members = np.flatnonzero(before == c)
            own = _squares(v[members], centres[c])
            far = np.argsort(-own, kind="stable")
            members, own = members[far], own[far]
            low, name = own.copy(), np.full(len(members), c)
            looked += len(members)
            for j, reach in zip(self.order[c], self.reach[c], strict=True):
                n = int(np.count_nonzero(own >= -(-reach // 4)))  # squares: the reach is at most twice the distance
                if not n:
                    break
                d = _squares(v[members[:n]], centres[j])
                looked += n
                closer = (d < low[:n]) | ((d == low[:n]) & (j < name[:n]))
                low[:n][closer], name[:n][closer] = d[closer], j
            best[members], at[members] = low, name
        return at, best, looked


def assigned(vectors: DataFrame, centres: Centres, dims: int = DIMS) -> DataFrame:
    """``vec_id, v, cluster, distance`` (distance as a decimal); a vector without a ``cluster`` starts at the first centre."""
    ids = vectors.schema["vec_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            at, best, _ = centres.nearest(_whole(flat, dims), batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64))
            distance = pa.array([min(int(x), LONGEST) for x in best], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(at.astype(np.int32)), distance], names=["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(work, f"vec_id {ids}, v array<double>, cluster int, distance long")


def _sums(members: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Count and exact component sums of every centre's vectors: a task adds its own up, Spark adds the tasks' in two parts of 76 bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: Counter = Counter()
        for batch in batches:
            v = _whole(batch.column("v").flatten().to_numpy(zero_copy_only=False), dims)
            v = v.astype(np.int64) if v.dtype == np.float64 else v
            at = batch.column("cluster").to_numpy()
            for c in np.unique(at).tolist():
                own = v[at == c]
                count[c] += len(own)
                total[c] = total.get(c, 0) + own.sum(0).astype(object)
        out = [(c, j, count[c], int(x) >> 76, int(x) & ((1 << 76) - 1)) for c, xs in total.items() for j, x in enumerate(xs)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0)]
        columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "j", "n", "high", "low"])

    parts = members.select("cluster", "v").mapInArrow(work, "cluster int, j int, n long, high decimal(38, 0), low decimal(38, 0)")
    rows = parts.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("cluster", "j").collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        found.setdefault(r["cluster"], (r["n"], []))[1].append((int(r["high"]) << 76) + int(r["low"]))
    return found


def cluster(vectors: DataFrame, scratch: Scratch, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: str = "2:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every kept vector.

    Centres start as the ``k`` vectors of the smallest ``sha256(seed || vec_id)``, ties by components.
    """
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = scratch.keep(prepared(vectors, dims).withColumn("cluster", F.lit(0)), "vectors")
    first = rows.orderBy(name, "vec_id", "v").limit(k).select("v").collect()
    if not first:
        return rows.select("vec_id", "cluster", *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    centres = Centres([tuple(int(x) for x in r["v"]) for r in first])
    for step in range(rounds):
        rows = scratch.keep(assigned(rows, centres, dims), f"round-{step}")
        scratch.drop(f"round-{step - 1}" if step else "vectors")
        found = _sums(rows, dims)
        moved = [tuple(s // found[i][0] for s in found[i][1]) if i in found else c for i, c in enumerate(centres.rows)]
        centres = Centres(moved)
    final = scratch.keep(assigned(rows, centres, dims).drop("v"), "final")
    scratch.drop(f"round-{rounds - 1}")
    inertia = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()}
    whole = min(sum(inertia.values()), LONGEST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.rows]
    own = F.array(*(F.lit(min(inertia.get(i, 0), LONGEST)).cast("long") for i in range(len(digest))))
    return final.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), F.get(F.array(*map(F.lit, digest)), F.col("cluster")).alias("centroid_sha256")
    )
