"""Sort-means against Lloyd's rounds in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from sitewarden.llm import sortmeans
from sitewarden.llm.common import Scratch


def lloyd(rows, k, dims, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[0] or 0, r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centres)]
    out = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, c in out:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    whole = sum(inertia.values())
    return sorted(((i is None, i or 0), c, d, inertia[c], whole, digest[c]) for i, d, c in out)


def found(spark, rows, k, dims, rounds, kind="float"):
    v = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'x' AS cluster", "1 AS v", "2 AS distance").repartition(3)
    got = sortmeans.cluster(v, Scratch(spark), k, dims, rounds).collect()
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


@pytest.mark.parametrize("spread", [0.01, 1.0, 1e5])
def test_rounds(spark, spread):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(i % 7, 0.4) * spread)) for _ in range(6)]) for i in range(300)]
    rows += [(900, rows[0][1]), (900, rows[1][1]), (None, rows[2][1]), (901, None), (902, [1.0] * 5), (903, [float("nan")] * 6), (904, [None] + [1.0] * 5), (905, [float("inf")] * 6)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # a third of all vectors are one, ties between its copies as centres
    assert found(spark, rows, 12, 6, 4) == lloyd(rows, 12, 6, 4)


def test_far_and_few(spark):
    rows = [(1, [3e30, -1.0]), (2, [3e30, 5.0]), (3, [0.25, -0.001]), (4, [-0.0, 1e-30])]
    got, want = found(spark, rows, 2, 2, 3, "double"), lloyd(rows, 2, 2, 3)
    assert [(a, b, f) for a, b, _, _, _, f in got] == [(a, b, f) for a, b, _, _, _, f in want]
    assert [r[2] for r in got] == [min(r[2], sortmeans.LONGEST) for r in want]
    assert found(spark, rows[2:], 40, 2, 2, "double") == lloyd(rows[2:], 40, 2, 2)
    assert found(spark, [(7, None)], 40, 2, 2) == []


def test_scan_stops_early():
    """Vectors close to their centre look at few others."""
    rng = np.random.default_rng(1)
    centres = sortmeans.Centres([tuple(int(x) for x in c) for c in rng.integers(-5000, 5000, (40, 8))])
    v = np.repeat(np.array(centres.rows, np.float64), 25, 0) + rng.integers(-20, 20, (1000, 8))
    at, best, looked = centres.nearest(v, np.repeat(np.arange(40), 25))
    assert (at == np.repeat(np.arange(40), 25)).all() and looked < 2 * len(v) and (best <= 8 * 400).all()
