"""Superposition against singular values, assignment against all permutations and a second implementation."""

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chelate.constants import POLYHEDRA
from chelate.functions import alignment

POINTS = "array<struct<x:double,y:double,z:double>>"


def by_svd(p, q, transposed=False):
    a, b = p - p.mean(0), q - q.mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    sign = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    r = vt.T @ sign @ u.T
    return np.sqrt((((a @ (r if transposed else r.T)) - b) ** 2).sum(1).mean()), r


def turned(rng, p):
    m, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return p @ (m * np.sign(np.linalg.det(m))).T + rng.normal(size=3)


@pytest.fixture(scope="module")
def sets():
    """Random sets, copies, mirror images, flat and straight ones, single points, all alike."""
    rng, out = np.random.default_rng(1), []
    for n in (1, 2, 3, 4, 6, 9, 30):
        for _ in range(12):
            p = rng.normal(size=(n, 3)) * 3
            out += [(p, rng.normal(size=(n, 3))), (p, turned(rng, p)), (p, turned(rng, p * [1, 1, -1])), (p * [1, 1, 0], turned(rng, p)), (p * [1, 0, 0], turned(rng, p * [1, 0, 0])), (p * 0 + 2, p)]
    return out


def test_equals_svd(spark, sets):
    rows = [(i, [tuple(map(float, x)) for x in p], [tuple(map(float, x)) for x in q]) for i, (p, q) in enumerate(sets)]
    df = spark.createDataFrame(rows, f"i int, p {POINTS}, q {POINTS}")
    for r in df.select("i", alignment.kabsch(F.col("p"), F.col("q")).alias("k")).collect():
        p, q = sets[r.i]
        want, _ = by_svd(p, q)
        assert r.k.rmsd == pytest.approx(want, abs=1e-9)
        m = np.array(r.k.rotation).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
        a, b = p - p.mean(0), q - q.mean(0)
        assert np.sqrt(((a @ m.T - b) ** 2).sum(1).mean()) == pytest.approx(want, abs=1e-9)


def test_transposed(spark, sets):
    """The other way round agrees where the rotation is unique."""
    some = [(p, q) for p, q in sets if len(p) > 4 and np.linalg.svd((p - p.mean(0)).T @ (q - q.mean(0)))[1][1] > 0.1]
    df = spark.createDataFrame([(i, [tuple(map(float, x)) for x in p], [tuple(map(float, x)) for x in q]) for i, (p, q) in enumerate(some)], f"i int, p {POINTS}, q {POINTS}")
    got = {r.i: r.d for r in df.select("i", alignment.kabsch(F.col("p"), F.col("q"), transposed=True).rmsd.alias("d")).collect()}
    near = sum(abs(got[i] - by_svd(p, q, True)[0]) < 1e-7 for i, (p, q) in enumerate(some))
    assert len(some) > 60 and near >= 0.95 * len(some)  # the rest are mirror images with two equal axes


def test_odd_sets(spark):
    nan = float("nan")
    rows = [(None, [(0.0, 0.0, 0.0)]), ([], []), ([(0.0, 0.0, 0.0)], [(1.0, 1.0, 1.0), (2.0, 2.0, 2.0)]), ([(nan, 0.0, 0.0)], [(1.0, 1.0, 1.0)]), ([None], [(1.0, 1.0, 1.0)]), ([(None, 0.0, 0.0)], [(1.0, 1.0, 1.0)]), ([(5.0, 0.0, 0.0)], [(1.0, 1.0, 1.0)])]
    df = spark.createDataFrame(rows, f"p {POINTS}, q {POINTS}")
    got = [r.k and r.k.rmsd for r in df.select(alignment.kabsch(F.col("p"), F.col("q")).alias("k")).collect()]
    assert got == [None] * 6 + [0.0]
    assert df.where("false").select(alignment.kabsch(F.col("p"), F.col("q"))).count() == 0


@pytest.mark.parametrize("n", range(1, 8))
def test_assignment_equals_all_permutations(n):
    rng = random.Random(n)
    for k in range(40 if n < 7 else 8):
        cost = [[rng.choice([0.0, 1.0, 2.0]) if k % 2 else rng.random() * 9 for _ in range(n)] for _ in range(n)]
        way = alignment.least_assignment(cost)
        assert sorted(way) == list(range(n))
        assert sum(cost[i][j] for i, j in enumerate(way)) == pytest.approx(min(sum(cost[i][j] for i, j in enumerate(o)) for o in permutations(range(n))))


def by_subsets(cost):
    """Least total cost by dynamic programming over sets of columns."""
    n = len(cost)
    best = [math.inf] * (1 << n)
    best[0] = 0.0
    for s in range(1 << n):
        i = s.bit_count()
        for j in range(n):
            if i < n and not s >> j & 1:
                best[s | 1 << j] = min(best[s | 1 << j], best[s] + cost[i][j])
    return best[-1]


def test_assignment_of_twelve():
    rng = random.Random(12)
    for _ in range(5):
        cost = [[rng.random() for _ in range(12)] for _ in range(12)]
        way = alignment.least_assignment(cost)
        assert sum(cost[i][j] for i, j in enumerate(way)) == pytest.approx(by_subsets(cost))


def test_measures(spark):
    """Ideal arrangements, turned, moved and in any order, measure 0 against themselves."""
    rng, rows = np.random.default_rng(4), []
    for n, shapes in POLYHEDRA.items():
        for label, points in shapes.items():
            p = 1.7 * np.array(points, float)[rng.permutation(n)] + rng.normal(size=3)
            rows.append((n, alignment.LABELS.get((n, label), label), [tuple(map(float, x)) for x in p]))
    rows += [(0, "", [(1.0, 1.0, 1.0)] * 4), (0, "many", [(float(i), 0.0, 0.0) for i in range(8)]), (0, "null", None)]
    df = spark.createDataFrame(rows, f"n int, label string, p {POINTS}")
    got = {r.label: r.m for r in df.select("label", alignment.assignment_measures(F.col("p")).alias("m")).collect()}
    assert got["null"] is None and got["many"] == [] and [m.value for m in got[""]] == [math.inf] * 2
    for n, label, _ in rows[:-3]:
        values = {m.label: m.value for m in got[label]}
        assert set(values) == {alignment.LABELS.get((n, s), s) for s in POLYHEDRA[n]}
        assert values[label] == pytest.approx(0, abs=1e-9) and all(v > 1 for s, v in values.items() if s != label)
