"""Shape measures of many complexes at once: rows of an Arrow batch with equally many donors are stacked arrays.

The steps are those of functions.geometry, number for number and in the same order, so both give the
same measures; there they are SQL over one row at a time.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from chelate.constants import POLYHEDRA, orders, polyhedron

#: The signature's base and modulus, the numbers that it takes and their scale.
BASE, MODULUS, TAKEN, SCALE = 100_003, 10**15, 6, 10_000
#: Rows that are measured over all assignments at once.
ROWS = 256


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])


def added(x: np.ndarray) -> np.ndarray:
    """The sum along the last axis, from the first number to the last."""
    total = np.zeros(x.shape[:-1])
    for k in range(x.shape[-1]):
        total = total + x[..., k]
    return total


def signatures(features: np.ndarray) -> np.ndarray:
    """geometry.signature() of rows of numbers; products stay below 64 bits."""
    s = np.zeros(features.shape[:-1], np.int64)
    for k in range(min(TAKEN, features.shape[-1])):
        moved = (s * 1000 % MODULUS * 100 + s * (BASE - 100_000)) % MODULUS
        s = (moved + np.rint(features[..., k] * SCALE).astype(np.int64)) % MODULUS
    return s


@cache
def template(n: int, label: str) -> tuple[np.ndarray, np.ndarray]:
    """The distance matrix of a polyhedron, and its rows sorted."""
    points = polyhedron(POLYHEDRA[n][label])
    dq = np.array([[sum((a[k] - b[k]) ** 2 for k in range(3)) ** 0.5 for b in points] for a in points])
    return dq, np.sort(dq, 1)


def greedy(ds: np.ndarray, sq: np.ndarray) -> np.ndarray:
    """The vertex of each row of points, in order: of the free ones that whose sorted distances differ least, the first on a tie."""
    rows, n = ds.shape[:2]
    way, taken = np.zeros((rows, n), np.int64), np.zeros((rows, n), bool)
    for i in range(n):
        cost = np.broadcast_to(1e-10 * np.arange(n), (rows, n))
        for k in range(n):
            d = ds[:, i, k, None] - sq[None, :, k]
            cost = cost + d * d
        way[:, i] = np.where(taken, np.inf, cost).argmin(1)
        taken[np.arange(rows), way[:, i]] = True
    return way


def off(dp: np.ndarray, dq: np.ndarray) -> np.ndarray:
    d = dp - dq
    return added((d * d).reshape(*d.shape[:-2], -1))


def measures(points: np.ndarray, metal: np.ndarray, assignment: str) -> np.ndarray:
    """Values (rows, labels) of stacked donors (rows, n, 3) about their metals (rows, 3)."""
    rows, n = points.shape[:2]
    far = distance(points, metal[:, None])
    pairs = np.sort(distance(points[:, :, None], points[:, None]), 2)
    order = np.argsort(signatures(np.concatenate([far[..., None], pairs], 2)), 1, kind="stable")
    points, far = np.take_along_axis(points, order[..., None], 1), np.take_along_axis(far, order, 1)
    mean = added(far) / n
    scaled = (points - metal[:, None]) / np.where(mean > 1e-6, mean, 1.0)[:, None, None]
    dp = distance(scaled[:, :, None], scaled[:, None])
    total = added((dp * dp).reshape(rows, -1))
    ds, out = np.sort(dp, 2), []
    for label in POLYHEDRA[n]:
        dq, sq = template(n, label)
        if assignment == "exact":
            ways = np.array(orders(n))
            turned = dq[ways[:, :, None], ways[:, None, :]]
            least = [off(dp[a : a + ROWS, None], turned[None]).min(1) for a in range(0, rows, ROWS)]
            value = np.concatenate(least)
        else:
            way = greedy(ds, sq)
            value = off(dp, dq[way[:, :, None], way[:, None, :]])
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append(np.where(total < 1e-10, np.inf, 100 * value / total))
    return np.stack(out, 1)


def shape_values(points: Column, metal: Column, assignment: str) -> Column:
    """Measures against each polyhedron of the number of points, in label order; empty for other numbers, null without points or metal."""

    @F.arrow_udf("array<double>")
    def values(points: pa.Array, metal: pa.Array) -> pa.Array:
        out: list = [None] * len(points)
        by: dict[int, list[int]] = defaultdict(list)
        xyz = [pc.struct_field(x, f) for x in (points.values, metal) for f in ("x", "y", "z")]
        flat = np.stack([c.to_numpy(zero_copy_only=False) for c in xyz[:3]], 1)
        centre = np.stack([c.to_numpy(zero_copy_only=False) for c in xyz[3:]], 1)
        ends, absent = points.offsets.to_numpy(), points.is_null().to_numpy(zero_copy_only=False) | metal.is_null().to_numpy(zero_copy_only=False)
        size = np.diff(ends)
        for i in np.flatnonzero(~absent).tolist():
            n = int(size[i])
            if n in POLYHEDRA:
                by[n].append(i)
            else:
                out[i] = []
        for n, rows in by.items():
            at = ends[np.array(rows)][:, None] + np.arange(n)
            for i, v in zip(rows, measures(flat[at].astype(float), centre[rows].astype(float), assignment).tolist(), strict=True):
                out[i] = v
        return pa.array(out, pa.list_(pa.float64()))

    return values(points, metal)
