"""Superposition of point sets, and measures of shape with vertices assigned by their distances.

Rows of an Arrow batch that have equally many points are worked on together, as stacked arrays.
"""

from __future__ import annotations

from collections import defaultdict
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from chelate.constants import POLYHEDRA, polyhedron

#: The labels of these measures, where they are not those of POLYHEDRA.
LABELS = {(2, "L"): "L-2", (3, "TP"): "TP-3", (6, "TPr"): "TP"}
SUPERPOSED = "struct<rmsd:double,rotation:array<double>>"


def superposed(p: np.ndarray, q: np.ndarray, transposed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The root mean square distances and rotations of stacked sets p (k, n, 3) onto q.

    Of the rotations about the centroids, none of which is a mirror image, the one with the least
    distance: the main axis of Horn's quaternion matrix. transposed: points are turned the other way,
    as a calculator did whose values may be needed; that distance is not the least.
    """
    a, b = p - p.mean(1, keepdims=True), q - q.mean(1, keepdims=True)
    m = np.einsum("kni,knj->kij", a, b)
    k = np.empty((len(p), 4, 4))
    k[:, 0, 0] = np.trace(m, axis1=1, axis2=2)
    skew = np.stack([m[:, 1, 2] - m[:, 2, 1], m[:, 2, 0] - m[:, 0, 2], m[:, 0, 1] - m[:, 1, 0]], 1)
    k[:, 0, 1:] = k[:, 1:, 0] = skew
    k[:, 1:, 1:] = m + m.transpose(0, 2, 1) - k[:, 0, 0, None, None] * np.eye(3)
    w, x, y, z = np.linalg.eigh(k)[1][:, :, -1].T
    rotation = np.stack([w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z], 1).reshape(-1, 3, 3)
    moved = np.einsum("kij,kni->knj" if transposed else "kij,knj->kni", rotation, a)
    return np.sqrt(((moved - b) ** 2).sum(2).mean(1)), rotation


def least_assignment(cost: list[list[float]]) -> list[int]:
    """Each row's column in an assignment of least total cost, by shortest augmenting paths with potentials."""
    n = len(cost)
    row_of = [-1] * n
    rows, columns = [0.0] * n, [0.0] * n
    for start in range(n):
        dist, before, done = [inf] * n, [-1] * n, [False] * n
        row, at, reached = start, -1, 0.0
        while row >= 0:
            for j in range(n):
                if not done[j] and (d := reached + cost[row][j] - rows[row] - columns[j]) < dist[j]:
                    dist[j], before[j] = d, at
            at = min((j for j in range(n) if not done[j]), key=dist.__getitem__)
            done[at], reached, row = True, dist[at], row_of[at]
        rows[start] += reached
        for j in range(n):
            if done[j] and row_of[j] >= 0:
                rows[row_of[j]] += reached - dist[j]
            if done[j]:
                columns[j] -= reached - dist[j]
        while at >= 0:
            row_of[at] = row_of[before[at]] if before[at] >= 0 else start
            at = before[at]
    out = [0] * n
    for j, i in enumerate(row_of):
        out[i] = j
    return out


def stacked(rows: list) -> dict[int, list[int]]:
    """Rows by their number of points; rows without a whole set have none."""
    by: dict[int, list[int]] = defaultdict(list)
    for i, r in enumerate(rows):
        if r:
            by[len(r)].append(i)
    return by


def points_of(array: pa.Array) -> list:
    """Each row's points; None where the row, a point or a coordinate is null or not finite."""
    out = []
    for row in array.to_pylist():
        points = None if row is None or any(p is None for p in row) else [(p["x"], p["y"], p["z"]) for p in row]
        out.append(points if points is not None and all(v is not None and abs(v) < inf for p in points for v in p) else None)
    return out


def coordinates(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """points_of() as arrays: all points (m, 3), where each row's begin, and how many it has, -1 where it has no whole set."""
    flat = np.stack([pc.struct_field(array.values, f).to_numpy(zero_copy_only=False) for f in "xyz"], 1).astype(float)
    ends = array.offsets.to_numpy()
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat).all(1))])  # a null is no number either
    whole = ~array.is_null().to_numpy(zero_copy_only=False) & (odd[ends[1:]] == odd[ends[:-1]])
    return flat, ends[:-1], np.where(whole, np.diff(ends), -1)


def kabsch(p: Column, q: Column, transposed: bool = False) -> Column:
    """rmsd and rotation (row by row) of points onto points, arrays of (x, y, z); null where they differ in number, are none or not finite."""

    @F.arrow_udf(SUPERPOSED)
    def onto(p: pa.Array, q: pa.Array) -> pa.Array:
        pairs = [(*a, *b) if a and b and len(a) == len(b) else None for a, b in zip(points_of(p), points_of(q), strict=True)]
        out: list = [None] * len(pairs)
        for n, rows in stacked(pairs).items():
            both = np.array([pairs[i] for i in rows], float)
            rmsd, rotation = superposed(both[:, : n // 2], both[:, n // 2 :], transposed)
            for i, d, r in zip(rows, rmsd.tolist(), rotation.reshape(len(rows), 9).tolist(), strict=True):
                out[i] = {"rmsd": d, "rotation": r}
        return pa.array(out, pa.struct([("rmsd", pa.float64()), ("rotation", pa.list_(pa.float64()))]))

    return onto(p, q)


def templates(n: int) -> dict[str, list[tuple[float, float, float]]]:
    return {LABELS.get((n, label), label): polyhedron(points) for label, points in POLYHEDRA.get(n, {}).items()}


def assigned(points: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stacked points (k, n, 3) the vertex of each with the least sum of distances, and that sum.

    For the first points and each set of as many vertices, the least sum comes from the sets without one
    vertex: 2 ** n sets for all rows at once, n being at most six here.
    """
    k, n = points.shape[:2]
    cost = np.sqrt(((points[:, :, None] - template[None, None]) ** 2).sum(3))
    least, last = np.full((1 << n, k), inf), np.zeros((1 << n, k), np.int8)
    least[0] = 0
    for taken in range(1, 1 << n):
        i = taken.bit_count() - 1
        for j in range(n):
            if taken >> j & 1:
                d = least[taken ^ 1 << j] + cost[:, i, j]
                better = d < least[taken]
                least[taken][better], last[taken][better] = d[better], j
    way, taken, rows = np.zeros((k, n), np.int64), np.full(k, (1 << n) - 1), np.arange(k)
    for i in reversed(range(n)):
        way[:, i] = last[taken, rows]
        taken ^= 1 << way[:, i]
    return way, least[-1]


def assignment_measures(points: Column, transposed: bool = False) -> Column:
    """label, value, cost of the points about their centroid against each reference polyhedron of their number.

    Points at a mean radius of 1 take the vertices with the least sum of distances (cost), and are
    then turned onto them; the value is 100 times the mean squared distance that is left. Values are
    infinite where all points coincide. Other numbers of points have no measure; null points give null.
    """
    kind = pa.list_(pa.struct([("label", pa.string()), ("value", pa.float64()), ("cost", pa.float64())]))

    @F.arrow_udf("array<struct<label:string,value:double,cost:double>>")
    def measures(points: pa.Array) -> pa.Array:
        flat, first, size = coordinates(points)
        labels = {n: list(templates(n)) for n in set(size.tolist())}
        ends = np.concatenate([[0], np.cumsum([len(labels[n]) for n in size.tolist()], dtype=np.int64)])
        label, value, cost = np.empty(ends[-1], object), np.empty(ends[-1]), np.empty(ends[-1])
        for n, names in labels.items():
            if not names:
                continue
            of = np.flatnonzero(size == n)
            p = flat[first[of][:, None] + np.arange(n)]
            p -= p.mean(1, keepdims=True)
            radius = np.sqrt((p**2).sum(2)).mean(1)
            none = radius < 1e-6
            p = p / np.where(none, 1, radius)[:, None, None]
            for k, (name, vertices) in enumerate(templates(n).items()):
                t, at = np.array(vertices), ends[of] + k
                way, least = assigned(p, t)
                rmsd, _ = superposed(p, t[way], transposed)
                label[at], value[at], cost[at] = name, np.where(none, inf, 100 * rmsd**2), np.where(none, np.nan, least)
        found = pa.StructArray.from_arrays([pa.array(label, pa.string()), pa.array(value), pa.array(cost, from_pandas=True)], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=pa.array(size < 0))

    return measures(points)
