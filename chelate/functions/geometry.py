"""SQL expressions on points, each a struct with x, y, z. Higher-order functions only: no Python runs on the rows."""

from __future__ import annotations

from chelate.constants import POLYHEDRA, orders, polyhedron


def distance(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"


def angle(a: str, v: str, b: str) -> str:
    """Degrees at v; 0 where a leg is shorter than 1e-6."""
    dot = " + ".join(f"({a}.{k} - {v}.{k}) * ({b}.{k} - {v}.{k})" for k in "xyz")
    la, lb = distance(a, v), distance(b, v)
    return f"CASE WHEN {la} < 1e-6 OR {lb} < 1e-6 THEN 0D ELSE degrees(acos(greatest(-1D, least(1D, ({dot}) / ({la} * {lb}))))) END"


def leg_angle(a: str, b: str) -> str:
    """angle() of two legs, each its vector from the vertex and its length d: the same numbers, without working out the legs again."""
    dot = " + ".join(f"{a}.{k} * {b}.{k}" for k in "xyz")
    return f"CASE WHEN {a}.d < 1e-6 OR {b}.d < 1e-6 THEN 0D ELSE degrees(acos(greatest(-1D, least(1D, ({dot}) / ({a}.d * {b}.d))))) END"


def angle_class(degrees: str, trans: float = 165.0, cis: tuple[float, float] = (75.0, 105.0)) -> str:
    return f"CASE WHEN {degrees} >= {trans}D THEN 'trans' WHEN {degrees} BETWEEN {cis[0]}D AND {cis[1]}D THEN 'cis' ELSE 'other' END"


def distances(points: str) -> str:
    """The matrix of pairwise distances."""
    return f"transform({points}, p -> transform({points}, q -> {distance('p', 'q')}))"


def signature(features: str) -> str:
    """A hash of the first six numbers at four decimals, to base 100003, modulo 10^15; exact in decimals."""
    return f"aggregate(slice({features}, 1, 6), cast(0 AS decimal(38,0)), (s, d) -> cast((s * 100003 + cast(rint(d * 10000) AS decimal(20,0))) % 1000000000000000 AS decimal(38,0)))"


def rounded(x: str, digits: int) -> str:
    """Half to even at the given decimals."""
    return f"rint({x} * {10.0**digits}D) / {10.0**digits}D"


def literal(rows: list) -> str:
    return "array(" + ", ".join(literal(r) if isinstance(r, (list, tuple)) else f"{r!r}D" if isinstance(r, float) else str(r) for r in rows) + ")"


def shape_measure(points: list[tuple[float, float, float]], assignment: str) -> str:
    """100 * the squared differences of the distance matrix ``dp`` from the polyhedron's, over dp's squares.

    ``ds`` holds dp's rows, each sorted. Greedy: rows of dp in order each take the free vertex whose sorted distances differ least,
    the first one on a tie. Exact: the least over all assignments. Infinite where all points coincide.
    """
    n = len(points)
    dq = [[sum((a[k] - b[k]) ** 2 for k in range(3)) ** 0.5 for b in points] for a in points]
    q, sorted_q = literal(dq), literal([sorted(r) for r in dq])
    total = "aggregate(flatten(dp), 0D, (s, d) -> s + d * d)"
    off = f"100 * aggregate(sequence(0, {n * n - 1}), 0D, (s, k) -> s + power(dp[int(k / {n})][k % {n}] - {q}[way[int(k / {n})]][way[k % {n}]], 2)) / {total}"
    if assignment == "exact":
        ways = literal([list(o) for o in orders(n)])
        value = f"array_min(transform({ways}, way -> {off}))"
    else:
        cost = f"aggregate(sequence(0, {n - 1}), 1e-10D * j, (s, k) -> s + power(ds[i][k] - {sorted_q}[j][k], 2))"
        pick = f"array_min(transform(filter(sequence(0, {n - 1}), j -> NOT array_contains(taken, j)), j -> named_struct('cost', {cost}, 'j', j))).j"
        way = f"aggregate(sequence(0, {n - 1}), cast(array() AS array<int>), (taken, i) -> concat(taken, array({pick})))"
        value = f"transform(array({way}), way -> {off})[0]"
    return f"CASE WHEN {total} < 1e-10 THEN double('Infinity') ELSE {value} END"


def shape_values(cn: str, assignment: str) -> str:
    """Measures against each polyhedron of cn, in label order; empty for other numbers. Reads the matrix ``dp``."""
    each = " ".join(f"WHEN {n} THEN array({', '.join(shape_measure(polyhedron(p), assignment) for p in shapes.values())})" for n, shapes in POLYHEDRA.items())
    # the sorted rows are bound once, as the one element of an array
    return f"transform(array(transform(dp, r -> array_sort(r))), ds -> CASE {cn} {each} ELSE cast(array() AS array<double>) END)[0]"


def shape_labels(cn: str) -> str:
    each = " ".join(f"WHEN {n} THEN array({', '.join(repr(s) for s in shapes)})" for n, shapes in POLYHEDRA.items())
    return f"CASE {cn} {each} ELSE cast(array() AS array<string>) END"
