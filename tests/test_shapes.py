"""Shapes by batches against the same steps in SQL, least strings against all permutations."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chelate import schema
from chelate.functions import geometry, shapes
from chelate.plans.encode import canonicalize, encode

POINTS = "array<struct<x:double,y:double,z:double>>"


def spheres(seed=3):
    rng, out = np.random.default_rng(seed), []
    lattice = np.array([(x, y, z) for x in (-2, 0, 2) for y in (-2, 0, 2) for z in (-2, 0, 2) if (x, y, z) != (0, 0, 0)], float)
    for n in range(9):
        for k in range(40):
            p = rng.normal(size=(n, 3)) * 2 if k % 2 else lattice[rng.permutation(len(lattice))[:n]]
            out.append((p, np.zeros(3) if k % 3 else rng.normal(size=3)))
    return [*out, (np.ones((4, 3)), np.zeros(3)), (np.zeros((3, 3)), np.zeros(3))]


@pytest.mark.parametrize("assignment", ["greedy", "exact"])
def test_batches_equal_sql(spark, assignment):
    sets = spheres()
    xyz = lambda v: dict(zip("xyz", map(float, v), strict=True))
    df = spark.createDataFrame([(i, [xyz(p) for p in points], xyz(m)) for i, (points, m) in enumerate(sets)], f"i int, points {POINTS}, metal struct<x:double,y:double,z:double>")
    df = df.withColumn("cn", F.size("points")).repartition(3)
    feature = f"concat(array({geometry.distance('p', 'metal')}), array_sort(transform(points, q -> {geometry.distance('p', 'q')})))"
    sql = df.withColumn("sorted", F.expr(f"transform(array_sort(transform(points, (p, k) -> named_struct('sig', {geometry.signature(feature)}, 'k', k))), s -> points[s.k])"))
    mean = f"aggregate(sorted, 0D, (s, p) -> s + {geometry.distance('p', 'metal')}) / nullif(size(sorted), 0)"
    sql = sql.withColumn("scale", F.expr(f"CASE WHEN {mean} > 1e-6 THEN {mean} ELSE 1D END"))
    scaled = "transform(sorted, p -> named_struct('x', (p.x - metal.x) / scale, 'y', (p.y - metal.y) / scale, 'z', (p.z - metal.z) / scale))"
    sql = sql.withColumn("scaled", F.expr(scaled)).withColumn("dp", F.expr(geometry.distances("scaled"))).select("i", F.expr(geometry.shape_values("cn", assignment)).alias("v"))
    want = {r.i: r.v for r in sql.collect()}
    got = {r.i: r.v for r in df.select("i", shapes.shape_values(F.col("points"), F.col("metal"), assignment).alias("v")).collect()}
    assert set(got) == set(want)
    for i, v in want.items():
        assert got[i] == pytest.approx(v, rel=1e-12) and len(v) == {2: 1, 3: 1, 4: 2, 5: 2, 6: 2}.get(len(sets[i][0]), 0)


def test_null_rows(spark):
    df = spark.createDataFrame([(None, (0.0, 0.0, 0.0)), ([(0.0, 0.0, 1.0)] * 2, None), ([], (0.0, 0.0, 0.0)), ([(0.0, 0.0, 1.0), (0.0, 0.0, -1.0)], (0.0, 0.0, 0.0))], f"p {POINTS}, m struct<x:double,y:double,z:double>")
    assert [r[0] for r in df.select(shapes.shape_values(df.p, df.m, "greedy")).collect()] == [None, None, [], [0.0]]


def plain_least(head, fm, trans, ligands):
    """The least string over all permutations of one group's first six ids."""
    def text(name):
        site = lambda s: f"{name(s.lig)}:{s.element}:{s['rank']}"
        pairs = sorted(tuple(sorted((site(p.a), site(p.b)))) for p in trans)
        defs = sorted((name(x.lig_id), x.smiles) for x in ligands)
        return head + "".join(f"{{trans:{a}--{b}}}" for a, b in pairs) + fm + ("|" + "|".join(f"{i}={s}" for i, s in defs) + "|" if defs else "||")

    best = None
    for kind in dict.fromkeys(x.smiles for x in ligands):
        group = [x.lig_id for x in ligands if x.smiles == kind][:6]
        for way in permutations(group):
            to = dict(zip(group, way, strict=True))
            s = text(lambda i: to.get(i, i))  # noqa: B023
            best = s if best is None or s < best else best
    return best


def test_least_string_equals_all_permutations(spark):
    """Complexes of few kinds of donors, many of them across from each other; some with ten ligands and more."""
    rng, rows = random.Random(5), []
    for k in range(120):
        n = rng.randint(2, 7) if k % 10 else rng.randint(10, 12)
        atoms = [(0, "Fe", 0.0, 0.0, 0.0)]
        while len(atoms) <= n:
            v = np.array([rng.gauss(0, 1) for _ in range(3)])
            v = v / np.linalg.norm(v) * rng.choice([1.9, 2.0, 2.1, 2.4])
            if len(atoms) > 1 and rng.random() < 0.5:
                v = -np.array(rng.choice(atoms[1:])[2:])
            if all(np.linalg.norm(v - np.array(a[2:])) > (0.4 if n > 9 else 1.0) for a in atoms[1:]):
                atoms.append((len(atoms), rng.choice(["N", "Cl"]), *map(float, v)))
        # a bond order for each donor, none between them: every donor is a ligand of its own
        rows.append((f"m{k}", k, atoms, [(0, i, 1.0) for i in range(1, len(atoms))], None))
    df = canonicalize(encode(spark.createDataFrame(rows, schema.MOLECULE)))
    found = df.select("mol_id", "canonical", "trans", "ligands", "fac_mer").collect()
    moved = 0
    for r in found:
        head = r.canonical[: r.canonical.index(">") + 1] if "<" in r.canonical else r.canonical[: r.canonical.index("]") + 1]
        fm = f"{{fm:{r.fac_mer}}}" if r.fac_mer else ""
        assert r.canonical == plain_least(head, fm, r.trans, r.ligands)
        moved += "".join(f"{{trans:{p.a.text}--{p.b.text}}}" for p in r.trans) not in r.canonical
    assert moved > 10 and any(len(r.ligands) > 9 and r.trans for r in found)
