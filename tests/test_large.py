"""Bonds by a grid against all pairs, parts against a walk."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chelate.plans import large
from chelate.plans.large import connected, grid_edges, parts
from chelate.sources.tables import read_cif

SCHEMA = "mol string, idx int, element string, x double, y double, z double"


def structure(rng, name, n, size):
    return [(name, i, rng.choice(["C", "N", "Fe", "H"]), *(rng.uniform(-size, size) for _ in range(3))) for i in range(n)]


def all_pairs(rows, cutoff):
    out = set()
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            if a[0] == b[0] and math.dist(a[3:], b[3:]) < cutoff:
                out.add((a[0], *sorted((a[1], b[1]))))
    return out


def walk(rows, edges):
    """Formula and size of each part by (mol, least atom)."""
    near = {}
    for m, i, j in edges:
        near.setdefault((m, i), []).append((m, j))
        near.setdefault((m, j), []).append((m, i))
    element, seen, out = {(r[0], r[1]): r[2] for r in rows}, set(), {}
    for key in sorted(element):
        if key in seen:
            continue
        todo, group = [key], []
        seen.add(key)
        while todo:
            x = todo.pop()
            group.append(element[x])
            todo += [y for y in near.get(x, ()) if y not in seen]
            seen.update(near.get(x, ()))
        out[key] = (len(group), "".join(e + (str(group.count(e)) if group.count(e) > 1 else "") for e in sorted(set(group))))
    return out


@pytest.mark.parametrize("cutoff", [0.7, 1.8, 5.0, 50.0])
def test_grid_equals_all_pairs(spark, cutoff):
    rng = random.Random(int(cutoff * 10))
    rows = structure(rng, "a", 150, 4) + structure(rng, "b", 60, 2) + [("edge", i, "C", 1.8 * i, -1.8 * (i % 2), 0.0) for i in range(12)] + [("same", i, "C", 1.0, 1.0, 1.0) for i in range(5)]
    found = grid_edges(spark.createDataFrame(rows, SCHEMA), cutoff).collect()
    assert len(found) == len({(r.mol, r.i, r.j) for r in found})
    assert {(r.mol, r.i, r.j) for r in found} == all_pairs(rows, cutoff)
    at = {(r[0], r[1]): r[3:] for r in rows}
    assert all(r.distance == pytest.approx(math.dist(at[r.mol, r.i], at[r.mol, r.j])) for r in found)


@pytest.mark.parametrize("hot", [1, 1_024])
def test_parts_equal_walk(spark, monkeypatch, hot):
    monkeypatch.setattr(large, "HOT", hot)
    rng = random.Random(5)
    rows = structure(rng, "a", 120, 5) + structure(rng, "b", 40, 4)
    light = [r for r in rows if r[2] != "Fe"]
    got = {(r.mol, r.part): (r.n_atoms, r.formula) for r in parts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == walk(light, all_pairs(light, 1.8)) and len(got) > 20


def test_odd_atoms(spark):
    inf = float("inf")
    rows = [("m", 0, "C", 0.0, 0.0, 0.0), ("m", 1, "C", None, 0.0, 0.0), ("m", 2, "C", inf, 0.0, 0.0), ("m", 3, "C", float("nan"), 0.0, 0.0), ("m", 4, "N", 0.0, 0.0, 1.0), ("far", 0, "C", 1e300, 0.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.mol, r.i, r.j) for r in grid_edges(df).collect()] == [("m", 0, 4)]
    assert grid_edges(df.where("false")).count() == 0 and connected(grid_edges(df.where("false"))).count() == 0 and parts(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        grid_edges(df, 0)


def test_crystal_of_20000_atoms(spark, tmp_path):
    """A lattice of chains read from a crystal file: every chain is one part."""
    n, side = 20_000, 200
    cell = "\n".join(f"_cell_length_{k} 400.0" for k in "abc") + "\n" + "\n".join(f"_cell_angle_{k} 90" for k in ("alpha", "beta", "gamma"))
    rows = "\n".join(f"C{i} C {(i % side) * 1.5 / 400:.6f} {i // side * 3.0 / 400:.6f} 0.5" for i in range(n))
    head = "loop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n"
    (tmp_path / "x.cif").write_text(f"_chemical_formula_sum 'C Fe'\n{cell}\n{head}{rows}\nFe1 Fe 0.9 0.9 0.9\n")
    cif = read_cif(spark, str(tmp_path)).select(F.col("cod_id").alias("mol"), F.explode("atoms").alias("a")).select("mol", "a.*")
    out = parts(cif).groupBy("n_atoms", "formula").count().collect()
    assert [(r.n_atoms, r.formula, r["count"]) for r in out] == [(side, f"C{side}", n // side)]
