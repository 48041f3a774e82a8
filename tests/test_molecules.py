"""Encoding on known arrangements, and its invariance."""

import pytest
from pyspark.sql import functions as F

from chelate import schema
from chelate.constants import POLYHEDRA, Config
from chelate.plans.encode import canonical_strings, canonicalize, encode
from chelate.plans.filters import passing, rule_funnel
from chelate.plans.features import check, check_summary, features, noisy, permuted, rotated
from chelate.sources.tables import read_bond_orders, read_cif, read_dense_bond_orders, read_molecules


def molecule(name, metal, donors, bonds=None):
    atoms = [(0, metal, 0.0, 0.0, 0.0)] + [(i, e, *map(float, xyz)) for i, (e, xyz) in enumerate(donors, 1)]
    return (name, 0, atoms, bonds, None)


def arranged(n, label, elements, radius=2.0):
    points = POLYHEDRA[n][label]
    size = sum(x * x for x in points[0]) ** 0.5
    return [(e, [radius * x / size for x in p]) for e, p in zip(elements, points, strict=True)]


@pytest.fixture(scope="module")
def molecules(spark):
    rows = [molecule(label, "Fe", arranged(n, label, ["N"] * 2 + ["Cl"] * (n - 2))) for n, shapes in POLYHEDRA.items() for label in shapes]
    rows += [molecule("none", "C", [("N", (0, 0, 2))]), molecule("bare", "Fe", [("H", (0, 0, 2))]), molecule("two", "Fe", [("N", (0, 0, 2)), ("Co", (0, 0, 5))])]
    rows.append(molecule("wrong bonds", "Fe", [("N", (0, 0, 2))], [(0, 9, 1.0)]))
    return spark.createDataFrame(rows, schema.MOLECULE)


#: Measures of ideal arrangements against both polyhedra of their number.
MEASURES = {"L": [0.0], "TP": [0.0], "Td": [0.0, 2.88], "SP": [2.88, 0.0], "TBP": [0.0, 1.08], "Oh": [0.0, 5.66]}


def test_measures_and_failures(molecules):
    rows = {r.mol_id: r for r in encode(molecules).select("mol_id", "cn", "shape.values_rounded", "failure", F.col("issues.code").alias("codes")).collect()}
    for name, want in MEASURES.items():
        assert rows[name].values_rounded == want
    assert rows["none"].failure == "No transition metal found" and rows["bare"].failure.startswith("No donors")
    assert rows["wrong bonds"].codes == ["ENCODING_FAILED"] and rows["two"].codes == ["MULTI_METAL"]


def test_coincident_donors(spark):
    """Donors at one point have no measure: it is infinite, and the string says so."""
    df = spark.createDataFrame([molecule("one", "Zn", [("N", (0, 0, 0))] * 2), molecule("four", "Fe", [("N", (0, 0, 2))] * 4)], schema.MOLECULE)
    blocks = {r.source_id: r.canonical for r in canonical_strings(df).collect()}
    assert "<ShapeBest:L|Class:irreg|Delta:0|V:inf>" in blocks["one"] and "<ShapeBest:Td|Class:irreg|Delta:3|V:inf,inf>" in blocks["four"]
    assert {r.mol_id: r.codes for r in check(encode(df)).select("mol_id", F.col("checks.code").alias("codes")).collect()} == {"one": ["UNUSUAL_GEOMETRY"], "four": ["UNUSUAL_GEOMETRY"]}


def test_strings(molecules):
    s = {r.source_id: r.canonical for r in canonical_strings(molecules).collect()}
    assert s["SP"] == "[Metal:Fe|ox:+2|d:d6|CN:4]<ShapeBest:SP|Class:ideal|Delta:2|V:2.88,0.00>{trans:L1:N:1--L2:N:1}{trans:L3:Cl:1--L4:Cl:1}|L1=N|L2=N|L3=Cl|L4=Cl|"
    assert s["none"] == "[Metal:?|CN:0]||"


def test_invariance(spark, tmp_path):
    """Rotations, permutations and small noise keep the string of an uneven complex."""
    donors = [("N", (0, 0.1, 2.0)), ("O", (2.1, 0, 0.2)), ("Cl", (0.1, -2.3, 0)), ("Cl", (-2.2, 0.3, 0.1)), ("C", (0.9, 0.8, 2.4))]
    base = spark.createDataFrame([molecule(f"m{i}", m, donors) for i, m in enumerate(("Fe", "Pt", "Rh"))], schema.MOLECULE)
    exact = Config(assignment="exact")
    want = {r.source_id: r.canonical for r in canonical_strings(base, exact).collect()}
    for k, moved in enumerate((rotated(base, 1), rotated(base, 2), permuted(base, 3), noisy(base, 1e-7, 4))):
        moved.write.parquet(str(tmp_path / str(k)))
        again = canonical_strings(spark.read.parquet(str(tmp_path / str(k))), exact)
        assert {r.source_id: r.canonical for r in again.collect()} == want


def test_features_and_checks(molecules):
    row = features(encode(molecules.where("mol_id = 'Oh'"))).first()
    assert row.geom[:9] == [0, 0, 0, 0, 0, 1, 0, 0, 0] and len(row.geom) == 17 and len(row.metal_vector) == 7 and "CN=6" in row.tokens
    total = check_summary(check(canonicalize(encode(molecules)))).first()
    failed = molecules.where("mol_id IN ('none', 'bare', 'wrong bonds')").count()
    assert failed == 3 and total.total == molecules.count() and total.with_errors == 0 and total.issues["SHAPE_COMPUTATION_FAILED"] == failed + 1  # and the one with a single donor


def test_every_check(spark):
    """Each check by itself: code, message, severity; one issue for each thing found."""
    base = encode(spark.createDataFrame([molecule("x", "Fe", arranged(6, "Oh", ["N"] * 6))], schema.MOLECULE))
    found = lambda **c: [tuple(i) for i in check(base.withColumns({k: F.expr(v) for k, v in c.items()})).first().checks]
    assert found() == []
    assert found(cn="0", shape="named_struct('cn', 0, 'values', shape.values)") == [("NO_DONORS", "No donor atoms found", "error")]
    assert found(cn="13") == [("UNUSUAL_GEOMETRY", "Unusually high coordination number: 13", "warning"), ("UNUSUAL_GEOMETRY", "CN mismatch: shape CN=6, actual CN=13", "warning")]
    assert found(failure="'no'", cn="0") == [("SHAPE_COMPUTATION_FAILED", "Shape vector is missing", "warning")]
    assert found(shape="named_struct('cn', 6, 'values', array(12.345D, 11D))") == [("UNUSUAL_GEOMETRY", "Very distorted geometry: min CShM = 11.00", "warning")]
    lig = "transform(slice(ligands, 1, 2), l -> named_struct('lig_id', l.lig_id, 'smiles', '', 'dent', 2, 'donor_elements', l.donor_elements))"
    assert found(ligands=lig) == [*[("LIGAND_INCONSISTENCY", f"L{i}: dent=2 but 1 donor elements", "warning") for i in (1, 2)], *[("RDKIT_SANITIZE_FAILED", f"L{i}: Empty SMILES", "warning") for i in (1, 2)]]
    pair = found(trans="concat(trans, array(trans[0], trans[0]))", cis="concat(array(trans[1]), cis)")
    assert [(c, s) for c, _, s in pair] == [("DUPLICATE_CONSTRAINT", "warning")] * 2 + [("CONSTRAINT_CONTRADICTION", "error")]
    assert pair[0][1].startswith("Duplicate trans pair: L") and pair[2][1].startswith("Pair is both trans and cis: L")


def test_haptic_and_formula(spark):
    ring = [("C", (1.0, 0.6, 1.5)), ("C", (1.0, -0.6, 1.5)), ("Cl", (-2.2, 0, 0)), ("C", (-5, 0, 0))]
    ligands = encode(spark.createDataFrame([molecule("eta", "Pt", ring)], schema.MOLECULE)).select("ligands").first().ligands
    assert [(x.smiles, x.dent, x.eta) for x in ligands] == [("C2", 2, 2), ("Cl", 1, None)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("3\nCSD_code = ABC | x\nFe 0 0 0\nN 0 0 2\nCl 0 0 -2\n\njunk\n3\nCSD-DEF\nCo 0 0 0\nO 2 0 0\nbad row\n2\nnoid\nNi 0 0 0\nN 0 1.9 0\n1\nCSD_code = DEF\nZn 1 1 1\n")
    (tmp_path / "a.BO").write_text("1 Fe 9 N 2 9\nCSD_code = ABC\n1 Fe 2.0 N 2 0.5 Cl 3 0.6\n2 N 1.0 Fe 1 0.55\nx y\n\nCSD_code\n1 Fe 1.0 N 2 0.9\n")
    (tmp_path / "p.csv").write_text("CSD_code,Electronic_E_gap_eV,Dipole_M_Debye,HOMO_eV,LUMO_eV\nABC,1.5,,2,3\n,1,1,1,1\n")
    rows = {r.mol_id: r for r in read_molecules(spark, str(tmp_path / "a.xyz"), str(tmp_path / "a.BO"), str(tmp_path / "p.csv")).collect()}
    assert set(rows) == {"ABC", "DEF", "MOL_12"} and [a.element for a in rows["DEF"].atoms] == ["Zn"]
    assert [(b.i, b.j, round(b.bo, 2)) for b in rows["ABC"].bonds] == [(0, 1, 0.55), (0, 2, 0.6)] and rows["DEF"].bonds is None
    assert rows["ABC"].properties == {"hl_gap": 1.5, "dipole": 0.0, "homo": 2.0, "lumo": 3.0} and rows["DEF"].properties == {}
    assert read_bond_orders(spark, str(tmp_path / "a.BO")).count() == 1
    assert read_dense_bond_orders(spark, str(tmp_path / "a.BO")).first().bonds is None


def test_cif(spark, tmp_path):
    cell = "\n".join(f"_cell_length_{k} 10.0(1)" for k in "abc") + "\n" + "\n".join(f"_cell_angle_{k} 90" for k in ("alpha", "beta", "gamma"))
    loop = "loop_\n_symmetry_equiv\nx,y,z\nloop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nFe1 0.1 0.1 0.1\nC1A 0.25(3) 0.1 0.1\nbad\n\nloop_\n"
    (tmp_path / "x.cif").write_text(f"data_x\n_chemical_formula_sum 'C2 H6 Fe'\n{cell}\n_symmetry_space_group_name_H-M 'P 1'\n{loop}")
    (tmp_path / "y.cif").write_text(f"_chemical_formula_sum 'C2 H6'\n{cell}\n{loop}")
    row = read_cif(spark, str(tmp_path)).collect()
    assert [(r.cod_id, r.formula, r.space_group, r.r_factor, r.disorder) for r in row] == [("x", "C2 H6 Fe", "P 1", None, False)]
    assert [(a.element, round(a.x, 6)) for a in row[0].atoms] == [("Fe", 1.0), ("Ca", 2.5)]


def test_cif_disorder(spark, tmp_path):
    """Occupancies below 1 and disorder groups, as far as the loop has them; the R factor."""
    cell = "\n".join(f"_cell_length_{k} 10.0" for k in "abc") + "\n" + "\n".join(f"_cell_angle_{k} 90" for k in ("alpha", "beta", "gamma")) + "\n_refine_ls_R_factor_gt 0.0423\n"
    head = "loop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n_atom_site_occupancy\n_atom_site_disorder_group\n"
    for name, rows in (("whole", "Fe1 0 0 0 1 .\nN1 0 0 0.2 1.0 ?\n"), ("half", "Fe1 0 0 0 1 .\nN1 0 0 0.2 0.5(1) .\n"), ("group", "Fe1 0 0 0 1 .\nN1 0 0 0.2 1 2\n"), ("short", "Fe1 0 0 0\n")):
        (tmp_path / f"{name}.cif").write_text(f"_chemical_formula_sum 'Fe N'\n{cell}{head}{rows}")
    assert {r.cod_id: (r.disorder, r.r_factor) for r in read_cif(spark, str(tmp_path)).collect()} == {"whole": (False, 0.0423), "half": (True, 0.0423), "group": (True, 0.0423), "short": (False, 0.0423)}


def test_rules(spark):
    """Each rule rejects its own structure, and the funnel counts them in turn."""
    ok = [("N", (0, 0, 2)), ("N", (0, 0, -2))]
    ring = [("C", (1.0, 0.6, 1.5)), ("C", (1.0, -0.6, 1.5)), ("N", (-2, 0, 0))]
    rows = [molecule("ok", "Fe", ok), molecule("none", "C", ok), molecule("two", "Fe", [*ok, ("Co", (0, 2, 0))]), molecule("eta", "Pt", ring), molecule("cn", "Fe", ok[:1]), molecule("far", "Fe", [*ok, ("N", (9, 9, 9))]), molecule("dis", "Fe", ok), molecule("r", "Fe", ok)]
    df = encode(spark.createDataFrame(rows, schema.MOLECULE)).withColumns({"disorder": F.col("mol_id") == "dis", "r_factor": F.when(F.col("mol_id") == "r", 0.11).otherwise(F.when(F.col("mol_id") == "ok", 0.1))})
    assert [r.remaining for r in rule_funnel(df).orderBy("step").collect()] == [8, 7, 6, 5, 4, 3, 2, 1, 1, 1]
    kept = passing(df)
    assert [r.mol_id for r in kept.collect()] == ["ok"] and kept.columns == df.columns
    assert {r.mol_id for r in passing(df.drop("disorder", "r_factor")).collect()} == {"ok", "dis", "r"}


def test_several_metals(spark):
    df = spark.createDataFrame([molecule("two", "Fe", [("N", (0, 0, 2)), ("Co", (0, 0, 5))])], schema.MOLECULE)
    assert [i.message for i in encode(df).first().issues] == ["Multiple metals found: [0, 2]. Using first."]
    assert encode(df, Config(allow_multimetal=True)).first().issues == []
