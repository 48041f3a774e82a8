"""Operators that SQL does not say: repair by scores, masking by kind, files, the convert command."""

import json

import numpy as np
from pyspark.sql import functions as F

from chelate import convert, schema
from chelate.operators import datasets, scoring, tokens
from chelate.plans import donors, records
from chelate.plans.encode import canonicalize, encode
from chelate.sources import tables

XYZ = """3
CSD_code = AAA | q = 0
Fe 0.0 0.0 0.0
N 0.0 0.0 2.0
N 0.0 0.0 -2.0
2
CSD_code = BBB | q = 0
C 0.0 0.0 0.0
N 0.0 0.0 1.2
"""


def balanced(text):
    stack, partner = [], {")": "(", "]": "[", "}": "{", ">": "<"}
    for c in text:
        if c in "([{<":
            stack.append(c)
        elif c in partner and (not stack or stack.pop() != partner[c]):
            return False
    return not stack and len(text) >= 10 and ("[Metal:" in text or "|L" in text)


def brute_repair(tokens, topk):
    if balanced("".join(tokens)):
        return tokens
    out = list(tokens)
    for i in [i for i, t in enumerate(tokens) if t in scoring.STRUCTURE or t.startswith("[UNK")]:
        for c in topk:
            if c != out[i] and balanced("".join([*out[:i], c, *out[i + 1 :]])):
                out[i] = c
                break
    return out


def test_repair_by_scores(spark):
    good = ["[Metal:Fe|CN:2]", "<", "Shape:L", ">", "|", "L1=N", "|"]
    rows = [good, [*good[:3], "]", *good[4:]], [*good[:1], "(", *good[2:]], [*good[:3], "[UNK]", *good[4:]], ["x", "y"], [*good[:1], "(", "a", "]", *good[4:]]]
    df = spark.createDataFrame([(i, r, [">", "<", "|"]) for i, r in enumerate(rows)], "id int, tokens array<string>, best array<string>")
    got = {r.id: r.repaired for r in scoring.repair_by_scores(df, "tokens", "best").collect()}
    assert got == {i: brute_repair(r, [">", "<", "|"]) for i, r in enumerate(rows)}
    assert got[1] == good and got[4] == ["x", "y"]


def test_masks_by_kind(spark):
    df = spark.range(400).select("id", F.expr("transform(sequence(0, 20), i -> concat('t', i))").alias("tokens"), F.expr("transform(sequence(0, 20), i -> int(i + 200))").alias("ids"))
    rows = datasets.mask_inputs(df, "id", 1).collect()
    assert len(rows) == 400 and 80 < sum(r.kind == "block" for r in rows) < 160 and 30 < sum(r.kind == "span" for r in rows) < 90
    for r in rows:
        assert len(r.masked) == len(r.labels) == 21
        assert all(m == x for m, x, y in zip(r.masked, r.ids, r.labels, strict=True) if y == -100)
        assert (sum(y != -100 for y in r.labels) == 3) if r.kind == "span" else True


def test_digest_rank_is_the_rank(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string").cast("binary")).alias("d"))
    got = datasets.digest_rank(df, ["k"], F.col("d"), F.col("id")).collect()
    for k in range(3):
        some = sorted((r.d, r._rank) for r in got if r.k == k)
        assert [x for _, x in some] == list(range(len(some))) and {r._n for r in got if r.k == k} == {len(some)}


def test_threshold_equals_percentile(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [round(float(x), 3) for x in rng.random(n) * 0.8]) for i, n in enumerate((0, 1, 2, 5, 9))]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, bo array<double>").select("id", F.expr(donors.adaptive_threshold("bo")).alias("t")).collect()}
    for i, bo in rows:
        kept = [x for x in bo if x > 0.01]
        assert abs(got[i] - (min(0.5, max(0.1, float(np.percentile(kept, 25)))) if kept else 0.3)) < 1e-12


def test_property_files_of_either_spelling(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CSD_code,Electronic_E_gap_eV,Dipole_M_Debye,HOMO_eV,LUMO_eV\nAAA,1,2,3,4\nAAA,5,,7,8\n,1,1,1,1\n")
    (tmp_path / "b.csv").write_text("id,hl_gap,dipole_moment,homo_energy,lumo_energy\nBBB,1.5,2.5,3.5,4.5\n")
    one = {r.mol_id: r.properties for r in tables.read_properties(spark, str(tmp_path / "a.csv")).collect()}
    assert one == {"AAA": {"hl_gap": 5.0, "dipole": 0.0, "homo": 7.0, "lumo": 8.0}}
    two = {r.mol_id: r.properties for r in tables.read_properties(spark, str(tmp_path / "b.csv")).collect()}
    assert two == {"BBB": {"hl_gap": 1.5, "dipole": 2.5, "homo": 3.5, "lumo": 4.5}}


def test_vocabulary_files(spark, tmp_path):
    v = spark.createDataFrame([("a", 3), ("b", 7)], "token string, id int")
    tables.save_vocabulary(v, str(tmp_path / "v"))
    back, following = tables.load_vocabulary(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, back.collect())) == [("a", 3), ("b", 7)] and following == 8


def test_convert_command(spark, tmp_path):
    (tmp_path / "m.xyz").write_text(XYZ)
    a = convert.arguments(["--xyz", str(tmp_path / "m.xyz"), "--batch", "--output", str(tmp_path / "out")])
    assert tuple(convert.convert(spark, a).first()) == (2, 1, 0.5)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out/strings")).collect()]
    assert len(lines) == 1 and lines[0].startswith("[Metal:Fe|")
    one = convert.arguments(["--xyz", str(tmp_path / "m.xyz"), "--batch", "--limit", "1", "--output", str(tmp_path / "one")])
    assert convert.convert(spark, one).first().total == 1


def numbered(names):
    return "".join(f"2\nCSD_code = {n}\nFe 0 0 0\nN 0 0 {2 + i / 10}\n" for i, n in enumerate(names))


def test_convert_limit_over_files(spark, tmp_path):
    """The first molecules by file, then by place; files of the set's own name first; an id's first place and last atoms."""
    (tmp_path / "b.xyz").write_text(numbered([f"B{i}" for i in range(5)]))
    (tmp_path / "a.xyz").write_text(numbered([f"A{i}" for i in range(5)] + ["B3"]))
    (tmp_path / "tmQM_X1.xyz").write_text(numbered(["T0", "A2"]))
    (tmp_path / "x.BO").write_text("CSD_code = A0\n1 Fe 1.0 N 2 0.9\n")
    (tmp_path / "y.csv").write_text("CSD_code,HOMO_eV\nA0,1\n")
    ids = lambda n: [r.mol_id for r in convert.molecules(spark, convert.arguments(["--tmqm-dir", str(tmp_path), "--limit", str(n)])).collect()]
    assert ids(4) == ["T0", "A0", "A1", "A2"] and ids(0) == ["T0", "A0", "A1", "A2", "A3", "A4", "B3", "B0", "B1", "B2", "B4"]
    rows = {r.mol_id: r for r in convert.molecules(spark, convert.arguments(["--tmqm-dir", str(tmp_path)])).collect()}
    assert rows["B3"].atoms[1].z == 2.3 and rows["A0"].bonds and rows["A0"].properties["homo"] == 1.0


def test_convert_without_molecules(spark, tmp_path, capsys):
    (tmp_path / "m.xyz").write_text("nothing\n")
    a = convert.arguments(["--xyz", str(tmp_path / "m.xyz"), "--batch", "-o", str(tmp_path / "out")])
    assert tuple(convert.convert(spark, a).first()) == (0, 0, None)
    assert convert.convert_one(spark, convert.arguments(["--xyz", str(tmp_path / "m.xyz")])) is None
    assert capsys.readouterr().out == ""


def test_convert_prints(spark, tmp_path, capsys):
    """One molecule with bond orders: its string alone, or its details and a document; a batch without a folder prints strings."""
    (tmp_path / "my.mol.xyz").write_text("3\nany\nFe 0 0 0\nN 0 0 9\nCl 0 9 0\n" + XYZ)
    (tmp_path / "m.BO").write_text("# orders\n0 0.8 0.2\n0.8 0 0\n0.2 0 0\nbad\n")
    base = ["--xyz", str(tmp_path / "my.mol.xyz"), "--bo", str(tmp_path / "m.BO")]
    text = convert.convert_one(spark, convert.arguments([*base, "--quiet"]))
    assert capsys.readouterr().out == text + "\n" and text.startswith("[Metal:Fe|ox:+2|d:d6|CN:1]") and "L1=N|" in text
    assert "CN:2]" in convert.convert_one(spark, convert.arguments([*base, "-q", "--bo-threshold", "0.1"]))
    capsys.readouterr()
    convert.convert_one(spark, convert.arguments([*base, "-o", str(tmp_path / "out")]))
    out = capsys.readouterr().out
    assert "Source:    my.mol\n" in out and "Metal:    Fe (ox=2, d=6)" in out and "Ligands:  1\n  L1: N (dent=1, donors=['N'])" in out and text in out
    document = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "out/document")).collect()))
    assert list(document) == ["source_id", "metal", "ligands", "shape", "constraints", "is_canonical", "issues", "string"]
    assert document["metal"] == {"element": "Fe", "oxidation": 2, "spin": None, "dcount": 6} and document["ligands"][0] == {"lig_id": "L1", "smiles": "N", "dent": 1, "eta": None, "charge": None, "donor_elements": ["N"]}
    convert.convert(spark, convert.arguments(["--xyz", str(tmp_path / "my.mol.xyz"), "--batch"]))
    assert [x[:10] for x in capsys.readouterr().out.splitlines()] == ["[Metal:Fe|"]
    convert.convert(spark, convert.arguments(["--xyz", str(tmp_path / "my.mol.xyz"), "--batch", "-v", "-o", str(tmp_path / "v")]))
    assert capsys.readouterr().out.startswith("  AAA: [Metal:Fe|")


def test_documents(spark):
    """Records of a whole complex and of a failed one."""
    points = [("N", (0, 0, 2)), ("N", (0, 0, -2)), ("Cl", (2, 0, 0)), ("Cl", (-2, 0, 0))]
    atoms = lambda metal: [(0, metal, 0.0, 0.0, 0.0), *[(i, e, *map(float, p)) for i, (e, p) in enumerate(points, 1)]]
    df = spark.createDataFrame([("ok", 0, atoms("Fe"), None, None), ("no", 0, atoms("C"), None, None)], schema.MOLECULE)
    found = {r.source_id: json.loads(r.json) for r in records.documents(canonicalize(encode(df))).collect()}
    assert found["ok"]["constraints"] == {"trans_pairs": [["L1:N:1", "L2:N:1"], ["L3:Cl:1", "L4:Cl:1"]], "cis_pairs": [["L1:N:1", "L3:Cl:1"], ["L1:N:1", "L4:Cl:1"], ["L2:N:1", "L3:Cl:1"], ["L2:N:1", "L4:Cl:1"]], "notes": {}}
    assert found["ok"]["shape"]["cn"] == 4 and found["ok"]["shape"]["values_rounded"] == [2.88, 0.0] and found["ok"]["is_canonical"] and found["ok"]["issues"] == []
    assert found["no"] == {"source_id": "no", "metal": {"element": "?", "oxidation": None, "spin": None, "dcount": None}, "ligands": [], "shape": None, "constraints": {"trans_pairs": [], "cis_pairs": [], "notes": {}}, "is_canonical": True, "issues": ["[ERROR] ENCODING_FAILED: No transition metal found"], "string": "[Metal:?|CN:0]||"}


def test_cif_profile(spark, tmp_path):
    cell = "\n".join(f"_cell_length_{k} 10.0" for k in "abc") + "\n" + "\n".join(f"_cell_angle_{k} 90" for k in ("alpha", "beta", "gamma"))
    loop = "loop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n"
    for name, formula, rows in (("a", "Fe2 N", "Fe1 0 0 0\nFe2 0 0 0.5\nN1 0 0 0.2\n"), ("b", "C N", "C1 0 0 0\n"), ("c", "Co Fe", "Co1 0 0 0\nFe1 0 0.5 0\n")):
        (tmp_path / f"{name}.cif").write_text(f"_chemical_formula_sum '{formula}'\n{cell}\n{loop}{rows}")
    row = tables.cif_profile(spark, str(tmp_path)).first().asDict()
    assert row == {"total_files": 3, "with_metals": 2, "parsed_ok": 2, "atom_counts": [3, 2], "formulas": ["Fe2 N", "Co Fe"], "metal_counts": {"Co": 1, "Fe": 3}}
    assert tables.cif_profile(spark, str(tmp_path), 2).first().formulas == ["Fe2 N"]
    molecule = tables.cif_molecules(tables.read_cif(spark, str(tmp_path))).orderBy("mol_id").first()
    assert molecule.formula == "Fe2 N" and molecule.space_group == ""


def test_virtual_items(spark):
    """Item i is row i modulo N; below N as it is."""
    texts = [f"{{trans:L1:N:1--L2:O:1}}|L1=N{i}|L2=O{i}|" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(7)
    rows = tokens.virtual_items(df, "id", "text", [F.desc("id")], copies=3).collect()
    assert sorted(r["index"] for r in rows) == list(range(200))
    assert all(r.id == 49 - r["index"] % 50 for r in rows) and all(r.text == texts[r.id] for r in rows if r["index"] < 50)
    assert any(r.text != texts[r.id] for r in rows)


def test_donor_facade(spark):
    """The best tokens at a mask, of allowed elements alone."""
    scorer = spark.createDataFrame([("Fe", [("[UNK]", 0.5), ("N", 0.3), ("O", 0.1), ("C", 0.1)])], "metal string, topk array<struct<token:string,prob:double>>")
    df = spark.createDataFrame([("Fe", [1, 9], 5), ("Xx", [0], 5)], "metal string, mask_positions array<int>, n_tokens int")
    rows = {r.metal: r.topk for r in scoring.predict_donors(df, scorer, ["metal"], ["N", "O"], 5).collect()}
    assert [(e.token, round(e.prob, 6)) for e in rows["Fe"][0]] == [("N", 0.75), ("O", 0.25)] and rows["Fe"][1] == [] and rows["Xx"] == [[]]
    plain = {r.metal: r.topk for r in scoring.predict_donors(df, scorer, ["metal"], k=2).collect()}
    assert [e.token for e in plain["Fe"][0]] == ["[UNK]", "N"]
