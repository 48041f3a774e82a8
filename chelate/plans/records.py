"""A complex as one nested record, and as the JSON document that it is exchanged as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(name: str) -> str:
    return f"coalesce(transform({name}, p -> array(p.a.text, p.b.text)), array())"


def record(canonical: bool = True) -> Column:
    """The record of an encoded row; one that failed has the placeholder metal, no ligands, shape or constraints."""
    known = "failure IS NULL"
    metal = f"named_struct('element', IF({known}, metal_state.element, '?'), 'oxidation', IF({known}, metal_state.oxidation, NULL), 'spin', IF({known}, metal_state.spin, NULL), 'dcount', IF({known}, metal_state.dcount, NULL))"
    ligand = "named_struct('lig_id', l.lig_id, 'smiles', l.smiles, 'dent', l.dent, 'eta', l.eta, 'charge', l.charge, 'donor_elements', l.donor_elements)"
    ligands = f"IF({known}, coalesce(transform(ligands, l -> {ligand}), array()), cast(array() AS array<struct<lig_id:string,smiles:string,dent:int,eta:int,charge:int,donor_elements:array<string>>>))"
    shape = f"CASE WHEN {known} THEN named_struct('cn', shape.cn, 'ref_shapes', shape.ref_shapes, 'values', shape.values, 'values_rounded', shape.values_rounded) END"
    none = "cast(array() AS array<array<string>>)"
    notes = f"IF({known} AND fac_mer IS NOT NULL, map('fac_mer', fac_mer), cast(map() AS map<string,string>))"
    constraints = f"named_struct('trans_pairs', IF({known}, {pairs('trans')}, {none}), 'cis_pairs', IF({known}, {pairs('cis')}, {none}), 'notes', {notes})"
    issues = "transform(issues, i -> concat('[', upper(i.severity), '] ', i.code, ': ', i.message))"
    return F.expr(f"named_struct('source_id', mol_id, 'metal', {metal}, 'ligands', {ligands}, 'shape', {shape}, 'constraints', {constraints}, 'is_canonical', {str(canonical).lower()}, 'issues', {issues})")


def documents(canonicalized: DataFrame) -> DataFrame:
    """source_id, canonical, json: each complex as a JSON document with its string; nulls are written."""
    rows = canonicalized.select(F.col("mol_id").alias("source_id"), "canonical", record().alias("r"))
    # an infinite measure has no number in JSON: Spark writes it as text
    return rows.select("source_id", "canonical", F.to_json(F.struct("r.*", F.col("canonical").alias("string")), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))
