"""The rules F1 to F8 that encoded structures have to pass, in order, as columns and as a funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chelate.constants import METALS
from chelate.operators.reports import funnel

#: Coordination numbers, hapticity and R factor that pass.
LEAST_CN, MOST_CN, MOST_ETA, MOST_R = 2, 14, 1, 0.10
OPTIONAL = {"disorder": "boolean", "r_factor": "double"}


def rules() -> dict[str, Column]:
    """Name and condition of each rule over encode()'s columns, disorder and r_factor; an unknown R factor passes, so does unknown disorder."""
    names = ", ".join(f"'{m}'" for m in METALS)
    metals = f"size(filter(atoms, a -> a.element IN ({names})))"
    within = "flatten(transform(ligands, l -> l.atoms))"
    return {
        "Transition metals only": F.expr(f"{metals} > 0"),
        "Single metal center (F1)": F.expr(f"{metals} = 1"),
        "Hapticity (F2)": F.expr(f"NOT exists(ligands, l -> coalesce(l.eta, 0) > {MOST_ETA})"),
        "CN in range (F3)": F.expr(f"cn BETWEEN {LEAST_CN} AND {MOST_CN}"),
        "No fragmented structures (F4)": F.expr(f"size(array_except(transform(atoms, a -> a.idx), concat(array(metal.idx), {within}))) = 0"),
        "No positional disorder (F5)": F.expr("NOT coalesce(disorder, false)"),
        "R-factor (F6)": F.expr(f"coalesce(r_factor, 0) <= {MOST_R}D"),
        "No missing donor atoms (F7)": F.expr("failure IS NULL AND cn > 0 AND forall(neighbors, n -> exists(ligands, l -> array_contains(l.attach_atoms, n.idx)))"),
        "Valid ligand names (F8)": F.expr("size(ligands) > 0 AND forall(ligands, l -> coalesce(l.smiles, '') <> '')"),
    }


def prepared(encoded: DataFrame) -> DataFrame:
    """encoded with the optional columns, null where it has none."""
    return encoded.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in encoded.columns})


def passing(encoded: DataFrame) -> DataFrame:
    """The rows that every rule lets pass, with their columns."""
    df = prepared(encoded)
    for condition in rules().values():
        df = df.where(F.coalesce(condition, F.lit(False)))
    return df.select(*encoded.columns)


def rule_funnel(encoded: DataFrame) -> DataFrame:
    """step, name, remaining, pct after each rule in turn, from all rows on, in one pass."""
    return funnel(prepared(encoded), rules())
