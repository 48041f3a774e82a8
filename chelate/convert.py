"""Conversion to canonical strings: ``python -m chelate.convert (--xyz FILE [--bo FILE] | --tmqm-dir DIR | --cif-dir DIR) [--output DIR]``."""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate import schema
from chelate.checkpoints import written
from chelate.constants import Config
from chelate.operators.datasets import first_rows
from chelate.operators.reports import success_summary
from chelate.plans.encode import canonical_strings, canonicalize, encode
from chelate.plans.records import documents, record
from chelate.sources.tables import cif_molecules, read_cif, read_dense_bond_orders, read_molecules, write_json, write_strings
from chelate.sources.xyz import read_xyz


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Molecules or crystal files to canonical strings")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--xyz", help="a file in XYZ form; its first molecule, named by the file, unless --batch is given")
    source.add_argument("--tmqm-dir", help="a folder of .xyz, .BO and .csv files")
    source.add_argument("--cif-dir", help="a folder of .cif files")
    parser.add_argument("--bo", help="with one molecule: its matrix of bond orders")
    parser.add_argument("--batch", action="store_true", help="every molecule of the XYZ file")
    parser.add_argument("-o", "--output", help="folder for records (JSON lines) and strings, or for one molecule's document; without it strings are printed")
    parser.add_argument("--limit", type=int, default=0, help="molecules that are read, 0 for all")
    parser.add_argument("--bo-threshold", type=float, default=Config().bond_order)
    parser.add_argument("-q", "--quiet", action="store_true", help="one molecule: print its string alone")
    parser.add_argument("-v", "--verbose", action="store_true", help="print the beginning of every valid string")
    return parser.parse_args(argv)


def molecules(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The molecules asked for; a limit counts what could be read, in the order of files and of places in them."""
    if a.cif_dir:
        return first_rows(cif_molecules(read_cif(spark, f"{a.cif_dir}/*.cif")), "mol_id", a.limit)
    if a.tmqm_dir:
        rows = read_molecules(spark, f"{a.tmqm_dir}/*.xyz", f"{a.tmqm_dir}/*.BO", f"{a.tmqm_dir}/*.csv")
        # files of the data set's own name come before others
        other = (~F.regexp_extract("path", r"([^/]*)$", 1).startswith("tmQM_X")).alias("other")
        return first_rows(rows, [other, "path", "seq"], a.limit)
    return first_rows(read_molecules(spark, a.xyz), ["path", "seq"], a.limit)


def one_molecule(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The file's first molecule, named by the file, with the bond orders given."""
    name = re.sub(r"\.[^.]*$", "", a.xyz.rstrip("/").rsplit("/", 1)[-1])
    first = read_xyz(spark, a.xyz).orderBy("seq").limit(1).select(F.lit(name).alias("mol_id"), "seq", "atoms")
    bonds = F.lit(None).cast(f"array<{schema.BOND}>").alias("bonds")
    first = first.join(read_dense_bond_orders(spark, a.bo).select("bonds")) if a.bo else first.select("*", bonds)
    return first.withColumn("properties", F.create_map().cast("map<string,double>"))


def convert(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Write records and valid strings, or print the strings; return total, n_valid and their ratio."""
    strings = canonical_strings(molecules(spark, a), Config(bond_order=a.bo_threshold))
    if a.output:
        write_json(strings, f"{a.output}/records")
        records = spark.read.schema(schema.CONVERTED).json(f"{a.output}/records")
        write_strings(records, f"{a.output}/strings")
    else:
        records = written(strings)
    if a.verbose or not a.output:  # a partition at a time comes to the driver
        for r in records.where("valid").toLocalIterator():
            print(f"  {r.source_id}: {r.canonical[:80]}..." if a.verbose else r.canonical)
    return success_summary(records, F.col("valid"))


def details(r: dict) -> list[str]:
    """What is printed of one molecule's record."""
    shape, ligands, constraints = r["shape"], r["ligands"], r["constraints"]
    out = [f"Source:    {r['source_id']}", f"Metal:    {r['metal']['element']} (ox={r['metal']['oxidation']}, d={r['metal']['dcount']})"]
    if shape:
        out += [f"CN:       {shape['cn']}", "Shape:    " + ", ".join(f"{s}={v:.2f}" for s, v in zip(shape["ref_shapes"], shape["values_rounded"], strict=True))]
    out += [f"Ligands:  {len(ligands)}", *[f"  {x['lig_id']}: {x['smiles']} (dent={x['dent']}, donors={x['donor_elements']})" for x in ligands]]
    out += [f"{name}:    {len(constraints[key])} pairs" for name, key in (("Trans", "trans_pairs"), ("Cis", "cis_pairs")) if constraints[key]]
    return out + ([f"Issues ({len(r['issues'])}):", *[f"  {i}" for i in r["issues"]]] if r["issues"] else [])


def convert_one(spark: SparkSession, a: argparse.Namespace) -> str | None:
    """Print one molecule and write its document; returns the string, None of a file without a molecule."""
    rows = written(canonicalize(encode(one_molecule(spark, a), Config(bond_order=a.bo_threshold))))
    found = rows.select(record().alias("r"), "canonical").first()
    if found is None:
        return None
    if a.output and not a.quiet:
        documents(rows).select("json").coalesce(1).write.mode("overwrite").text(f"{a.output}/document")
    print(found.canonical if a.quiet else "\n".join([*details(found.r.asDict(recursive=True)), f"String:   {found.canonical}"]))
    return found.canonical


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("convert").getOrCreate()
    if not a.xyz or a.batch:
        total = convert(spark, a).first()
        print(f"Results: {total.n_valid}/{total.total} succeeded" + (f" ({100 * total.ratio:.1f}%)" if total.total else ""), file=sys.stdout if a.output else sys.stderr)
    elif convert_one(spark, a) is None:
        sys.exit(f"no molecule in {a.xyz}")


if __name__ == "__main__":
    main()
