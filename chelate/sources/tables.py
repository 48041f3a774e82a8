"""Bond orders, properties, crystal files, records: read with SQL expressions; and the sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate import schema
from chelate.constants import METALS
from chelate.sources.splits import lines, stretches
from chelate.sources.xyz import last_of_each, read_xyz


def whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def sections(text: DataFrame) -> DataFrame:
    """Lines with the section that they stand in: path, block, line, section (block and number of its header), mol_id.

    A section's header may stand in an earlier split: each split's last header, one row, is carried on.
    """
    name = F.when(F.ltrim("value").startswith("CSD_code"), F.regexp_extract("value", r"(?U)CSD_code\s*=\s*(\w+)", 1))
    rows = text.withColumn("name", name)
    header = F.when(F.col("name").isNotNull(), F.struct(F.monotonically_increasing_id().alias("id"), "name"))
    last = rows.select("path", "block", header.alias("h")).groupBy("path", "block").agg(F.max("h").alias("h"), F.count("h").alias("n"))
    carried, now = {}, None
    for r in sorted(last.collect(), key=lambda r: (r.path, r.block)):
        now = now if now and now[0] == r.path else (r.path, -1, -1, "")
        carried[r.path, r.block] = now[1:]
        now = (r.path, r.block, r.n - 1, r.h.name) if r.n else now
    known = text.sparkSession.sparkContext.broadcast(carried)  # a row of some 100 bytes for each split

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, line, number, open_ = None, 0, 0, None
        for key, part in stretches(batches):
            if key not in known.value:
                raise RuntimeError(f"{key[0]} changed, or its splits did, while it was read")
            if key != at:
                at, line, number, open_ = key, 0, 0, known.value[key]
            names = part.column("name").to_pylist()
            block, section, of = [], [], []
            for x in names:
                if x is not None:
                    open_, number = (key[1], number, x), number + 1
                for to, v in zip((block, section, of), open_, strict=True):
                    to.append(v)
            lines_ = pa.array(range(line, line + part.num_rows), pa.int64())
            line += part.num_rows
            out = pa.RecordBatch.from_arrays(
                [part.column("path"), part.column("block"), lines_, pa.array(block, pa.int64()), pa.array(section, pa.int64()), pa.array(of, pa.string()), part.column("value")],
                ["path", "block", "line", "section_block", "section", "mol_id", "value"],
            )
            yield out.filter(pa.array([x is None and o != "" for x, o in zip(names, of, strict=True)], pa.bool_()))

    out = rows.mapInArrow(work, "path string, block long, line long, section_block long, section long, mol_id string, value string")
    return out.select("path", "block", "line", F.struct("path", "section_block", "section").alias("section"), "mol_id", "value")


def read_bond_orders(spark: SparkSession, path: str) -> DataFrame:
    """mol_id, bonds, of the sparse form: under a line ``CSD_code = id``, rows of index, element, total, and (element, index, order) triples.

    A large file is read by its splits, wherever these cut a section. Indices start at 1 in the file
    and at 0 here. Rows and triples that can't be read are skipped, sections without an id or any row
    dropped; of sections repeated for an id the last holds, and of orders given twice for a pair.
    """
    split = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = sections(lines(spark, path)).withColumn("p", split).where("size(p) >= 3 AND try_cast(p[0] AS int) IS NOT NULL AND try_cast(p[2] AS double) IS NOT NULL")
    triples = "CASE WHEN size(p) >= 6 THEN filter(transform(sequence(3, size(p) - 3, 3), k -> named_struct('k', k, 'j', try_cast(p[k + 1] AS int) - 1, 'bo', try_cast(p[k + 2] AS float))), t -> t.j >= 0 AND t.bo IS NOT NULL) END"
    rows = rows.select("section", "mol_id", F.struct("block", "line").alias("at"), (F.col("p")[0].cast("int") - 1).alias("i"), F.explode_outer(F.expr(triples)).alias("t"))
    last = rows.groupBy("mol_id").agg(F.max("section").alias("last"))
    rows = rows.join(last, "mol_id").where("section = last")
    pair = [F.least("i", "t.j").alias("i"), F.greatest("i", "t.j").alias("j")]
    pairs = rows.select("mol_id", *[F.when(F.col("t").isNotNull() & (F.col("i") >= 0), c).alias(k) for c, k in zip(pair, "ij", strict=True)], F.col("t.bo").alias("bo"), F.struct("at", "t.k").alias("order"))
    pairs = pairs.groupBy("mol_id", "i", "j").agg(F.max_by("bo", "order").alias("bo"))
    return pairs.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "j", "bo")))).alias("bonds"))


def read_dense_bond_orders(spark: SparkSession, path: str) -> DataFrame:
    """path, bonds, of the dense form: rows of N numbers; lines that start with # or hold anything else are skipped. Null bonds where no row is left."""
    rows = "filter(transform(split(value, '\\n'), l -> transform(filter(split(trim(l), '\\\\s+'), x -> x <> ''), x -> try_cast(x AS float))), r -> size(r) > 0 AND NOT exists(r, x -> x IS NULL))"
    bonds = "filter(flatten(transform(rows, (r, i) -> transform(r, (x, j) -> named_struct('i', i, 'j', j, 'bo', x)))), b -> b.i < b.j AND b.bo <> 0)"
    return whole(spark, path).withColumn("rows", F.expr(rows)).select("path", F.expr(f"CASE WHEN size(rows) > 0 THEN {bonds} END").alias("bonds"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """mol_id, properties, from CSV with either spelling of the columns; missing values are 0, rows without an id are dropped.

    Of rows repeated for an id the last one holds, by file and place in it.
    """
    df = spark.read.csv(path, header=True)
    have = {c.lower(): c for c in df.columns}
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{have[n.lower()]}`")), F.lit("")) for n in names if n.lower() in have], F.lit(None).cast("string"))
    value = lambda *names: F.coalesce(pick(*names).try_cast("double"), F.lit(0.0))
    fields = {"hl_gap": ("Electronic_E_gap_eV", "hl_gap"), "dipole": ("Dipole_M_Debye", "dipole_moment"), "homo": ("HOMO_eV", "homo_energy"), "lumo": ("LUMO_eV", "lumo_energy")}
    values = {k: value(*names) for k, names in fields.items()}
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"))
    rows = df.select(pick("CSD_code", "csd_code", "id").alias("mol_id"), F.struct(*[v.alias(k) for k, v in values.items()]).alias("v"), place.alias("place")).where("mol_id IS NOT NULL")
    last = rows.groupBy("mol_id").agg(F.max_by("v", "place").alias("v"))
    return last.select("mol_id", F.create_map(*[x for k in fields for x in (F.lit(k), F.col(f"v.{k}"))]).alias("properties"))


def read_molecules(spark: SparkSession, xyz: str, bond_orders: str | None = None, properties: str | None = None) -> DataFrame:
    """Molecules assembled on their id: atoms with bonds and properties where given, by left joins; path and seq of the id's first place."""
    df = last_of_each(read_xyz(spark, xyz)).select("path", "mol_id", "seq", "atoms")
    if bond_orders:
        df = df.join(read_bond_orders(spark, bond_orders), "mol_id", "left")
    else:
        df = df.withColumn("bonds", F.lit(None).cast(f"array<{schema.BOND}>"))
    if properties:
        df = df.join(read_properties(spark, properties), "mol_id", "left")
    else:
        df = df.withColumn("properties", F.lit(None).cast("map<string,double>"))
    empty = F.create_map().cast("map<string,double>")
    return df.select("path", "mol_id", "seq", "atoms", "bonds", F.coalesce("properties", empty).alias("properties"))


def read_cif(spark: SparkSession, path: str) -> DataFrame:
    """cod_id, formula, space_group, cell, r_factor, disorder, atoms of crystal files with a transition metal in the formula, all cell parameters and atoms.

    disorder: whether an atom is not there at all times (occupancy below 1) or stands in a disorder group. Fractional coordinates become Cartesian; neither symmetry nor disorder is expanded. A label
    without a type symbol gives its first two letters as the element.
    """
    line = r"[ \t]*_atom_site_[^\n]*\n"
    loop = rf"loop_[ \t]*\r?\n((?:{line})*?[ \t]*_atom_site_fract_x[^\n]*\n(?:{line})*+)((?:[ \t]*(?![_#\s]|loop_)[^\n]*(?:\n|$))*+)"
    df = whole(spark, path).withColumn("cod_id", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    text = lambda key: F.trim(F.regexp_extract("value", key + r"\s+['\"]?([^'\"\n]+)['\"]?", 1))
    cell = {k: F.regexp_extract("value", rf"_cell_(?:length_{k}|angle_{k})\s+([0-9.]+)", 1).try_cast("double") for k in ("a", "b", "c", "alpha", "beta", "gamma")}
    df = df.withColumns({"formula": text("_chemical_formula_sum"), "space_group": text("_symmetry_space_group_name_H-M"), "cell": F.struct(*[v.alias(k) for k, v in cell.items()]), "r_factor": F.regexp_extract("value", r"_refine_ls_R_factor_(?:gt|obs|all)\s+([0-9.]+)", 1).try_cast("double")})
    df = df.where(F.exists(F.array(*map(F.lit, METALS)), lambda m: F.contains(F.col("formula"), m)) & F.expr(" AND ".join(f"cell.{k} IS NOT NULL" for k in cell)))
    df = df.withColumns({"head": F.filter(F.split(F.regexp_extract("value", loop, 1), "\n"), lambda h: F.trim(h) != ""), "body": F.split(F.regexp_extract("value", loop, 2), "\n")})
    kind = "CASE WHEN h LIKE '%label%' THEN 'label' WHEN h LIKE '%type_symbol%' THEN 'symbol' WHEN h LIKE '%fract_x%' THEN 'x' WHEN h LIKE '%fract_y%' THEN 'y' WHEN h LIKE '%fract_z%' THEN 'z' WHEN h LIKE '%occupancy%' THEN 'occupancy' WHEN h LIKE '%disorder_group%' THEN 'group' ELSE '' END"
    last = lambda k: f"size(head) - int(array_position(reverse(transform(head, h -> {kind})), '{k}'))"
    df = df.withColumns({f"at_{k}": F.expr(f"CASE WHEN exists(head, h -> {kind} = '{k}') THEN {last(k)} END") for k in ("label", "symbol", "x", "y", "z", "occupancy", "group")})
    # what is read from the text is bound once, as the one element of an array: a lambda would read it again for every atom
    df = df.where("at_x IS NOT NULL AND at_y IS NOT NULL AND at_z IS NOT NULL AND (at_symbol IS NOT NULL OR at_label IS NOT NULL)")
    value = lambda k: f"try_cast(regexp_replace(p[b.{k}], '\\\\([^)]*\\\\)', '') AS double)"
    symbol = "CASE WHEN b.symbol IS NOT NULL THEN p[b.symbol] ELSE left(regexp_replace(p[b.label], '[^A-Za-z]', ''), 2) END"
    bound = "named_struct('body', body, 'need', greatest(coalesce(at_label, 0), coalesce(at_symbol, 0), at_x, at_y, at_z), " + ", ".join(f"'{k}', at_{k}" for k in ("label", "symbol", "x", "y", "z", "occupancy", "group")) + ")"
    partly = f"coalesce({value('occupancy').replace('p[b.occupancy]', 'get(p, b.occupancy)')} < 1, false) OR coalesce(get(p, b.group) NOT IN ('.', '?', '0'), false)"
    rows = f"transform(filter(transform(b.body, l -> split(trim(l), '\\\\s+')), p -> size(p) > b.need AND p[0] <> ''), p -> named_struct('element', left(concat(upper(left({symbol}, 1)), lower(substr({symbol}, 2))), 2), 'u', {value('x')}, 'v', {value('y')}, 'w', {value('z')}, 'partly', {partly}))"
    df = df.withColumn("sites", F.expr(f"transform(array({bound}), b -> filter({rows}, s -> s.u IS NOT NULL AND s.v IS NOT NULL AND s.w IS NOT NULL))[0]"))
    cos, sin = (lambda k: f"cos(radians(c.{k}))"), (lambda k: f"sin(radians(c.{k}))")
    volume = f"sqrt(1 - power({cos('alpha')}, 2) - power({cos('beta')}, 2) - power({cos('gamma')}, 2) + 2 * {cos('alpha')} * {cos('beta')} * {cos('gamma')})"
    x = f"c.a * s.u + c.b * {cos('gamma')} * s.v + c.c * {cos('beta')} * s.w"
    y = f"c.b * {sin('gamma')} * s.v + c.c * ({cos('alpha')} - {cos('beta')} * {cos('gamma')}) / {sin('gamma')} * s.w"
    atoms = f"transform(array(cell), c -> transform(sites, (s, i) -> named_struct('idx', i, 'element', s.element, 'x', {x}, 'y', {y}, 'z', c.c * {volume} / {sin('gamma')} * s.w)))[0]"
    return df.where("size(sites) > 0").select("cod_id", "formula", "space_group", "cell", "r_factor", F.expr("exists(sites, s -> s.partly)").alias("disorder"), F.expr(atoms).alias("atoms"))


def cif_molecules(cif: DataFrame) -> DataFrame:
    """Crystal rows as molecules without bond orders; formula, space_group, r_factor and disorder stay beside them."""
    return cif.select(F.col("cod_id").alias("mol_id"), F.lit(0).cast("bigint").alias("seq"), "atoms", F.lit(None).cast(f"array<{schema.BOND}>").alias("bonds"), F.create_map().cast("map<string,double>").alias("properties"), "formula", "space_group", "r_factor", "disorder")


def cif_profile(spark: SparkSession, path: str, limit: int | None = 1000) -> DataFrame:
    """One row: total_files, with_metals, parsed_ok, atom_counts and formulas (by file name), metal_counts (atoms of each metal).

    All but total_files cover the first ``limit`` files by name, whether they could be read or not.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    wanted = files.orderBy("path").limit(limit) if limit else files
    cif = read_cif(spark, path).join(wanted.select(name.alias("cod_id")), "cod_id", "left_semi")
    rows = cif.select("cod_id", "formula", F.size("atoms").alias("n"))
    metals = cif.select(F.explode("atoms.element").alias("e")).where(F.col("e").isin(list(METALS))).groupBy("e").agg(F.count("*").alias("n"))
    counts = metals.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "n")))).alias("metal_counts"))  # thirty metals at most
    listed = F.array_sort(F.collect_list(F.struct("cod_id", "n", "formula")))  # of ``limit`` files
    whole = rows.agg(F.count("*").alias("with_metals"), listed.alias("l")).select("with_metals", F.col("with_metals").alias("parsed_ok"), F.col("l.n").alias("atom_counts"), F.col("l.formula").alias("formulas"))
    return files.agg(F.count("*").alias("total_files")).join(whole).join(counts)


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines by schema: prediction, donor_sample, structure_sample, corruption or converted."""
    df = spark.read.schema(getattr(schema, kind.upper())).json(path)
    if kind != "prediction":
        return df
    topk = "transform(pred.topk, t -> named_struct('token', t[0], 'prob', try_cast(t[1] AS double)))"
    return df.withColumn("pred", F.expr(f"named_struct('top1_prob', pred.top1_prob, 'topk', {topk})"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_strings(converted: DataFrame, path: str) -> None:
    """The valid canonical strings, one to a line."""
    converted.where("valid").select("canonical").write.mode("overwrite").text(path)


def json_records(df: DataFrame) -> DataFrame:
    """One column, json: each row as a JSON object; nulls are left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """token, id as JSON lines in one file; a vocabulary has 10,000 rows at most."""
    vocabulary.select("token", "id").coalesce(1).write.mode("overwrite").json(path)


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The vocabulary, and the id that its next token gets."""
    df = spark.read.schema("token string, id int").json(path)
    return df, int(df.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]) + 1


def append_log(df: DataFrame, path: str) -> None:
    """Metrics with the time they were logged."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
