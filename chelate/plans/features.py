"""Feature vectors and checks of encoded complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ISSUE = "array<struct<code:string,message:string,severity:string>>"


def features(encoded: DataFrame) -> DataFrame:
    """tokens, geom (17 numbers), metal_vector (7) and ligand_features of each complex."""
    low = "shape.ref_shapes[int(array_position(shape.values, array_min(shape.values))) - 1]"
    shapes = f"IF(size(shape.values) > 0, concat(array(concat('GEO=', {low})), zip_with(shape.ref_shapes, shape.values, (n, v) -> concat(n, CASE WHEN v < 1 THEN '_low' WHEN v < 5 THEN '_mid' ELSE '_high' END))), cast(array() AS array<string>))"
    ligs = "flatten(transform(ligands, l -> filter(array(concat('$', l.lig_id), concat('dent=', l.dent), IF(l.eta > 0, concat('eta=', l.eta), NULL)), t -> t IS NOT NULL)))"
    words = f"filter(concat(array(concat('[', metal_state.element, ']'), concat('ox=', metal_state.oxidation), concat('d', metal_state.dcount), concat('CN=', cn)), {shapes}, transform(trans, p -> concat('trans:', p.a.lig, '-', p.b.lig)), array(concat('fm=', fac_mer)), {ligs}), t -> t IS NOT NULL)"
    geom = "concat(transform(sequence(1, 9), k -> IF(cn = k, 1D, 0D)), transform(sequence(0, 3), k -> coalesce(get(shape.values, k), 0D)), array(double(size(trans)), IF(fac_mer IS NULL, 1D, 0D), IF(fac_mer <=> 'fac', 1D, 0D), IF(fac_mer <=> 'mer', 1D, 0D)))"
    m = "metal_state"
    metal = f"array(IF({m}.phys_vec[0] = 4, 1D, 0D), IF({m}.phys_vec[0] = 5, 1D, 0D), IF({m}.phys_vec[0] = 6, 1D, 0D), ({m}.phys_vec[1] - 3) / 9, {m}.phys_vec[2] / 3, (coalesce({m}.oxidation, 2) + 2) / 8D, coalesce({m}.dcount, 6) / 10D)"
    lig = "transform(ligands, l -> named_struct('lig_id', l.lig_id, 'smiles', l.smiles, 'dent', l.dent, 'eta', l.eta, 'donor_elements', l.donor_elements, 'mw', l.mw))"
    return encoded.select("mol_id", F.expr(words).alias("tokens"), F.expr(geom).alias("geom"), F.expr(metal).alias("metal_vector"), F.expr(lig).alias("ligand_features"))


def check(encoded: DataFrame) -> DataFrame:
    """Add checks: issues of the coordination number, shape, ligands and constraints, one for each thing found; nothing raises.

    A molecule that could not be encoded has neither donors nor a shape to check: the missing shape warns.
    """
    issue = lambda code, message, severity: f"named_struct('code', '{code}', 'message', {message}, 'severity', '{severity}')"
    none = f"cast(array() AS {ISSUE})"
    found = lambda when, *what: f"IF({when}, array({issue(*what)}), {none})"
    each = lambda rows, x, *what: f"transform({rows}, {x} -> {issue(*what)})"
    text = lambda pairs: f"transform({pairs}, p -> concat(p.a.text, '--', p.b.text))"
    known, least = "failure IS NULL AND ", "array_min(shape.values)"
    shaped = f"{known} coalesce(size(shape.values), 0) > 0"
    # of pairs given more than once, all but the first
    again = f"filter({text('trans')}, (p, i) -> array_position({text('trans')}, p) <= i)"
    # fixed values: codes and messages
    issues = [
        found(f"{known} cn = 0", "NO_DONORS", "'No donor atoms found'", "error"),
        found(f"{known} cn > 12", "UNUSUAL_GEOMETRY", "concat('Unusually high coordination number: ', cn)", "warning"),
        found(f"NOT ({shaped})", "SHAPE_COMPUTATION_FAILED", "'Shape vector is missing'", "warning"),
        found(f"{shaped} AND shape.cn <> cn", "UNUSUAL_GEOMETRY", "concat('CN mismatch: shape CN=', shape.cn, ', actual CN=', cn)", "warning"),
        found(f"{shaped} AND {least} > 10", "UNUSUAL_GEOMETRY", f"concat('Very distorted geometry: min CShM = ', IF({least} = double('Infinity'), 'inf', format_string('%.2f', {least})))", "warning"),
        each("filter(ligands, l -> l.dent <> size(l.donor_elements))", "l", "LIGAND_INCONSISTENCY", "concat(l.lig_id, ': dent=', l.dent, ' but ', size(l.donor_elements), ' donor elements')", "warning"),
        each("filter(ligands, l -> coalesce(l.smiles, '') = '')", "l", "RDKIT_SANITIZE_FAILED", "concat(l.lig_id, ': Empty SMILES')", "warning"),
        each(again, "p", "DUPLICATE_CONSTRAINT", "concat('Duplicate trans pair: ', p)", "warning"),
        each(f"filter({text('cis')}, p -> array_contains({text('trans')}, p))", "p", "CONSTRAINT_CONTRADICTION", "concat('Pair is both trans and cis: ', p)", "error"),
    ]
    return encoded.withColumn("checks", F.expr(f"concat({', '.join(f'coalesce({i}, {none})' for i in issues)})"))


def check_summary(checked: DataFrame) -> DataFrame:
    """One row: total, valid, with_errors (an error wins), with_warnings; issues as a map of counts by code."""
    # few combinations of issues occur: one pass counts them, and the rest is sums over these
    kinds = checked.groupBy("checks").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("checks", "n")).alias("k"))
    total = lambda when: F.expr(f"aggregate(filter(k, c -> {when}), 0L, (s, c) -> s + c.n)")
    error, warning = ("exists(c.checks, i -> i.severity = '{}')".format(x) for x in ("error", "warning"))
    codes = "array_sort(array_distinct(flatten(transform(k, c -> c.checks.code))))"
    count = "aggregate(k, 0L, (s, c) -> s + c.n * size(filter(c.checks, i -> i.code = x)))"
    issues = F.expr(f"map_from_arrays({codes}, transform({codes}, x -> {count}))")
    return kinds.select(total("true").alias("total"), total("size(c.checks) = 0").alias("valid"), total(error).alias("with_errors"), total(f"NOT {error} AND {warning}").alias("with_warnings"), issues.alias("issues"))


def rotated(molecules: DataFrame, seed: int) -> DataFrame:
    """Molecules turned by a rotation that the seed and id fix, for trials of invariance; write them before encoding."""
    u = [F.pmod(F.xxhash64("mol_id", F.lit(seed), F.lit(k)), F.lit(2001)) / 1000 - 1.0005 for k in range(4)]
    q = molecules.withColumn("_q", F.array(*u)).withColumn("_n", F.expr("sqrt(aggregate(_q, 0D, (s, x) -> s + x * x))")).withColumn("_q", F.transform("_q", lambda x: x / F.col("_n")))
    w, x, y, z = (f"_q[{k}]" for k in range(4))
    rows = [(f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} - {z} * {w})", f"2 * ({x} * {z} + {y} * {w})"), (f"2 * ({x} * {y} + {z} * {w})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} - {x} * {w})"), (f"2 * ({x} * {z} - {y} * {w})", f"2 * ({y} * {z} + {x} * {w})", f"1 - 2 * ({x} * {x} + {y} * {y})")]
    xyz = ", ".join(f"'{k}', ({r[0]}) * a.x + ({r[1]}) * a.y + ({r[2]}) * a.z" for k, r in zip("xyz", rows, strict=True))
    return q.withColumn("atoms", F.expr(f"transform(atoms, a -> named_struct('idx', a.idx, 'element', a.element, {xyz}))")).drop("_q", "_n")


def permuted(molecules: DataFrame, seed: int) -> DataFrame:
    """Molecules with their atoms, and bonds, in an order that the seed and id fix."""
    order = f"transform(array_sort(transform(atoms, a -> named_struct('h', xxhash64(mol_id, a.idx, {seed}), 'i', a.idx))), s -> s.i)"
    at = "int(array_position(_order, {})) - 1"
    df = molecules.withColumn("_order", F.expr(order))
    df = df.withColumn("atoms", F.expr("transform(_order, (o, i) -> named_struct('idx', i, 'element', atoms[o].element, 'x', atoms[o].x, 'y', atoms[o].y, 'z', atoms[o].z))"))
    a, b = at.format("e.i"), at.format("e.j")
    return df.withColumn("bonds", F.expr(f"transform(bonds, e -> named_struct('i', least({a}, {b}), 'j', greatest({a}, {b}), 'bo', e.bo))")).drop("_order")


def noisy(molecules: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Molecules with Gaussian noise on every coordinate, by digests through the Box-Muller transform."""
    u = lambda k: f"((pmod(xxhash64(mol_id, a.idx, {seed}, '{k}'), 1000003) + 0.5D) / 1000003)"
    shift = lambda k: f"{sigma}D * sqrt(-2 * ln({u(k + '1')})) * cos(2 * pi() * {u(k + '2')})"
    return molecules.withColumn("atoms", F.expr("transform(atoms, a -> named_struct('idx', a.idx, 'element', a.element, " + ", ".join(f"'{k}', a.{k} + {shift(k)}" for k in "xyz") + "))"))


def match_rate(strings: DataFrame, trials: DataFrame, key: str = "source_id") -> DataFrame:
    """key, n, match: the share of trials whose string equals the original's."""
    same = (F.col("_t") == F.col("canonical")).cast("double")
    return strings.join(trials.select(key, F.col("canonical").alias("_t")), key).groupBy(key).agg(F.count("*").alias("n"), F.avg(same).alias("match"))


def metal_table(converted: DataFrame) -> DataFrame:
    """metal, cn, n, rank: how often each metal and coordination number occurs."""
    # counted by a condition and not filtered before: a filter would be pushed into the encoding and repeat it
    n = converted.groupBy("metal", "cn").agg(F.count_if("valid").alias("n")).where("n > 0")
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("metal").orderBy(F.desc("n"), "cn")))
