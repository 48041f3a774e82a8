"""Ligands with bond orders, and repair, over orders read as molecules and as strings, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chelate.checkpoints import written
from chelate.constants import POLYHEDRA, Config, polyhedron
from chelate.functions.alignment import LABELS, assignment_measures, kabsch
from chelate.functions.smiles import canonical_smiles
from chelate.operators.repair import context_scorer, repair_by_context
from chelate.plans.encode import coordination, ligands
from chelate.plans.large import grid_edges
from chelate.queries.registry import registry
from chelate.queries.samples import COMPLEXES, complexes, table

QUERIES, ORACLES, query = registry()

#: Lines of an order as atoms in their order; key tells repeated line numbers apart.
KEY = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
ATOMS = f"""a AS (SELECT l_orderkey AS mol, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(KEY)}) AS INTEGER) AS i,
  CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'N' ELSE 'O' END AS element, l_partkey AS part, l_suppkey AS supp FROM lineitem)"""


def atoms_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol and atoms: (line, element, part, supp) in their order; an order has some seven lines."""
    element = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "N", "N").otherwise("O")
    atom = F.struct(*KEY, element.alias("element"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mol")).agg(F.array_sort(F.collect_list(atom)).alias("atoms"))


@query(f"""WITH {ATOMS}, n AS (SELECT *, lead(i) OVER w AS next FROM a WINDOW w AS (PARTITION BY mol ORDER BY i)),
c AS (SELECT mol, string_agg(element || CASE WHEN next IS NULL THEN '' ELSE CAST(1 + part % 3 AS VARCHAR) END, '' ORDER BY i) AS there, string_agg(CASE WHEN next IS NULL THEN '' ELSE CAST(1 + part % 3 AS VARCHAR) END || element, '' ORDER BY i DESC) AS back FROM n GROUP BY mol)
SELECT mol, min(mol) OVER (PARTITION BY least(there, back)) AS class, count(*) OVER (PARTITION BY least(there, back)) AS n FROM c""")
def ligand_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chains of atoms, given in an order of their own: the first order and the number of those with the same ligand."""
    df = atoms_of(spark, sf_dir)
    # atoms by a digest, so that the chain's ends are anywhere
    place = "transform(array_sort(transform(atoms, (a, i) -> named_struct('h', xxhash64(mol, i), 'i', i))), s -> s.i)"
    df = df.withColumn("place", F.expr(place)).where("size(atoms) > 0")
    at = "int(array_position(place, {})) - 1"
    bonds = f"transform(filter(sequence(0, size(atoms) - 1), i -> i > 0), i -> named_struct('i', {at.format('i - 1')}, 'j', {at.format('i')}, 'bo', float(0.6 + atoms[i - 1].part % 3)))"
    df = df.select("mol", F.expr("transform(place, i -> atoms[i].element)").alias("elements"), F.expr(bonds).alias("bonds"))
    zeros = F.transform("elements", lambda x: F.lit(0))
    df = df.withColumn("smiles", F.get(canonical_smiles(F.col("elements"), F.col("bonds"), zeros, F.array(F.lit(0))), F.lit(0))).select("mol", "smiles")
    df = written(df)  # both sides of the join, and its condition that a key isn't null, would make them anew
    classes = df.groupBy("smiles").agg(F.min("mol").alias("class"), F.count("*").alias("n"))
    return df.join(classes, "smiles").select("mol", "class", "n")


@query(f"""WITH {ATOMS}, b AS (SELECT *, CASE WHEN i > 1 AND lag((supp % 5) * 0.07::DOUBLE) OVER w > 0.1 THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS (PARTITION BY mol ORDER BY i)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY mol ORDER BY i) AS p, (part % 10) * 0.1::DOUBLE > 0.35 AS donor, lead(fresh) OVER (PARTITION BY mol ORDER BY i) = 0 AS linked FROM b),
e AS (SELECT mol, p, element, count(*) AS n FROM p GROUP BY mol, p, element),
f AS (SELECT mol, p, string_agg(element || CASE WHEN n = 1 THEN '' ELSE CAST(n AS VARCHAR) END, '' ORDER BY element) AS formula FROM e GROUP BY mol, p),
d AS (SELECT mol, p, count(*) FILTER (donor) AS dent, bool_and(element = 'C') FILTER (donor) AS carbon, min(i) FILTER (donor) AS low, max(i) FILTER (donor) AS high FROM p GROUP BY mol, p)
SELECT mol, CAST(row_number() OVER (PARTITION BY mol ORDER BY p) AS INTEGER) AS ligand, formula, CAST(dent AS INTEGER) AS dent, CASE WHEN dent = 2 AND carbon AND high = low + 1 THEN 2 END AS eta FROM d JOIN f USING (mol, p) WHERE dent > 0""")
def bond_order_ligands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules with bond orders: a metal and the lines about it; neighbouring lines are bound where their order is above the bar."""
    df = atoms_of(spark, sf_dir)
    atoms = "concat(array(named_struct('idx', 0, 'element', 'Fe', 'x', 0D, 'y', 0D, 'z', 0D)), transform(atoms, (a, i) -> named_struct('idx', i + 1, 'element', a.element, 'x', 10D * (i + 1), 'y', 0D, 'z', 0D)))"
    metal = "transform(atoms, (a, i) -> named_struct('i', 0, 'j', i + 1, 'bo', float((a.part % 10) * 0.1D)))"
    chain = "transform(filter(sequence(0, size(atoms) - 1), i -> i > 0), i -> named_struct('i', i, 'j', i + 1, 'bo', float((atoms[i - 1].supp % 5) * 0.07D)))"
    config = Config(bond_order=0.35, edge_order=0.1)
    df = df.select("mol", F.expr(atoms).alias("atoms"), F.expr(f"concat({metal}, {chain})").alias("bonds"))
    rows = "transform(ligands, (l, k) -> named_struct('ligand', k + 1, 'formula', l.smiles, 'dent', l.dent, 'eta', l.eta))"
    # of a plain inline() Spark would ask beforehand whether there are rows, by working the ligands out twice
    return ligands(coordination(df, config), config).select("mol", F.expr(f"inline_outer({rows})")).where("ligand IS NOT NULL")


#: Fixed of each order: a string, with one structure token replaced where the order's key says so.
MARKS = ("]", "}", ")", "[UNK]", "|")
SIZE = 9


def order_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tokens and clean: a string of each order, one of whose tokens is damaged."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.substring("o_orderpriority", 1, 1).alias("p"), F.col("o_orderstatus").alias("s"))
    tokens = F.array(F.lit("[Metal:"), F.lit("Fe"), F.lit("]"), F.lit("<"), F.col("p"), F.lit(">"), F.lit("|L1="), F.col("s"), F.lit("|"))
    place, mark = (F.col("c") % SIZE).cast("int"), F.get(F.array(*map(F.lit, MARKS)), (F.col("id") % len(MARKS)).cast("int"))
    return o.select("id", tokens.alias("clean"), F.transform(tokens, lambda t, i: F.when(i == place, mark).otherwise(t)).alias("tokens"))


def sql_valid(s: str) -> str:
    stack = f"""list_reduce(string_split({s}, ''), lambda st, c: CASE WHEN st = 'X' THEN 'X' WHEN c IN ('(', '[', '{{', '<') THEN st || c
      WHEN c IN (')', ']', '}}', '>') THEN CASE WHEN right(st, 1) = translate(c, ')]}}>', '([{{<') THEN left(st, length(st) - 1) ELSE 'X' END ELSE st END, '')"""
    return f"(length({s}) >= 10 AND (contains({s}, '[Metal:') OR contains({s}, '|L')) AND {stack} = '')"


TOKENS = "['[Metal:', 'Fe', ']', '<', left(o_orderpriority, 1), '>', '|L1=', o_orderstatus, '|']"
CONTEXT_REPAIR = f"""WITH RECURSIVE o AS (SELECT o_orderkey AS id, {TOKENS} AS clean, CAST(o_custkey % {SIZE} AS INTEGER) AS place, [{', '.join(repr(m) for m in MARKS)}][o_orderkey % {len(MARKS)} + 1] AS mark FROM orders),
d AS (SELECT id, list_transform(clean, lambda t, i: CASE WHEN i = place + 1 THEN mark ELSE t END) AS tokens FROM o),
g AS (SELECT coalesce(clean[i - 1], '') AS before, coalesce(clean[i + 1], '') AS after, clean[i] AS token, count(*) AS n FROM (SELECT clean, unnest(range(1, {SIZE} + 1)) AS i FROM o) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY before, after ORDER BY n DESC, token) AS rank FROM g),
w(id, i, tokens, edits, ok) AS (
  SELECT id, 1, tokens, '', {sql_valid("array_to_string(tokens, '')")} FROM d
  UNION ALL
  SELECT w.id, w.i + 1, CASE WHEN min(e.rank) IS NULL THEN w.tokens ELSE list_concat(w.tokens[1:w.i - 1], [arg_min(e.token, e.rank)], w.tokens[w.i + 1:]) END,
    CASE WHEN min(e.rank) IS NULL THEN w.edits ELSE w.edits || w.i - 1 || w.tokens[w.i] || '>' || arg_min(e.token, e.rank) || ' ' END, w.ok
  FROM w LEFT JOIN (SELECT v.id, k.token, k.rank FROM w v JOIN k ON k.rank <= 5 AND k.before = coalesce(v.tokens[v.i - 1], '') AND k.after = coalesce(v.tokens[v.i + 1], '') AND k.token <> v.tokens[v.i]
    WHERE NOT v.ok AND v.tokens[v.i] IN ('(', ')', '[', ']', '{{', '}}', '<', '>', '|', ';', ',', '+', '-', '=', ':', '[UNK]') AND {sql_valid("array_to_string(list_concat(v.tokens[1:v.i - 1], [k.token], v.tokens[v.i + 1:]), '')")}) e ON e.id = w.id
  WHERE w.i <= {SIZE} GROUP BY w.id, w.i, w.tokens, w.edits, w.ok)
SELECT id, array_to_string(tokens, '') AS repaired, edits, ok AS was_valid, {sql_valid("array_to_string(tokens, '')")} AS is_valid FROM w WHERE i = {SIZE} + 1"""


@query(CONTEXT_REPAIR)
def context_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged strings of orders, repaired by what stands between the same neighbours in the clean ones."""
    df = order_strings(spark, sf_dir)
    out = repair_by_context(df.select("id", "tokens"), "tokens", context_scorer(df, "clean"))
    edits = F.array_join(F.transform("edits", lambda e: F.concat(e.pos.cast("string"), e["from"], F.lit(">"), e["to"], F.lit(" "))), "")
    return out.select("id", "repaired", edits.alias("edits"), F.col("was_valid_before").alias("was_valid"), F.col("is_valid_after").alias("is_valid"))


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol, cn and points of each order, in order."""
    c = complexes(spark, sf_dir)
    return c.groupBy("mol", "cn").agg(F.array_sort(F.collect_list(F.struct("ord", "part", "x", "y", "z"))).alias("points"))


VERTICES = ", ".join(
    f"({n}, '{LABELS.get((n, label), label)}', {j}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)"
    for n, shapes in POLYHEDRA.items()
    for label, points in shapes.items()
    for j, (x, y, z) in enumerate(polyhedron([tuple(map(float, p)) for p in points]), 1)
)
LEAST_ASSIGNMENT = f"""WITH RECURSIVE {COMPLEXES}, v(cn, label, j, vx, vy, vz) AS (VALUES {VERTICES}),
r AS (SELECT *, avg(sqrt(x * x + y * y + z * z)) OVER (PARTITION BY mol) AS radius FROM c WHERE cn BETWEEN 2 AND 6),
d AS (SELECT mol, cn, label, ord, list(sqrt((x / radius - vx) ** 2 + (y / radius - vy) ** 2 + (z / radius - vz) ** 2) ORDER BY j) AS row FROM r JOIN v USING (cn) WHERE radius >= 1e-6 GROUP BY mol, cn, label, ord, x, y, z),
m AS (SELECT mol, cn, label, list(row ORDER BY ord) AS cost FROM d GROUP BY mol, cn, label),
o(n, way) AS (SELECT 0, CAST([] AS INTEGER[]) UNION ALL SELECT n + 1, list_append(way, k) FROM o, (SELECT unnest(range(1, 7))::INTEGER AS k) WHERE n < 6 AND NOT list_contains(way, k)),
w AS (SELECT n, way FROM o WHERE list_max(way) = n)
SELECT mol, label, round(min(list_sum(list_transform(way, lambda k, i: cost[i][k]))), 6) AS cost FROM m JOIN w ON w.n = m.cn GROUP BY mol, label"""


@query(LEAST_ASSIGNMENT)
def least_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least sum of distances with which an order's points take the vertices of each polyhedron."""
    # of a plain explode() Spark would ask beforehand whether there are rows, by measuring them all twice
    df = spheres(spark, sf_dir).select("mol", F.explode_outer(assignment_measures(F.transform("points", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), p.z.alias("z"))))).alias("m"))
    return df.where("m.cost IS NOT NULL").select("mol", "m.label", F.round("m.cost", 6).alias("cost"))


#: Points in another order of axes, every other one a mirror image, shifted by what a line holds.
OTHER = {"x": "{0}y + {0}part % 7", "y": "{0}z - {0}part % 3", "z": "{0}x * CASE WHEN mol % 2 = 0 THEN 1 ELSE -1 END"}
RIGID_RMSD = f"""WITH {COMPLEXES}, q AS (SELECT mol, x, y, z, {OTHER['x'].format('')} AS u, {OTHER['y'].format('')} AS v, {OTHER['z'].format('')} AS w FROM c),
k AS (SELECT mol, x, y, z, u - avg(u) OVER g AS u, v - avg(v) OVER g AS v, w - avg(w) OVER g AS w FROM q WINDOW g AS (PARTITION BY mol)),
h AS (SELECT mol, count(*) AS n, sum(x * x + y * y + z * z + u * u + v * v + w * w) AS e, sqrt(sum(x * x + y * y + z * z) * sum(u * u + v * v + w * w)) AS two, sum(x * u) AS a, sum(x * v) AS b, sum(x * w) AS c, sum(y * u) AS d, sum(y * v) AS f, sum(y * w) AS g, sum(z * u) AS i, sum(z * v) AS j, sum(z * w) AS l FROM k GROUP BY mol),
s AS (SELECT mol, n, e, two, a * (f * l - g * j) - b * (d * l - g * i) + c * (d * j - f * i) AS det, sqrt((f * l - g * j) ** 2 + (d * l - g * i) ** 2 + (d * j - f * i) ** 2 + (b * l - c * j) ** 2 + (a * l - c * i) ** 2 + (a * j - b * i) ** 2 + (b * g - c * f) ** 2 + (a * g - c * d) ** 2 + (a * f - b * d) ** 2) AS cof, a * a + d * d + i * i AS p, b * b + f * f + j * j AS q, c * c + g * g + l * l AS r, a * b + d * f + i * j AS pq, a * c + d * g + i * l AS pr, b * c + f * g + j * l AS qr FROM h),
m AS (SELECT *, (p + q + r) / 3 AS mid FROM s), t AS (SELECT *, sqrt(((p - mid) ** 2 + (q - mid) ** 2 + (r - mid) ** 2 + 2 * (pq ** 2 + pr ** 2 + qr ** 2)) / 6) AS dev FROM m),
z AS (SELECT *, CASE WHEN dev < 1e-12 THEN 0 ELSE acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((p - mid) * ((q - mid) * (r - mid) - qr ** 2) - pq * (pq * (r - mid) - qr * pr) + pr * (pq * qr - (q - mid) * pr)) / (2 * dev ** 3)))) / 3 END AS phi FROM t),
g AS (SELECT mol, n, e, two, det, cof, mid + 2 * dev * cos(phi) AS l1, mid + 2 * dev * cos(phi + 2 * pi() / 3) AS l3, mid FROM z)
SELECT mol, round(greatest(0, e - 2 * CASE WHEN n < 3 THEN two WHEN n = 3 THEN sqrt(3 * mid + 2 * cof) ELSE sqrt(greatest(0, l1)) + sqrt(greatest(0, 3 * mid - l1 - l3))
  + sign(det) * CASE WHEN l1 * greatest(0, 3 * mid - l1 - l3) < 1e-6 THEN sqrt(greatest(0, l3)) ELSE abs(det) / sqrt(l1 * greatest(0, 3 * mid - l1 - l3)) END END) / n + 0.00123, 2) AS msd FROM g"""


@query(RIGID_RMSD)
def rigid_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean squared distance left when an order's points are turned onto a changed copy; no mirror image is a turn.

    Rounded off the fractions that points on a lattice have.
    """
    other = ", ".join(f"'{k}', double({e.format('p.')})" for k, e in OTHER.items())
    df = spheres(spark, sf_dir)
    p, q = (F.expr(f"transform(points, p -> named_struct({fields}))") for fields in ("'x', p.x, 'y', p.y, 'z', p.z", other))
    return df.select("mol", kabsch(p, q).alias("k")).select("mol", F.round(F.col("k.rmsd") * F.col("k.rmsd") + 0.00123, 2).alias("msd"))


ATOM_ROWS = """t AS (SELECT l_suppkey AS mol, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS INTEGER) AS idx,
  l_quantity AS x, round_even(l_discount * 100, 0) AS y, round_even(l_tax * 100, 0) AS z FROM lineitem)"""


@query(f"""WITH {ATOM_ROWS}, e AS (SELECT a.mol, a.idx AS i, b.idx AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM t a JOIN t b ON a.mol = b.mol AND a.idx < b.idx AND abs(a.x - b.x) < 1.8)
SELECT mol, count(*) AS n_edges, sum(i) AS low, sum(j) AS high, round(sum(d), 4) AS length FROM e WHERE d < 1.8 GROUP BY mol""")
def grid_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines as the atoms of one structure: its bonds by the grid."""
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    atoms = lines.select(F.col("l_suppkey").alias("mol"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)).alias("idx"), F.col("l_quantity").alias("x"), F.rint(F.col("l_discount") * 100).alias("y"), F.rint(F.col("l_tax") * 100).alias("z"))
    return grid_edges(atoms).groupBy("mol").agg(F.count("*").alias("n_edges"), F.sum(F.col("i").cast("long")).alias("low"), F.sum(F.col("j").cast("long")).alias("high"), F.round(F.sum("distance"), 4).alias("length"))
