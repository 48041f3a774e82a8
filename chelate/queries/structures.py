"""Geometry, graph and canonical forms over orders read as complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chelate import constants
from chelate.functions import geometry
from chelate.plans import encode as plan
from chelate.plans import features as feature_plan
from chelate.plans import filters
from chelate.queries.registry import registry
from chelate.queries.samples import COMPLEXES, complexes, table

QUERIES, ORACLES, query = registry()
ORIGIN = "named_struct('x', 0D, 'y', 0D, 'z', 0D)"
DIST = "sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"


def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol, cn and points, the donors of an order in their order: at most some dozen each."""
    c = complexes(spark, sf_dir)
    return c.groupBy("mol", "cn").agg(F.array_sort(F.collect_list(F.struct("ord", "donor", "part", "x", "y", "z"))).alias("points"))


def point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's pairs of donors, i < j, within its own row: no join."""
    g = gathered(spark, sf_dir).where("cn > 1")
    pair = f"named_struct('i', p.ord, 'j', q.ord, 'd', {geometry.distance('p', 'q')}, 'angle', {geometry.angle('p', 'o', 'q')})"
    pairs = f"flatten(transform(array({ORIGIN}), o -> flatten(transform(points, p -> transform(filter(points, q -> q.ord > p.ord), q -> {pair})))))"
    return g.select("mol", "cn", F.explode(F.expr(pairs)).alias("e")).select("mol", "cn", "e.*")


PAIRS = f"""{COMPLEXES}, pr AS (SELECT p.mol, p.cn, p.ord AS i, q.ord AS j, {DIST.format(a='p', b='q')} AS d, sqrt(p.x * p.x + p.y * p.y + p.z * p.z) AS lp, sqrt(q.x * q.x + q.y * q.y + q.z * q.z) AS lq, p.x * q.x + p.y * q.y + p.z * q.z AS dot
  FROM c p JOIN c q ON p.mol = q.mol AND p.ord < q.ord), an AS (SELECT *, CASE WHEN lp < 1e-6 OR lq < 1e-6 THEN 0 ELSE degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, dot / (lp * lq))))) END AS angle FROM pr)"""


@query(f"WITH {PAIRS} SELECT mol, i, j, round(d, 4) AS d FROM an")
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_pairs(spark, sf_dir).select("mol", "i", "j", F.round("d", 4).alias("d"))


CLASS = "CASE WHEN angle >= 165 THEN 'trans' WHEN angle BETWEEN 75 AND 105 THEN 'cis' ELSE 'other' END"


@query(f"WITH {PAIRS} SELECT cn, {CLASS} AS class, count(*) AS n FROM an GROUP BY ALL")
def angle_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = point_pairs(spark, sf_dir)
    return p.groupBy("cn", F.expr(geometry.angle_class("angle")).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT mol, count_if({CLASS} = 'trans')::BIGINT AS n_trans, count_if({CLASS} = 'cis')::BIGINT AS n_cis FROM an GROUP BY mol")
def trans_cis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr(geometry.angle_class("angle"))
    return point_pairs(spark, sf_dir).groupBy("mol").agg(F.count_if(c == "trans").alias("n_trans"), F.count_if(c == "cis").alias("n_cis"))


@query(f"WITH {PAIRS} SELECT mol, CASE WHEN count_if({CLASS} = 'trans') > 0 THEN 'mer' WHEN count_if({CLASS} = 'cis') = 3 THEN 'fac' END AS verdict FROM an WHERE cn = 3 GROUP BY mol")
def fac_mer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr(geometry.angle_class("angle"))
    return point_pairs(spark, sf_dir).where("cn = 3").groupBy("mol").agg(F.when(F.count_if(c == "trans") > 0, "mer").when(F.count_if(c == "cis") == 3, "fac").alias("verdict"))


@query(f"""WITH {COMPLEXES}, r AS (SELECT mol, ord, sqrt(x * x + y * y + z * z) AS d, 1 / greatest(sqrt(x * x + y * y + z * z), 0.5::DOUBLE) AS score FROM c)
SELECT mol, ord, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY mol ORDER BY round(score, 9) DESC, round(d, 9), ord) AS INTEGER) AS rank FROM r""")
def neighbor_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.expr("sqrt(x * x + y * y + z * z)")
    r = complexes(spark, sf_dir).select("mol", "ord", d.alias("d"), (1 / F.greatest(d, F.lit(0.5))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("mol").orderBy(F.desc(F.round("score", 9)), F.round("d", 9), "ord"))
    return r.select("mol", "ord", F.round("score", 6).alias("score"), rank.alias("rank"))


@query(f"""WITH {COMPLEXES}, r AS (SELECT mol, ord, donor, CAST(round_even(round(sqrt(x * x + y * y + z * z), 6) * 100, 0) AS BIGINT) * 1000000000 + part AS key FROM c)
SELECT mol, ord, donor, CAST(row_number() OVER (PARTITION BY mol, donor ORDER BY key, ord) AS INTEGER) AS rank FROM r""")
def donor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.rint(F.round(F.expr("sqrt(x * x + y * y + z * z)"), 6) * 100).cast("bigint") * 1_000_000_000 + F.col("part")
    return complexes(spark, sf_dir).select("mol", "ord", "donor", F.row_number().over(Window.partitionBy("mol", "donor").orderBy(key, "ord")).alias("rank"))


@query("""WITH e AS (SELECT event_id, [value, value / 2, value / 4, value / 8, value / 16, value / 32, value / 64] AS f FROM events)
SELECT event_id, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(f[:6], lambda d: CAST(round_even(d * 10000, 0) AS HUGEINT))), lambda s, d: (s * 100003 + d) % 1000000000000000) AS BIGINT) AS sig FROM e""")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.array(*[F.col("value") / 2**k for k in range(7)]).alias("f"))
    return e.select("event_id", F.expr(geometry.signature("f")).cast("bigint").alias("sig"))


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as molecules: a metal by the order's key at the centroid, donors by return flag, shrunk to bonding distance."""
    g = gathered(spark, sf_dir)
    metals = F.array(*[F.lit(m) for m in constants.METALS])
    metal = F.element_at(metals, (F.pmod("mol", F.lit(len(constants.METALS))) + 1).cast("int"))
    kind = "CASE p.donor WHEN 'A' THEN 'N' WHEN 'N' THEN 'O' ELSE 'Cl' END"
    donors = f"transform(points, (p, i) -> named_struct('idx', i + 1, 'element', {kind}, 'x', p.x / 12, 'y', p.y / 2.5, 'z', p.z / 2.5))"
    first = F.struct(F.lit(0).alias("idx"), metal.alias("element"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return g.select(F.col("mol").cast("string").alias("mol_id"), F.col("mol").alias("seq"), F.concat(F.array(first), F.expr(donors)).alias("atoms"), F.lit(None).cast("array<struct<i:int,j:int,bo:float>>").alias("bonds"), F.lit(None).cast("map<string,double>").alias("properties"))


METAL_ROWS = ", ".join(f"('{m}', {r}, {g}, {e})" for m, (r, g, e) in constants.METALS.items())
OX_ROWS = ", ".join(f"('{m}', {n}, {v})" for m, by in constants.OXIDATION.items() for n, v in by.items())


def matrix(points: list) -> list[list[float]]:
    return [[sum((a[k] - b[k]) ** 2 for k in range(3)) ** 0.5 for b in points] for a in points]


#: Reference polyhedra: number of vertices, place in label order, label, distances, each row's distances sorted.
POLYHEDRA = ", ".join(
    f"({n}, {i}, '{label}', {(d := matrix(constants.polyhedron(p)))!r}::DOUBLE[][], {[sorted(r) for r in d]!r}::DOUBLE[][])" for n, shapes in constants.POLYHEDRA.items() for i, (label, p) in enumerate(shapes.items())
)
#: The molecules below, encoded: n holds donors in rank order with their part's ligand, s sites, pr pairs of sites, m metals, mol by mol.
ENCODED = f"""{COMPLEXES}, info(metal, r, g, en) AS (VALUES {METAL_ROWS}), ox(metal, cn, ox) AS (VALUES {OX_ROWS}),
metals AS (SELECT list(metal ORDER BY i) AS names FROM (SELECT metal, row_number() OVER () AS i FROM info)),
a AS (SELECT mol, ord AS idx, CASE donor WHEN 'A' THEN 'N' WHEN 'N' THEN 'O' ELSE 'Cl' END AS element, CASE donor WHEN 'A' THEN 7 WHEN 'N' THEN 8 ELSE 17 END AS num, x / 12 AS x, y / 2.5::DOUBLE AS y, z / 2.5::DOUBLE AS z FROM c),
e AS (SELECT p.mol, p.idx AS a, q.idx AS b FROM a p JOIN a q ON p.mol = q.mol AND p.idx <> q.idx AND {DIST.format(a="p", b="q")} < 1.8),
walk AS (SELECT mol, idx AS v, idx AS u FROM a UNION SELECT w.mol, w.v, e.b FROM walk w JOIN e ON e.mol = w.mol AND e.a = w.u),
part AS (SELECT mol, v AS idx, min(u) AS part FROM walk GROUP BY mol, v),
n AS (SELECT *, row_number() OVER (PARTITION BY mol ORDER BY 1 / greatest(d, 0.5::DOUBLE) DESC, d, num DESC, idx) AS pos, dense_rank() OVER (PARTITION BY mol ORDER BY part) AS lig
  FROM (SELECT a.*, part, sqrt(x * x + y * y + z * z) AS d FROM a JOIN part USING (mol, idx)) WHERE d < 2.8),
cns AS (SELECT mol, CAST(count(*) FILTER (d < 2.8) AS INTEGER) AS cn FROM (SELECT mol, sqrt(x * x + y * y + z * z) AS d FROM a) GROUP BY mol),
m AS (SELECT mol, cns.cn, info.*, CAST(CASE WHEN info.metal IN (SELECT metal FROM ox) THEN coalesce(ox.ox, 2) END AS INTEGER) AS oxidation
  FROM cns JOIN info ON info.metal = (SELECT names FROM metals)[mol % {len(constants.METALS)} + 1] LEFT JOIN ox ON ox.metal = info.metal AND ox.cn = cns.cn),
dc AS (SELECT *, CASE WHEN oxidation IS NOT NULL THEN CAST(greatest(0, least(10, g - oxidation)) AS INTEGER) END AS dcount FROM m),
kinds AS (SELECT mol, part, element, count(*) AS k FROM a JOIN part USING (mol, idx) GROUP BY ALL),
formulas AS (SELECT mol, part, string_agg(element || CASE WHEN k = 1 THEN '' ELSE CAST(k AS VARCHAR) END, '' ORDER BY element) AS smiles FROM kinds GROUP BY mol, part),
lg AS (SELECT mol, lig, any_value(smiles) AS smiles, count(*) AS dent, list(num ORDER BY num DESC) AS nums FROM n JOIN formulas USING (mol, part) GROUP BY mol, lig),
s AS (SELECT *, element || ':' || row_number() OVER (PARTITION BY mol, lig, element ORDER BY round_even(d * 10000, 0), pos) AS place FROM n),
pr AS (SELECT p.mol, p.lig AS la, p.place AS pa, q.lig AS lb, q.place AS pb, CASE WHEN p.d < 1e-6 OR q.d < 1e-6 THEN 0 ELSE degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (p.x * q.x + p.y * q.y + p.z * q.z) / (p.d * q.d))))) END AS angle
  FROM s p JOIN s q ON p.mol = q.mol AND p.pos < q.pos),
tr AS (SELECT mol, la, pa, lb, pb FROM pr WHERE angle >= 165),
within AS (SELECT mol, la AS lig, count_if(angle >= 165) AS t, count_if(angle BETWEEN 75 AND 105) AS ci FROM pr WHERE la = lb GROUP BY mol, la),
fm AS (SELECT mol, first(CASE WHEN t > 0 THEN 'mer' ELSE 'fac' END ORDER BY lig) AS fac_mer FROM within JOIN lg USING (mol, lig) WHERE dent = 3 AND (t > 0 OR ci = 3) GROUP BY mol)"""
SUM = "list_reduce(list_prepend(0.0::DOUBLE, {}), lambda s, v: s + v)"
PICK = "list_sort(list_filter(list_transform(costs, lambda cost, j: {'cost': cost, 'j': j}), lambda o: NOT list_contains(taken, CAST(o.j AS DOUBLE))))[1].j"
#: sh: a molecule's measures in label order, rounded ones and labels; each vertex is taken by the row of least cost in signature order.
SHAPES = f"""poly(cn, i, label, dq, sq) AS (VALUES {POLYHEDRA}),
ft AS (SELECT p.mol, p.pos, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.z) AS z, any_value(p.d) AS d, list_prepend(any_value(p.d), list({DIST.format(a="p", b="q")} ORDER BY {DIST.format(a="p", b="q")}))[:6] AS f FROM n p JOIN n q ON p.mol = q.mol GROUP BY p.mol, p.pos),
sg AS (SELECT *, list_reduce(list_prepend(0::HUGEINT, list_transform(f, lambda v: CAST(round_even(v * 10000, 0) AS HUGEINT))), lambda h, v: (h * 100003 + v) % 1000000000000000) AS sig FROM ft),
pt AS (SELECT mol, CAST(count(*) AS INTEGER) AS cn, list({{'x': x, 'y': y, 'z': z}} ORDER BY sig, pos) AS p, {SUM.format("list(d ORDER BY sig, pos)")} / count(*) AS mean FROM sg GROUP BY mol HAVING count(*) BETWEEN 2 AND 6),
sc AS (SELECT mol, cn, list_transform(p, lambda o: {{'x': o.x / scale, 'y': o.y / scale, 'z': o.z / scale}}) AS p FROM (SELECT *, CASE WHEN mean > 1e-6 THEN mean ELSE 1 END AS scale FROM pt)),
dm AS (SELECT mol, cn, list_transform(p, lambda a: list_transform(p, lambda b: sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)))) AS dp FROM sc),
cm AS (SELECT mol, dm.cn, i, label, dp, dq, {SUM.format("list_transform(flatten(dp), lambda v: v * v)")} AS total,
  list_transform(list_transform(dp, lambda r: list_sort(r)), lambda r: list_transform(sq, lambda t, j: list_reduce(list_prepend(1e-10::DOUBLE * (j - 1), list_transform(range(1, dm.cn + 1), lambda k: pow(r[k] - t[k], 2))), lambda x, v: x + v))) AS costs FROM dm JOIN poly USING (cn)),
ways AS (SELECT *, list_reduce(list_prepend([]::DOUBLE[], costs), lambda taken, costs: list_append(taken, CAST({PICK} AS DOUBLE))) AS way FROM cm),
ms AS (SELECT mol, cn, i, label, CASE WHEN total >= 1e-10 THEN 100 * {SUM.format("flatten(list_transform(range(1, cn + 1), lambda a: list_transform(range(1, cn + 1), lambda b: pow(dp[a][b] - dq[CAST(way[a] AS INTEGER)][CAST(way[b] AS INTEGER)], 2))))")} / total ELSE 'inf'::DOUBLE END AS v FROM ways),
sh AS (SELECT mol, cn, list(label ORDER BY i) AS labels, list(v ORDER BY i) AS vs, list(CASE WHEN isinf(v) THEN v ELSE round_even(v, 2) END ORDER BY i) AS rs FROM ms GROUP BY mol, cn)"""
#: The least string over relabelled equal ligands; no order given has more than seven ligands, so ids have one digit.
CANONICAL = f"""WITH RECURSIVE {ENCODED}, {SHAPES}, named AS (SELECT *, row_number() OVER (PARTITION BY mol ORDER BY dent DESC, nums, smiles, lig) AS id FROM lg),
ct AS (SELECT t.mol, x.id AS la, pa, y.id AS lb, pb FROM tr t JOIN named x ON x.mol = t.mol AND x.lig = t.la JOIN named y ON y.mol = t.mol AND y.lig = t.lb),
eq AS (SELECT mol, list(id ORDER BY id) AS ids FROM named GROUP BY mol, smiles),
perm AS (SELECT DISTINCT len(ids) AS k, []::INTEGER[] AS w FROM eq UNION ALL SELECT k, list_append(w, CAST(i AS INTEGER)) FROM perm, (SELECT unnest(range(1, (SELECT max(len(ids)) FROM eq) + 1)) AS i) WHERE len(w) < k AND i <= k AND NOT list_contains(w, i)),
nw AS (SELECT mol, ids, w, 'L' || coalesce(ids[w[list_position(ids, la)]], la) || ':' || pa AS a, 'L' || coalesce(ids[w[list_position(ids, lb)]], lb) || ':' || pb AS b FROM ct JOIN eq USING (mol) JOIN perm ON k = len(ids) AND len(w) = k),
bl AS (SELECT mol, string_agg('{{trans:' || least(a, b) || '--' || greatest(a, b) || '}}', '' ORDER BY least(a, b), greatest(a, b)) AS block FROM nw GROUP BY mol, ids, w),
low AS (SELECT mol, min(block) AS block FROM bl GROUP BY mol),
lb AS (SELECT mol, '|' || string_agg('L' || id || '=' || smiles, '|' ORDER BY id) || '|' AS ligs FROM named GROUP BY mol),
sb AS (SELECT mol, '<ShapeBest:' || labels[list_position(rs, list_min(rs))] || '|Class:' || CASE WHEN list_min(rs) < 1 THEN 'ideal' WHEN list_min(rs) < 3 THEN 'good' WHEN list_min(rs) < 8 THEN 'dist' ELSE 'irreg' END
  || '|Delta:' || CASE WHEN gap < 0.5 THEN 0 WHEN gap < 2 THEN 1 WHEN gap < 5 THEN 2 ELSE 3 END || '|V:' || array_to_string(list_transform(rs, lambda v: CASE WHEN isinf(v) THEN 'inf' ELSE printf('%.2f', v) END), ',') || '>' AS block
  FROM (SELECT *, CASE WHEN len(rs) > 1 THEN list_sort(rs)[2] - list_sort(rs)[1] ELSE 0 END AS gap FROM sh)),
cs AS (SELECT CAST(mol AS VARCHAR) AS source_id, CASE WHEN cn > 0 THEN metal ELSE '?' END AS metal, cn, cn > 0 AS valid, CASE WHEN cn = 0 THEN '[Metal:?|CN:0]||' ELSE '[Metal:' || metal || coalesce('|ox:+' || oxidation, '') || coalesce('|d:d' || dcount, '') || '|CN:' || cn || ']'
  || CASE WHEN cn BETWEEN 2 AND 6 THEN sb.block ELSE '' END || coalesce(low.block, '') || coalesce('{{fm:' || fac_mer || '}}', '') || ligs END AS canonical
  FROM dc LEFT JOIN sb USING (mol) LEFT JOIN low USING (mol) LEFT JOIN fm USING (mol) LEFT JOIN lb USING (mol))"""


@query(f"{CANONICAL} SELECT * FROM cs")
def canonical_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.canonical_strings(molecules(spark, sf_dir))


@query(f"WITH RECURSIVE {ENCODED}, {SHAPES} SELECT CAST(mol AS VARCHAR) AS mol_id, cn, rs[1] AS first_shape, rs[2] AS second_shape FROM sh")
def shape_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded measures in label order; the second is null where a number has one polyhedron."""
    # a condition on cn would be pushed below the measures, where Spark writes the whole encoding out for each use; one on what is exploded stays
    row = "CASE WHEN cn BETWEEN 2 AND 6 THEN array(named_struct('first', get(shape.values_rounded, 0), 'second', get(shape.values_rounded, 1))) END"
    df = plan.encode(molecules(spark, sf_dir)).select("mol_id", "cn", F.explode_outer(F.expr(row)).alias("e")).where("e IS NOT NULL")
    return df.select("mol_id", "cn", F.col("e.first").alias("first_shape"), F.col("e.second").alias("second_shape"))


GEOM = [f"CAST(cn = {k} AS INTEGER)::DOUBLE" for k in range(1, 10)] + [f"coalesce(round(vs[{k}], 6), 0)" for k in range(1, 5)] + ["n_trans::DOUBLE"] + [f"CAST({w} AS INTEGER)::DOUBLE" for w in ("fac_mer IS NULL", "fac_mer IS NOT DISTINCT FROM 'fac'", "fac_mer IS NOT DISTINCT FROM 'mer'")]
METAL = [f"CAST(r = {k} AS INTEGER)::DOUBLE" for k in (4, 5, 6)] + ["round((g - 3) / 9, 6)", "round(en::DOUBLE / 3, 6)", "(coalesce(oxidation, 2) + 2) / 8", "coalesce(dcount, 6) / 10"]
COLUMNS = ", ".join(f"{x} AS {name}{k}" for name, xs in (("geom", GEOM), ("metal", METAL)) for k, x in enumerate(xs))


@query(f"""WITH RECURSIVE {ENCODED}, {SHAPES}, tt AS (SELECT mol, count(*) AS n_trans, string_agg('trans:L' || least_lig || '-L' || other, ' ' ORDER BY a, b) AS words FROM (
  SELECT mol, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN x <= y THEN la ELSE lb END AS least_lig, CASE WHEN x <= y THEN lb ELSE la END AS other FROM (SELECT *, 'L' || la || ':' || pa AS x, 'L' || lb || ':' || pb AS y FROM tr)) GROUP BY mol),
lw AS (SELECT mol, string_agg('$L' || lig || ' dent=' || dent, ' ' ORDER BY lig) AS words FROM lg GROUP BY mol),
sw AS (SELECT mol, vs, 'GEO=' || labels[list_position(vs, list_min(vs))] || ' ' || array_to_string(list_transform(labels, lambda o, k: o || CASE WHEN vs[k] < 1 THEN '_low' WHEN vs[k] < 5 THEN '_mid' ELSE '_high' END), ' ') AS words FROM sh),
ft2 AS (SELECT dc.*, vs, coalesce(n_trans, 0) AS n_trans, fac_mer, concat_ws(' ', '[' || metal || ']', 'ox=' || oxidation, 'd' || dcount, 'CN=' || dc.cn, sw.words, tt.words, 'fm=' || fac_mer, lw.words) AS tokens
  FROM dc LEFT JOIN sw USING (mol) LEFT JOIN tt USING (mol) LEFT JOIN fm USING (mol) LEFT JOIN lw USING (mol))
SELECT CAST(mol AS VARCHAR) AS mol_id, tokens, {COLUMNS} FROM ft2""")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in a row, and each number of the two vectors in a column."""
    f = feature_plan.features(plan.encode(molecules(spark, sf_dir)))
    numbers = [F.round(F.col(c)[k], 6).alias(f"{name}{k}") for c, name, n in (("geom", "geom", len(GEOM)), ("metal_vector", "metal", len(METAL))) for k in range(n)]
    return f.select("mol_id", F.array_join("tokens", " ").alias("tokens"), *numbers)


@query(f"""WITH RECURSIVE {ENCODED}, {SHAPES}, ck AS (SELECT mol, cn NOT BETWEEN 2 AND 6 AS unshaped, CAST(coalesce(list_min(vs) > 10, false) AS INTEGER) + CAST(cn > 12 AS INTEGER) AS odd FROM dc LEFT JOIN (SELECT mol, vs FROM sh) USING (mol))
SELECT count(*) AS total, count_if(NOT unshaped AND odd = 0)::BIGINT AS valid, 0::BIGINT AS with_errors, count_if(unshaped OR odd > 0)::BIGINT AS with_warnings, count_if(unshaped)::BIGINT AS n_unshaped, sum(odd)::BIGINT AS n_unusual FROM ck""")
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, and how often the two issues are found that these molecules have."""
    out = feature_plan.check_summary(feature_plan.check(plan.encode(molecules(spark, sf_dir))))
    n = lambda code: F.coalesce(F.try_element_at("issues", F.lit(code)), F.lit(0))
    return out.select("total", "valid", "with_errors", "with_warnings", n("SHAPE_COMPUTATION_FAILED").alias("n_unshaped"), n("UNUSUAL_GEOMETRY").alias("n_unusual"))


@query(f"WITH RECURSIVE {ENCODED} SELECT metal, cn, count(*) AS n, CAST(row_number() OVER (PARTITION BY metal ORDER BY count(*) DESC, cn) AS INTEGER) AS rank FROM m WHERE cn > 0 GROUP BY metal, cn")
def metal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_plan.metal_table(plan.canonical_strings(molecules(spark, sf_dir)))


@query(f"""WITH {COMPLEXES}, n AS (SELECT mol, donor, count(*) AS n FROM c GROUP BY mol, donor)
SELECT mol, string_agg(donor || CASE WHEN n = 1 THEN '' ELSE CAST(n AS VARCHAR) END, '' ORDER BY donor) AS formula FROM n GROUP BY mol""")
def formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = complexes(spark, sf_dir).groupBy("mol", "donor").agg(F.count("*").alias("n"))
    part = F.concat("donor", F.when(F.col("n") == 1, "").otherwise(F.col("n").cast("string")))
    return n.groupBy("mol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("donor", part.alias("p")))), lambda s: s.p), "").alias("formula"))


@query(f"""WITH info(element, r, g, en) AS (VALUES {METAL_ROWS}), ox(element, cn, ox) AS (VALUES {OX_ROWS}), k AS (SELECT DISTINCT element FROM ox),
m AS (SELECT o_orderkey AS mol, (SELECT list(element ORDER BY i) FROM (SELECT element, row_number() OVER () AS i FROM info))[o_orderkey % 30 + 1] AS element, CAST(o_orderkey % 9 AS INTEGER) AS cn FROM orders)
SELECT mol, m.element, m.cn, o.oxidation, CASE WHEN o.oxidation IS NOT NULL AND g BETWEEN 3 AND 12 THEN CAST(greatest(0, least(10, g - o.oxidation)) AS INTEGER) END AS dcount
FROM m JOIN info USING (element), LATERAL (SELECT CAST(CASE WHEN m.element IN (SELECT element FROM k) THEN coalesce((SELECT ox FROM ox WHERE ox.element = m.element AND ox.cn = m.cn), 2) END AS INTEGER) AS oxidation) o""")
def metal_state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    metals = F.array(*[F.lit(m) for m in constants.METALS])
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mol"), F.struct(F.element_at(metals, (F.col("o_orderkey") % 30 + 1).cast("int")).alias("element")).alias("metal"), (F.col("o_orderkey") % 9).cast("int").alias("cn"))
    return plan.metal_state(o).select("mol", "metal.element", "cn", "metal_state.oxidation", "metal_state.dcount")


@query("""SELECT o_orderkey AS mol, count(l_orderkey) AS n_lines, count(p_partkey) AS n_parts, coalesce(round(sum(p_retailprice), 2), 0) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
def left_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    j = o.join(li, li.l_orderkey == o.o_orderkey, "left").join(p, p.p_partkey == li.l_partkey, "left")
    return j.groupBy(F.col("o_orderkey").alias("mol")).agg(F.count("l_orderkey").alias("n_lines"), F.count("p_partkey").alias("n_parts"), F.coalesce(F.round(F.sum("p_retailprice"), 2), F.lit(0.0)).alias("total"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS mol, l_partkey % 7 AS a, l_suppkey % 7 AS b FROM lineitem), n AS (SELECT mol, a AS v FROM e UNION SELECT mol, b FROM e),
r AS (SELECT mol, v, v AS u FROM n UNION SELECT r.mol, r.v, CASE WHEN e.a = r.u THEN e.b ELSE e.a END FROM r JOIN e ON e.mol = r.mol AND (e.a = r.u OR e.b = r.u))
SELECT mol, count(DISTINCT lo)::BIGINT AS n_components FROM (SELECT mol, v, min(u) AS lo FROM r GROUP BY mol, v) GROUP BY mol""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each order's small graph, by a fold over its edges within the row."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("mol")).agg(F.collect_set(F.struct((F.col("l_partkey") % 7).cast("int").alias("i"), (F.col("l_suppkey") % 7).cast("int").alias("j"))).alias("edges"))
    join = "transform(part, x -> IF(x = greatest(part[e.i], part[e.j]), least(part[e.i], part[e.j]), x))"
    g = g.withColumn("part", F.expr(f"aggregate(edges, sequence(0, 6), (part, e) -> IF(part[e.i] = part[e.j], part, {join}))"))
    return g.select("mol", F.expr("size(array_distinct(flatten(transform(edges, e -> array(part[e.i], part[e.j])))))").cast("bigint").alias("n_components"))


@query(f"""WITH RECURSIVE {ENCODED}, fr AS (SELECT DISTINCT part.mol FROM part LEFT JOIN n USING (mol, idx) GROUP BY part.mol, part.part HAVING count(n.pos) = 0),
kept AS (SELECT cn, mol % 13 <> 0 AS f5, coalesce(mol % 20, 0) <= 10 AS f6, fr.mol IS NULL AS f4 FROM m LEFT JOIN fr USING (mol)),
counted AS (SELECT count(*) AS n0, count_if(cn BETWEEN 2 AND 14) AS n3, count_if(cn BETWEEN 2 AND 14 AND f4) AS n4, count_if(cn BETWEEN 2 AND 14 AND f4 AND f5) AS n5, count_if(cn BETWEEN 2 AND 14 AND f4 AND f5 AND f6) AS n6 FROM kept),
steps AS (SELECT unnest(range(10)) AS step, unnest([n0, n0, n0, n0, n3, n4, n5, n6, n6, n6]) AS remaining, n0 FROM counted)
SELECT CAST(step AS INTEGER) AS step, CAST(remaining AS BIGINT) AS remaining, round(remaining * 100.0::DOUBLE / n0, 6) AS pct FROM steps""")
def rule_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules F1 to F8 over the molecules; disorder and R factor follow from the order's key."""
    seq = F.col("mol_id").cast("long")
    rows = plan.encode(molecules(spark, sf_dir)).withColumns({"disorder": seq % 13 == 0, "r_factor": (seq % 20).cast("double") / 100})
    return filters.rule_funnel(rows).select("step", "remaining", F.round("pct", 6).alias("pct"))


@query(f"""WITH RECURSIVE {ENCODED}, b AS (SELECT *, CAST(CASE WHEN metal = 'Ir' THEN CASE cn WHEN 4 THEN 1 WHEN 5 THEN 3 WHEN 6 THEN 3 ELSE 2 END ELSE oxidation END AS INTEGER) AS o FROM m)
SELECT CAST(mol AS VARCHAR) AS mol_id, metal, cn, o AS oxidation, CASE WHEN o IS NOT NULL THEN CAST(greatest(0, least(10, g - o)) AS INTEGER) END AS dcount FROM b""")
def builder_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metal states as the graph builder has them."""
    df = plan.metal_state(plan.coordination(molecules(spark, sf_dir), constants.Config()), builder=True)
    return df.select("mol_id", "metal_state.element", "cn", "metal_state.oxidation", "metal_state.dcount").withColumnRenamed("element", "metal")
