"""Molecules to canonical strings: one narrow stage without a shuffle. SQL expressions, but for shapes, SMILES and the least names, which run on Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chelate.constants import ATOMIC_NUMBER, BUILDER_OXIDATION, DONORS, LIGAND_NUMBER, METALS, OXIDATION, Config
from chelate.functions.geometry import angle_class, distance, leg_angle, rounded, shape_labels
from chelate.functions.names import least_trans
from chelate.functions.shapes import shape_values
from chelate.functions.smiles import canonical_smiles


def number(element: str, table: dict[str, int] = ATOMIC_NUMBER) -> str:
    pairs = ", ".join(f"'{e}', {z}" for e, z in table.items())
    return f"coalesce(element_at(map({pairs}), {element}), 0)"


def one_of(names) -> str:
    return f"array({', '.join(repr(n) for n in names)})"


def bond(a: str, b: str) -> str:
    """The bond order between two atoms; of repeated bonds the last holds, 0 without one."""
    return f"coalesce(double(try_element_at(filter(bonds, e -> (e.i = {a} AND e.j = {b}) OR (e.i = {b} AND e.j = {a})), -1).bo), 0D)"


def coordination(df: DataFrame, c: Config) -> DataFrame:
    """metal (the first transition metal), n_metals and neighbors (ranked donors with distance, bond order and score)."""
    df = df.withColumn("metals", F.expr(f"filter(atoms, a -> array_contains({one_of(METALS)}, a.element))"))
    df = df.withColumns({"metal": F.expr("get(metals, 0)"), "n_metals": F.expr("size(metals)")}).drop("metals")
    near = f"transform(filter(atoms, a -> a.idx <> metal.idx AND array_contains({one_of(DONORS)}, a.element)), a -> named_struct('idx', a.idx, 'element', a.element, 'distance', {distance('a', 'metal')}, 'bond_order', {bond('metal.idx', 'a.idx')}))"
    kept = f"filter({near}, n -> n.bond_order > {c.bond_order}D OR n.distance < {c.distance}D)"
    keyed = f"transform({kept}, n -> named_struct('k1', -(2 * n.bond_order + 1 / greatest(n.distance, 0.5D)), 'k2', n.distance, 'k3', -{number('n.element')}, 'k4', n.idx, 'n', n))"
    ranked = f"transform(array_sort({keyed}), s -> named_struct('idx', s.n.idx, 'element', s.n.element, 'distance', s.n.distance, 'bond_order', s.n.bond_order, 'score', -s.k1))"
    df = df.withColumn("neighbors", F.expr(f"CASE WHEN metal IS NOT NULL THEN {ranked} END"))
    return df.withColumn("cn", F.expr("CASE WHEN metal IS NULL THEN 0 ELSE size(neighbors) END"))


def ligands(df: DataFrame, c: Config) -> DataFrame:
    """ligands: the parts of the molecule without its metal that donate, in the order of their first atoms."""
    close = f"flatten(transform(atoms, a -> transform(filter(atoms, b -> b.idx > a.idx AND {distance('a', 'b')} < {c.edge_distance}D), b -> named_struct('i', a.idx, 'j', b.idx))))"
    edges = f"CASE WHEN bonds IS NULL THEN {close} ELSE transform(filter(bonds, e -> e.bo > {c.edge_order}), e -> named_struct('i', e.i, 'j', e.j)) END"
    df = df.withColumn("edges", F.expr(f"filter({edges}, e -> e.i <> metal.idx AND e.j <> metal.idx)"))
    # each edge merges two labels; a part's label ends as its smallest atom
    join = "transform(part, x -> IF(x = greatest(part[e.i], part[e.j]), least(part[e.i], part[e.j]), x))"
    df = df.withColumn("part", F.expr(f"aggregate(edges, transform(atoms, (a, i) -> i), (part, e) -> IF(part[e.i] = part[e.j], part, {join}))"))
    # a part's donors and atoms are bound once, as the one element of an array
    donors, members = "x.donors", "x.members"
    bound = "named_struct('donors', filter(neighbors, n -> part[n.idx] = p), 'members', filter(atoms, a -> part[a.idx] = p AND a.idx <> metal.idx))"
    kinds = f"array_sort(array_distinct(transform({members}, a -> a.element)))"
    formula = f"array_join(transform({kinds}, k -> concat(k, IF(size(filter({members}, a -> a.element = k)) = 1, '', string(size(filter({members}, a -> a.element = k)))))), '')"
    linked = f"size(array_distinct(filter(transform(edges, e -> named_struct('a', least(e.i, e.j), 'b', greatest(e.i, e.j))), e -> array_contains(transform({donors}, n -> n.idx), e.a) AND array_contains(transform({donors}, n -> n.idx), e.b))))"
    eta = f"CASE WHEN size({donors}) > 1 AND forall({donors}, n -> n.element = 'C') AND {linked} = size({donors}) * (size({donors}) - 1) / 2 THEN size({donors}) END"
    df = df.withColumn("parts", F.expr("array_sort(array_distinct(transform(neighbors, n -> part[n.idx])))"))
    key = formula
    if c.ligand_key == "smiles":
        bonded = "CASE WHEN bonds IS NOT NULL THEN {} END"
        inputs = ("transform(atoms, a -> a.element)", f"filter(bonds, e -> e.bo > {c.edge_order})", "transform(part, (p, i) -> IF(i = metal.idx, -1, p))", "parts")
        df = df.withColumn("names", canonical_smiles(*[F.expr(bonded.format(x)) for x in inputs]))
        key = f"coalesce(get(names, k), {formula})"
    lig = f"named_struct('lig_id', concat('L', k + 1), 'smiles', {key}, 'attach_atoms', transform({donors}, n -> n.idx), 'donor_elements', transform({donors}, n -> n.element), 'dent', size({donors}), 'eta', {eta}, 'charge', cast(NULL AS int), 'mw', 0D, 'atoms', transform({members}, a -> a.idx))"
    return df.withColumn("ligands", F.expr(f"transform(parts, (p, k) -> transform(array({bound}), x -> {lig})[0])")).drop("parts", "names")


def shape(df: DataFrame, c: Config) -> DataFrame:
    """shape: measures against the reference polyhedra of the coordination number, by Arrow batches."""
    df = df.withColumn("points", F.expr("transform(neighbors, n -> atoms[n.idx])"))
    df = df.withColumn("shape_values", shape_values(F.col("points"), F.col("metal"), c.assignment))
    df = df.withColumn("shape", F.expr(f"named_struct('cn', cn, 'ref_shapes', {shape_labels('cn')}, 'values', shape_values, 'values_rounded', transform(shape_values, v -> {rounded('v', c.decimals)}))"))
    return df.drop("points", "shape_values")


def constraints(df: DataFrame, c: Config) -> DataFrame:
    """sites (aligned with neighbors), trans, cis and fac_mer."""
    around = f"aggregate(array_sort(transform(filter(bonds, e -> e.bo > 0.1 AND (e.i = n.idx OR e.j = n.idx) AND e.i <> metal.idx AND e.j <> metal.idx), e -> {number('atoms[IF(e.i = n.idx, e.j, e.i)].element')})), 0L, (h, z) -> (h * 100 + z) % 1000000)"
    key = f"bigint(rint(n.distance * 10000)) * 1000000000000 + {number('n.element')} * 1000000000L + bigint(rint(n.bond_order * 1000)) * 1000000 + coalesce({around}, 0L)"
    df = df.withColumn("ranks", F.expr(f"transform(neighbors, (n, i) -> named_struct('key', {key}, 'i', i, 'element', n.element, 'lig', get(filter(ligands, l -> array_contains(l.attach_atoms, n.idx)), 0).lig_id))"))
    df = df.withColumn("sites", F.expr("transform(ranks, r -> named_struct('lig', r.lig, 'element', r.element, 'rank', 1 + size(filter(ranks, o -> o.lig = r.lig AND o.element = r.element AND (o.key < r.key OR (o.key = r.key AND o.i < r.i))))))")).drop("ranks")
    # each site with its name and its leg from the metal: a pair takes both as they are
    text = site("s")
    leg = "transform(array(atoms[neighbors[i].idx]), a -> named_struct('x', a.x - metal.x, 'y', a.y - metal.y, 'z', a.z - metal.z, 'd', " + distance("a", "metal") + "))[0]"
    df = df.withColumn("legs", F.expr(f"filter(transform(sites, (s, i) -> named_struct('s', named_struct('text', {text}, 'lig', s.lig, 'element', s.element, 'rank', s.rank), 'v', {leg})), l -> l.s.lig IS NOT NULL)"))
    pair = f"transform(array({leg_angle('p.v', 'q.v')}), t -> named_struct('a', p.s, 'b', q.s, 'class', {angle_class('t', c.trans_angle, c.cis_angles)}))[0]"
    df = df.withColumn("pairs", F.expr(f"CASE WHEN cn > 1 THEN flatten(transform(legs, (p, i) -> transform(slice(legs, i + 2, size(legs)), q -> {pair}))) ELSE array() END")).drop("legs")
    within = lambda kind: f"size(filter(pairs, p -> p.class = '{kind}' AND p.a.lig = l.lig_id AND p.b.lig = l.lig_id))"
    verdict = f"filter(transform(filter(ligands, l -> l.dent = 3), l -> CASE WHEN {within('trans')} > 0 THEN 'mer' WHEN {within('cis')} = 3 THEN 'fac' END), v -> v IS NOT NULL)"
    df = df.withColumn("fac_mer", F.expr(f"get({verdict}, 0)"))
    sided = "IF(p.a.text <= p.b.text, named_struct('a', p.a, 'b', p.b), named_struct('a', p.b, 'b', p.a))"
    return df.withColumns({k: F.expr(f"array_sort(transform(filter(pairs, p -> p.class = '{k}'), p -> {sided}))") for k in ("trans", "cis")}).drop("pairs")


def site(s: str) -> str:
    return f"concat({s}.lig, ':', {s}.element, ':', {s}.rank)"


def sorted_pairs(pairs: str, name: str = "{}.lig") -> str:
    """Pairs as (smaller, larger) site by text, in order; ``name`` maps a site's ligand."""
    plain = lambda s: f"concat({name.format(s)}, ':', {s}.element, ':', {s}.rank)"
    keep = lambda s: f"named_struct('text', {plain(s)}, 'lig', {name.format(s)}, 'element', {s}.element, 'rank', {s}.rank)"
    return f"array_sort(transform({pairs}, p -> IF({plain('p.a')} <= {plain('p.b')}, named_struct('a', {keep('p.a')}, 'b', {keep('p.b')}), named_struct('a', {keep('p.b')}, 'b', {keep('p.a')}))))"


def metal_state(df: DataFrame, builder: bool = False) -> DataFrame:
    """metal_state: element, estimated oxidation, d count and (row, group, electronegativity).

    builder: as the graph builder has it, with its further oxidation states and a d count for metals of any group.
    """
    known = BUILDER_OXIDATION if builder else OXIDATION
    ox = " ".join(f"WHEN '{m}' THEN CASE cn {' '.join(f'WHEN {n} THEN {v}' for n, v in by.items())} ELSE 2 END" for m, by in known.items())
    info = " ".join(f"WHEN '{m}' THEN array({r}D, {g}D, {e}D)" for m, (r, g, e) in METALS.items())
    df = df.withColumns({"ox": F.expr(f"CASE metal.element {ox} END"), "phys": F.expr(f"CASE metal.element {info} ELSE array(0D, 0D, 0D) END")})
    grouped = "phys[1] > 0" if builder else "phys[1] BETWEEN 3 AND 12"
    d = f"CASE WHEN ox IS NOT NULL AND {grouped} THEN int(greatest(0, least(10, phys[1] - ox))) END"
    return df.withColumn("metal_state", F.expr(f"named_struct('element', metal.element, 'oxidation', ox, 'spin', cast(NULL AS string), 'dcount', {d}, 'phys_vec', phys)")).drop("ox", "phys")


def encode(molecules: DataFrame, config: Config = Config()) -> DataFrame:
    """Each molecule's complex; a molecule without metal or donors gets the placeholder metal ? and an issue.

    Atoms stand at their index. Bonds to atoms that the molecule lacks fail the molecule alone.
    """
    df = molecules.withColumn("bad_bonds", F.expr("exists(bonds, e -> e.i NOT BETWEEN 0 AND size(atoms) - 1 OR e.j NOT BETWEEN 0 AND size(atoms) - 1)"))
    df = df.withColumn("bonds", F.expr("CASE WHEN NOT bad_bonds THEN bonds END"))
    df = constraints(shape(ligands(coordination(df, config), config), config), config)
    df = metal_state(df)
    failure = F.when(F.col("bad_bonds"), "bond orders name atoms that are not there").when(F.col("metal").isNull(), "No transition metal found").when(F.col("cn") == 0, "No donors found (H excluded)")
    issue = lambda code, message, severity: F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity"))
    places = F.expr(f"concat('Multiple metals found: [', array_join(transform(filter(atoms, a -> array_contains({one_of(METALS)}, a.element)), a -> string(a.idx)), ', '), ']. Using first.')")
    several = F.when((F.col("n_metals") > 1) & F.lit(not config.allow_multimetal), F.array(issue("MULTI_METAL", places, "warning")))
    df = df.withColumn("failure", failure).withColumn("issues", F.when(F.col("failure").isNotNull(), F.array(issue("ENCODING_FAILED", F.col("failure"), "error"))).otherwise(F.coalesce(several, F.expr("cast(array() AS array<struct<code:string,message:string,severity:string>>)"))))
    return df.drop("edges", "part", "bad_bonds", "n_metals")


def canonicalize(encoded: DataFrame) -> DataFrame:
    """Ligands in canonical order with new ids, constraints rewritten, and the least string over relabelled equal ligands."""
    z = f"reverse(array_sort(transform(l.donor_elements, e -> {number('e', LIGAND_NUMBER)})))"
    keyed = f"transform(ligands, (l, i) -> named_struct('k1', -l.dent, 'k2', {z}, 'k3', -coalesce(l.eta, 0), 'k4', -abs(coalesce(l.charge, 0)), 'k5', -l.mw, 'k6', l.smiles, 'k7', i, 'l', l))"
    df = encoded.withColumn("ordered", F.expr(f"array_sort({keyed})"))
    df = df.withColumn("names", F.expr("map_from_arrays(transform(ordered, s -> s.l.lig_id), transform(ordered, (s, i) -> concat('L', i + 1)))"))
    fields = ("smiles", "attach_atoms", "donor_elements", "dent", "eta", "charge", "mw", "atoms")
    df = df.withColumn("ligands", F.expr("transform(ordered, (s, i) -> named_struct('lig_id', concat('L', i + 1), " + ", ".join(f"'{f}', s.l.{f}" for f in fields) + "))"))
    df = df.withColumns({k: F.expr(sorted_pairs(k, "element_at(names, {}.lig)")) for k in ("trans", "cis")}).drop("ordered", "names").withColumn("least", least_trans(F.expr(many_names())))
    return df.withColumns({"head": F.expr(f"concat({metal_block()}, {shape_block()})"), "fm": F.expr("CASE WHEN fac_mer IS NOT NULL THEN concat('{fm:', fac_mer, '}') ELSE '' END")}).withColumn("canonical", F.expr(least_string())).drop("head", "fm", "least")


def metal_block() -> str:
    ox = "CASE WHEN metal_state.oxidation >= 0 THEN concat('ox:+', metal_state.oxidation) WHEN metal_state.oxidation < 0 THEN concat('ox:', metal_state.oxidation) END"
    known = "failure IS NULL"
    return f"concat('[', concat_ws('|', concat('Metal:', IF({known}, metal.element, '?')), IF({known}, {ox}, NULL), IF({known}, concat('d:d', metal_state.dcount), NULL), concat('CN:', IF({known}, cn, 0))), ']')"


def shape_block() -> str:
    v = "shape.values_rounded"
    low = f"array_min({v})"
    delta = f"IF(size({v}) > 1, array_sort({v})[1] - array_sort({v})[0], 0D)"
    bucket = f"CASE WHEN {delta} < 0.5 THEN 0 WHEN {delta} < 2 THEN 1 WHEN {delta} < 5 THEN 2 ELSE 3 END"
    grade = f"CASE WHEN {low} < 1 THEN 'ideal' WHEN {low} < 3 THEN 'good' WHEN {low} < 8 THEN 'dist' ELSE 'irreg' END"
    text = f"concat('<ShapeBest:', shape.ref_shapes[int(array_position({v}, {low})) - 1], '|Class:', {grade}, '|Delta:', {bucket}, '|V:', array_join(transform({v}, x -> IF(x = double('Infinity'), 'inf', format_string('%.2f', x))), ','), '>')"
    return f"CASE WHEN failure IS NULL AND size({v}) > 0 THEN {text} ELSE '' END"


def pair_texts(pairs: str) -> str:
    return f"transform({pairs}, p -> concat(p.a.text, '--', p.b.text))"


def trans_block(texts: str) -> str:
    return f"array_join(transform({texts}, t -> concat('{{trans:', t, '}}')), '')"


def ligand_block(items: str) -> str:
    return f"IF(size({items}) > 0, concat('|', array_join(transform({items}, l -> concat(l.lig_id, '=', l.smiles)), '|'), '|'), '||')"


def many_names() -> str:
    """What the least names of equal ligands hang on; null where they change nothing. No lambda stands in another: Spark has no plan for such inputs."""
    alike = "failure IS NULL AND size(array_distinct(transform(ligands, l -> l.smiles))) < size(ligands) AND (size(trans) > 0 OR size(ligands) > 9)"
    pairs = "flatten(transform(trans, p -> array(p.a.lig, concat(p.a.element, ':', p.a.rank), p.b.lig, concat(p.b.element, ':', p.b.rank))))"
    return f"CASE WHEN {alike} THEN named_struct('smiles', transform(ligands, l -> l.smiles), 'pairs', {pairs}) END"


def least_string() -> str:
    """The base string, or a smaller one by permuting the ids of one group of equal ligands: of all of them.

    Equal ligands trade ids without changing their block, but that ids of two digits stand in the order of
    texts once any are traded, which is the smaller block.
    """
    by_id = "array_sort(transform(ligands, l -> named_struct('lig_id', l.lig_id, 'smiles', l.smiles)))"
    ligs = f"IF(size(ligands) > 9 AND least.again, {ligand_block(by_id)}, {ligand_block('ligands')})"
    return f"CASE WHEN failure IS NOT NULL THEN concat(head, '||') ELSE concat(head, {trans_block('coalesce(least.pairs, ' + pair_texts('trans') + ')')}, fm, {ligs}) END"


def canonical_strings(molecules: DataFrame, config: Config = Config()) -> DataFrame:
    """source_id, metal, cn, canonical, valid: the converted records."""
    df = canonicalize(encode(molecules, config))
    ok = F.col("failure").isNull()
    return df.select(F.col("mol_id").alias("source_id"), F.when(ok, F.col("metal.element")).otherwise("?").alias("metal"), F.when(ok, F.col("cn")).otherwise(0).alias("cn"), "canonical", ok.alias("valid"))
