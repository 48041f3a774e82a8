"""The least names of equal ligands against all permutations of whole groups, by themselves, in strings and in the query."""

import random
from itertools import permutations, product

import duckdb

from chelate import queries, schema
from chelate.functions.names import least_names
from chelate.plans.encode import canonicalize, encode
from conftest import same_rows


def named(pairs, to):
    texts = [sorted((f"{to.get(u, u)}:{p}", f"{to.get(v, v)}:{q}")) for u, p, v, q in pairs]
    return "".join(f"{{trans:{a}--{b}}}" for a, b in sorted(texts))


def groups_of(smiles):
    groups = {}
    for k, s in enumerate(smiles, 1):
        groups.setdefault(s, []).append(f"L{k}")
    return list(groups.values())


def plain(smiles, pairs):
    """The least text over all permutations of each group, and whether one that moves an id gives it."""
    ways = [(named(pairs, dict(zip(g, w, strict=True))), list(w) != g) for g in groups_of(smiles) for w in permutations(g)]
    text = min(t for t, _ in ways)
    return text, any(moves for t, moves in ways if t == text)


def test_least_names_equal_all_permutations():
    """Groups of seven too, ids of two digits, ranks that begin alike, several pairs at a place."""
    rng, seen = random.Random(11), []
    for k in range(400):
        kinds = [["N"] * rng.randint(1, 5) + ["O"] * rng.randint(0, 3), ["N"] * 7 + ["O"] * (k // 20 % 2), ["N"] * 5 + ["O"] * 4 + ["C"] * 3]
        smiles = kinds[0 if k % 20 else 1] if k % 4 else kinds[2 if k % 20 else 1]
        rng.shuffle(smiles)
        sites = [(f"L{i}", p) for i in range(1, len(smiles) + 1) for p in rng.sample(["N:1", "N:2", "N:10", "Cl:1"], rng.choice([1, 1, 2]))]
        if k % 3 == 0:
            sites = [(f"L{i}", "N:1") for i in range(1, len(smiles) + 1)]
        every = [(a, b) for i, a in enumerate(sites) for b in sites[i + 1 :]]
        pairs = [(*a, *b) for a, b in rng.sample(every, rng.randint(0, min(len(every), 9)))]
        ordered = sorted((sorted([(f"{u}:{p}", u, p), (f"{v}:{q}", v, q)]) for u, p, v, q in pairs), key=lambda x: (x[0][0], x[1][0]))
        texts, again = least_names(tuple(smiles), tuple((a[1], a[2], b[1], b[2]) for a, b in ordered))
        assert ("".join(f"{{trans:{t}}}" for t in texts), again) == plain(smiles, pairs)
        seen.append((max(map(len, groups_of(smiles))), again))
    assert (7, True) in seen and any(not again for _, again in seen)


def test_large_groups_have_one_string(spark):
    """Six lines of two donors across from each other, and stars about one: whatever the order, one string each."""
    rng, rows = random.Random(2), []
    axes = [(0, 1, 1.618), (0, 1, -1.618), (1, 1.618, 0), (1, -1.618, 0), (1.618, 0, 1), (-1.618, 0, 1)]
    shells = {"lines": [tuple(s * x for x in a) for a in axes for s in (1, -1)], "star": [(0, 0, 2.0), *[(0.02 * i, 0, -1.5 - 0.02 * i) for i in range(11)]]}
    for kind, points in shells.items():
        for k in range(12):
            rng.shuffle(points)
            atoms = [(0, "Fe", 0.0, 0.0, 0.0), *[(i, "N", *map(float, p)) for i, p in enumerate(points, 1)]]
            rows.append((f"{kind} {k}", k, atoms, [(0, i, 1.0) for i in range(1, 13)], None))
    found = canonicalize(encode(spark.createDataFrame(rows, schema.MOLECULE))).select("mol_id", "canonical").collect()
    for kind, pairs in (("lines", 6), ("star", 11)):
        strings = {r.canonical for r in found if r.mol_id.startswith(kind)}
        assert len(strings) == 1 and strings.pop().count("{trans:") == pairs


def test_query_names_whole_groups(spark, tmp_path):
    """Orders of eight lines at a cube's corners, eight or seven of them equal: the same string in any order, as in the SQL."""
    rng, rows = random.Random(6), []
    for order in range(1, 13):
        corners = list(product((0, 34), (0, 7), (0, 7)))
        rng.shuffle(corners)
        odd = (0, 0, 0) if order > 6 else None
        for line, (x, y, z) in enumerate(corners, 1):
            rows.append((25 * order, line, line, 1, float(x), 1.0, y / 100, z / 100, "N" if (x, y, z) == odd else "A"))
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = queries.queries()["canonical_string"](spark, str(tmp_path))
    found = [(int(r.source_id) // 25 > 6, r.canonical[r.canonical.index("{") :]) for r in df.collect()]
    whole = "".join(f"{{trans:L{i}:N:1--L{i + 1}:N:1}}" for i in (1, 3, 5, 7)) + "".join(f"|L{i}=N" for i in range(1, 9)) + "|"
    assert {s for odd, s in found if not odd} == {whole} and len({s for odd, s in found if odd}) == 1 and len(found) == 12
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    same_rows(df, duck, queries.oracle_sql()["canonical_string"])
