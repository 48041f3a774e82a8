"""Files read by splits, against one reading from start to end."""

import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chelate.sources import splits
from chelate.sources.tables import read_bond_orders
from chelate.sources.xyz import read_xyz, size_of


def plain_xyz(text):
    """(seq, id, atoms) from the first line to the last."""
    rows = text.split("\n")
    rows = rows[:-1] if rows[-1] == "" else rows
    out, i = [], 0
    while i < len(rows):
        if not re.fullmatch(r"\s*\+?\d+\s*", rows[i], re.ASCII):
            i += 1
            continue
        n = int(rows[i])
        comment = rows[i + 1] if i + 1 < len(rows) else ""
        found = re.search(r"CSD_code\s*=\s*(\w+)", comment) or re.search(r"CSD-(\w+)", comment)
        atoms = []
        for row in rows[i + 2 : i + 2 + n]:
            try:
                element, x, y, z = row.split()[:4]
                atoms.append((len(atoms), element, float(x), float(y), float(z)))
            except ValueError:
                pass
        if atoms:
            out.append((i, found[1] if found else f"MOL_{i}", atoms))
        i += n + 2
    return out


def random_xyz(rng, molecules):
    """Molecules with counts for comments, blank and broken rows, junk between, and an early end."""
    rows = []
    for k in range(molecules):
        rows += rng.choice([[], [], [""], ["junk 5"], ["  "]])
        n = rng.randint(0, 9)
        rows += [f" {n} ", rng.choice([f"CSD_code = M{k} | x", f"CSD-M{k}", "4", "12", "", "CSD_code ="])]
        rows += [rng.choice([f"{e} {k}.5 -1e-1 {j}", f"{e} {k}.5 -1e-1 {j}", "bad row", "3", "N 1 2", "C x y z", "Fe 1 2 3 4 5"]) for j, e in enumerate(rng.choices(["Fe", "N", "Cl"], k=n))]
    rows += [str(rng.randint(5, 40)), "cut short", "Fe 0 0 0"] if rng.random() < 0.7 else []
    return "\n".join(rows) + rng.choice(["", "\n"])


@pytest.fixture
def split_bytes(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(max(1, n)))
    spark.conf.set(key, before)


def found_xyz(spark, path):
    return sorted((r.seq, r.mol_id, [tuple(a) for a in r.atoms]) for r in read_xyz(spark, path).collect())


@pytest.mark.parametrize("seed", range(4))
def test_xyz_by_splits(spark, split_bytes, tmp_path, seed):
    """One file in 1, 3 and 50 splits; borders fall inside counts, comments and atoms."""
    text = random_xyz(random.Random(seed), 60)
    (tmp_path / "a.xyz").write_text(text)
    want = plain_xyz(text)
    assert len(want) > 20
    for parts in (1, 3, 50):
        split_bytes(len(text) // parts + 1)
        path = str(tmp_path / "a.xyz")
        assert splits.lines(spark, path).select("block").distinct().count() == parts
        assert found_xyz(spark, path) == want


def test_every_border(spark, split_bytes, tmp_path):
    """Splits of every size from one byte up."""
    text = "2\n3\nFe 0 0 0\nN 0 0 2\n\n1\nCSD_code = B\nNi 1 1 1\n3\nCSD-C\nCo 0 0 0\nbad\n2\n"
    (tmp_path / "a.xyz").write_text(text)
    want = plain_xyz(text)
    assert [x[1] for x in want] == ["MOL_0", "B", "C"]
    for size in (1, 2, 3, 5, 7, 11, 13, 20, 31, 60, 200):
        split_bytes(size)
        assert found_xyz(spark, str(tmp_path / "a.xyz")) == want


def test_compressed_and_several_files(spark, split_bytes, tmp_path):
    rng, want = random.Random(9), []
    for name in ("b.xyz", "a.xyz", "c.xyz.gz"):
        text = random_xyz(rng, 20)
        data = text.encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
        want += [(name, *row) for row in plain_xyz(text)]
    split_bytes(150)
    got = [(r.path.rsplit("/", 1)[1], r.seq, r.mol_id, [tuple(a) for a in r.atoms]) for r in read_xyz(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    blocks = splits.lines(spark, str(tmp_path)).groupBy("path").agg(F.count_distinct("block").alias("n")).collect()
    assert all(r.n == 1 for r in blocks if r.path.endswith("gz")) and all(r.n > 1 for r in blocks if not r.path.endswith("gz"))


def test_one_molecule_over_many_splits(spark, split_bytes, tmp_path):
    text = "400\nCSD_code = BIG\n" + "".join(f"C {i} 0 {i / 8}\n" for i in range(400)) + "1\nCSD_code = END\nFe 0 0 0\n"
    (tmp_path / "a.xyz").write_text(text)
    split_bytes(64)
    assert found_xyz(spark, str(tmp_path / "a.xyz")) == plain_xyz(text)


@pytest.mark.parametrize("text", ["", "\n", "no count\n", "5\n", "0\nx\n", "7"])
def test_files_without_molecules(spark, tmp_path, text):
    (tmp_path / "a.xyz").write_text(text)
    assert found_xyz(spark, str(tmp_path)) == plain_xyz(text) == []


def test_effect_equals_walk():
    """The compressed effect of a split against a walk from every state that may enter it."""
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 30)
        at = np.array(sorted(rng.sample(range(n), rng.randint(0, n))), np.int64)
        size = np.array([rng.randint(2, 12) for _ in at], np.int64)
        uppers, exits, heads = splits.effect(n, at, size)
        of = dict(zip(at.tolist(), size.tolist(), strict=True))
        for entry in range(n):
            line, head = entry, None
            while line < n:
                head = line if line in of else head
                line += of.get(line, 1)
            i = next((k for k, u in enumerate(uppers) if entry <= u), None)
            left = line - n
            assert (exits[i] if i is not None else 0) == left
            if left:
                assert heads[i] == head


def test_counts_alike_in_both_languages(spark):
    """What SQL and Python take for a count line is the same."""
    from chelate.sources.xyz import SIZE

    texts = ["5", " 5 ", "+5", "-5", "5.0", "", " ", "\t7\t", "05", "99999999999", "2147483648", "2147483647", "५", "5\x0b", "5 6", "1_0", "\x0c3", "5 ", "5 ", "0"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string").select("i", F.expr(SIZE).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: size_of(t) for i, t in enumerate(texts)}


def plain_bonds(text):
    """Bond orders by id as a plain reading gives them: the last section of an id that has rows, the last order of a pair."""
    out, name, rows = {}, None, []

    def close():
        if name and rows:
            pairs = {}
            for i, triples in rows:
                for j, x in triples:
                    if i >= 0 and j >= 0:
                        pairs[min(i, j), max(i, j)] = x
            out[name] = {k: np.float32(v) for k, v in pairs.items()}

    for line in text.split("\n"):
        line = line.strip()
        if line.startswith("CSD_code"):
            close()
            found, rows = re.search(r"CSD_code\s*=\s*(\w+)", line), []
            name = found[1] if found else None
            continue
        p = line.split()
        try:
            i, _ = int(p[0]) - 1, float(p[2])
        except (ValueError, IndexError):
            continue
        triples = []
        for k in range(3, len(p) - 2, 3):
            try:
                triples.append((int(p[k + 1]) - 1, float(p[k + 2])))
            except ValueError:
                pass
        rows.append((i, triples))
    close()
    return out


def test_bond_orders_by_splits(spark, split_bytes, tmp_path):
    rng, rows = random.Random(4), ["1 Fe 1.0 N 2 0.9"]
    for k in range(40):
        rows.append(rng.choice([f"CSD_code = M{k % 25} | y", f"  CSD_code=M{k % 25}", "CSD_code"]))
        for i in range(rng.randint(0, 5)):
            rows.append(rng.choice([f"{i + 1} Fe 2.0 N {i + 2} 0.{k + 10} Cl {i + 3} 0.5", f"{i + 1} N 1.0", "x y z", "", f"  {i + 2}  C  1.5   Fe {i + 1} 0.75 O x 1 P 9 y"]))
    text = "\n".join(rows) + "\n"
    (tmp_path / "a.BO").write_text(text)
    want = plain_bonds(text)
    for parts in (1, 3, 50):
        split_bytes(len(text) // parts + 1)
        got = {r.mol_id: {(b.i, b.j): np.float32(b.bo) for b in r.bonds} for r in read_bond_orders(spark, str(tmp_path / "a.BO")).collect()}
        assert got == want
