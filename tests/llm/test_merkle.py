"""Merkle manifest against a tree built plainly, level by level."""

import hashlib

import pytest
from odd import empty, odd_docs
from pyspark.sql import functions as F

from chelate.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS])


def plain_tree(nodes, width):
    """The root and each node's siblings, level by level."""
    proofs, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + width, len(nodes))) for a in range(0, len(nodes), width)]
        for run in runs:
            for i in run:
                for x in spans[i]:
                    proofs[x] += [nodes[j] for j in run if j != i]
        spans = [[x for i in run for x in spans[i]] for run in runs]
        nodes = [digest(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], proofs


def plain_manifest(rows, width):
    """(doc_id, source, leaf, subroot, root, siblings) of each row."""
    of = {}
    for r in rows:
        of.setdefault(r.source, []).append(((r.doc_id is not None, r.doc_id or 0, leaf(r)), r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([k[2] for k, _ in sorted(of[s], key=lambda x: x[0])], width) for s in names}
    root, over = plain_tree([trees[s][0] for s in names], width)
    return sorted(
        (str(r.doc_id), str(s), k[2], trees[s][0], root, "".join(proof + over[i]))
        for i, s in enumerate(names)
        for (k, r), proof in zip(sorted(of[s], key=lambda x: x[0]), trees[s][1], strict=True)
    )


def found(df):
    return sorted((str(r.doc_id), str(r.source), r.leaf, r.subroot, r.root, "".join(s.others for s in r.path)) for r in df.collect())


def table(spark, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append(((i * 7919) % 100_003, source, None if i % 3 else "en", None if i % 4 else i, None if i % 5 == 0 else f"Text {i} ü"))
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 27, 28, 82])
@pytest.mark.parametrize("height", [1, 2, 3])
def test_traversal_equals_levels(n, height):
    nodes = [digest(str(i)) for i in range(n)]
    root, proofs = plain_tree(nodes, 3)
    if merkle.levels(n, 3) <= height:
        paths = [[] for _ in nodes]
        assert merkle.traverse([x.encode() for x in nodes], merkle.levels(n, 3), 3, paths).decode() == root
        assert ["".join(s["others"] for s in p) for p in paths] == ["".join(p) for p in proofs]


@pytest.mark.parametrize(
    "sizes,width,height",
    [
        ({"a": 1}, 16, 2),
        ({"a": 1, None: 1, "b": 1}, 16, 2),
        ({"one": 1, None: 16, "b": 17, "é": 256, "Z": 257}, 16, 2),
        ({"x": 83, "y": 9, "z": 10}, 3, 1),
        ({f"s{i}": 1 + i % 5 for i in range(30)}, 3, 2),
        ({"hot": 700, **{f"s{i}": 2 for i in range(20)}}, 4, 2),
    ],
)
def test_equals_plain_tree(spark, sizes, width, height):
    docs = table(spark, sizes)
    out = merkle.manifest(docs, width, height)
    assert found(out) == plain_manifest(docs.collect(), width)
    folded = out.select((merkle.fold("leaf") == F.col("root")).alias("ok"), merkle.fold("upper(leaf)").alias("other"), "root").collect()
    assert all(r.ok for r in folded) and all(r.other != r.root for r in folded if sum(sizes.values()) > 1)


def test_any_change_is_noticed(spark):
    docs = table(spark, {"a": 40, "b": 3})
    changed = docs.withColumn("new", merkle.leaf_of(F.col("doc_id"), F.lit("b"), F.col("lang"), F.col("n_chars"), F.col("text")))
    rows = merkle.manifest(changed, 4, 2, keep=["new"]).select("source", (merkle.fold("new") == F.col("root")).alias("ok")).collect()
    assert all(r.ok == (r.source == "b") for r in rows)
    with pytest.raises(ValueError):
        merkle.manifest(docs.withColumn("pos", F.lit(1)), keep=["pos"])


def test_lengths_tell_fields_apart(spark):
    """Neither moving a character to the next field nor a null for an empty text keeps the digest."""
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("abc", ""), ("abc", None), ("-", None), (None, "-")], "x string, y string")
    got = [r[0] for r in rows.select(merkle.leaf_of(F.col("x"), F.col("y"))).collect()]
    assert len(set(got)) == len(got)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert found(merkle.manifest(docs, 3, 1)) == plain_manifest(docs.collect(), 3)
    assert merkle.manifest(empty(spark)).count() == 0
    same = spark.createDataFrame([(None, None, None, None, None, 1)] * 40, "doc_id long, source string, lang string, n_chars long, text string, pos int")
    out = merkle.manifest(same, 4, 1)
    assert found(out) == plain_manifest(same.collect(), 4) and sorted(r.position for r in out.collect()) == list(range(40))
