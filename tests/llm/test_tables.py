"""Sharding, fair mixing, exact dedup and the n-gram Jaccard join against SQL and brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd import LONG, empty, odd_docs
from pyspark.sql import functions as F

from chelate.llm import exact_dedup, jaccard_join, mixing, registry, sharding
from chelate.llm.common import components, positions
from conftest import DATA, same_rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    same_rows(registry.queries()[name](spark, DATA), duck, SQL[name])


def test_lookup_is_even_and_stable():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup(shards, 101)
    counts = Counter(table)
    assert len(counts) == 7 and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup(shards[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 30
    for bad in ((["a", "a"], 101), (["a"], 100), ([], 101)):
        with pytest.raises(ValueError):
            sharding.lookup(*bad)


def test_lookup_by_preference():
    """Each turn, a shard claims the first free slot of its own permutation."""
    shards, size = ["a", "b", "c"], 13
    lists = []
    for s in shards:
        offset, skip = sharding.number(f"offset:{s}") % size, sharding.number(f"skip:{s}") % (size - 1) + 1
        lists.append([(offset + j * skip) % size for j in range(size)])
    want = [-1] * size
    for turn in range(size):
        who = turn % 3
        want[next(x for x in lists[who] if want[x] < 0)] = who
    assert sharding.lookup(shards, size) == want


def test_sharding_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == docs.count()
    assert all(len({r.shard for r in rows if r.doc_id == i}) == 1 for i in {r.doc_id for r in rows})
    assert sharding.assign_shards(empty(spark)).count() == 0
    more = docs.withColumns({"_slot": F.lit(1), "slot": F.lit(2), "shard": F.lit("s")})
    sharding.write_shards(more, str(tmp_path / "out"), shards=["x", "y"], size=11, salt=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(back.columns) == {*more.columns, "shard_"}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_odd_rows(spark):
    docs = odd_docs(spark)
    rows = mixing.fair_mix(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(r["size"] for r in rows) == sorted(len(words(r.text)) for r in docs.collect())
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sum(r.taken for r in rows) <= sum(r["size"] for r in rows)
    assert mixing.fair_mix(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    few = spark.createDataFrame([(i % 9, "s" if i % 2 else None, "w " * (1 + i % 4), i) for i in range(200)], "doc_id long, source string, text string, _id int")
    for some in (docs, few):
        mixed = mixing.mix(some)
        assert mixed.columns == some.columns
        plan = mixing.fair_mix(some, keep_source=True).where("taken > 0")
        want = Counter()
        for r in plan.collect():
            want[r.doc_id, r.source, r["size"]] += r.copies
        assert Counter((r.doc_id, r.source, len(words(r.text))) for r in mixed.collect()) == want
    assert max(Counter(r._id for r in mixed.collect()).values()) <= 3


def test_mix_meets_targets(spark):
    """Three sources of very different sizes, one with over a third of all rows."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id < 300 THEN 'a' WHEN id < 3000 THEN 'b' END").alias("source"), F.expr("repeat('w ', cast(1 + id % 20 as int))").alias("text"))
    rows = mixing.fair_mix(docs).collect()
    taken, target, size = Counter(), {}, {}
    for r in rows:
        s = r.doc_id // 300 and (2 if r.doc_id >= 3000 else 1)
        taken[s] += r.taken
        target[s], size[s] = r.target, r.source_size
    assert target[0] == 3 * size[0]  # as many passes as there are
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    assert [tuple(r) for r in mixing.fair_mix(docs).orderBy("doc_id").collect()] == [tuple(r) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_exact_odd_rows(spark):
    docs = odd_docs(spark)
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == docs.count()
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(normal(r.text).encode()).hexdigest()].append(r.doc_id)
    assert Counter((r.text_sha256, r.doc_id) for r in rows) == Counter((h, i) for h, ids in groups.items() for i in ids)
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(groups.keys())
    left = exact_dedup.drop_exact(docs)
    assert left.columns == docs.columns and sorted(normal(r.text) for r in left.select("text").collect()) == sorted({normal(r.text) for r in docs.select("text").collect()})
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    few = spark.createDataFrame([(1, "a", 1), (None, "a", 2), (None, "b", 3), (None, "b", 4), (2, "c", 5), (2, "c", 6), (2, "d", 7), (3, None, 8)], "doc_id long, text string, _id int")
    assert sorted(r._id for r in exact_dedup.drop_exact(few).collect()) == [1, 3, 5, 7, 8]


def test_exact_heavy_group(spark):
    """A third of all rows is one text: it is settled through the broadcast winners."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 3 = 1 THEN 'hot text' ELSE concat('t', id) END").alias("text"))
    heavy = exact_dedup.heavy_candidates(docs.select(F.unhex(F.sha2("text", 256)).alias("digest")), 8)
    assert hashlib.sha256(b"hot text").digest() in {bytes(r.digest) for r in heavy.collect()}
    rows = exact_dedup.exact_duplicates(docs, counters=8)
    assert rows.where("kept").count() == 2001 and rows.where("group_size = 1000 AND keep_id = 1").count() == 1000


def brute_components(rows, width, percent):
    """doc_id -> (n_shingles, component_id) of rows (id, text) with distinct ids."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def families(spark):
    """Given documents, families whose members differ by a word more each (so links form chains), and odd texts."""
    base = [" ".join(f"w{(i * 31 + j * j) % 400}" for j in range(60)) for i in range(8)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(120).collect()]
    n = max(i for i, _ in rows) + 1
    for b in base:
        w = b.split()
        for step in range(12):
            rows.append((n, " ".join([*w[: 60 - step], *(f"x{n}_{k}" for k in range(step // 2))]).upper() if step % 2 else " ".join(w[step:])))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "Two words"), (n + 4, "two WORDS"), (n + 5, "two"), (n + 6, LONG), (n + 7, LONG + " end")]


@pytest.mark.parametrize(("width", "percent", "members"), [(3, 90, 1024), (5, 80, 1024), (1, 50, 1024), (5, 80, 5), (1, 50, 7)])
def test_jaccard_equals_brute_force(spark, monkeypatch, width, percent, members):
    """With few members to a part, groups are met in several parts and bands."""
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    monkeypatch.setattr(jaccard_join, "OPEN", 1 + members // 4)
    rows = families(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.near_duplicates(docs, width, percent).collect()
    want = brute_components(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert {r.doc_id for r in found if r.kept} == {i for i, (_, c) in want.items() if i == c}


def test_links_come_from_lists_and_derived_answers():
    """All links of a group are found by reading index lists; skipped runs and derived answers save most of the reading."""
    rng = np.random.default_rng(5)
    middle = rng.choice(1 << 40, 300, replace=False)
    sets = [np.sort(middle)]
    for family in range(6):  # families at several distances from the leader, whose members differ more and more
        core = np.concatenate([middle[: 40 * family], rng.choice(1 << 40, 300 - 40 * family)])
        drop = 6 + 4 * family
        sets += [np.unique(np.concatenate([np.delete(core, rng.choice(300, drop, replace=False)), rng.choice(1 << 40, drop)])) for _ in range(25)]
    far = jaccard_join.distances(sets[0], sets)
    order = np.argsort(far, kind="stable")
    sets, far = [sets[i] for i in order], far[order]
    want = np.arange(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(a, sets[j]))
            if 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                want[want == want[i]] = want[j]
    assert 1 < len(set(want.tolist())) < len(sets)
    read = []
    for derive, skip in ((0.7, True), (2.0, True), (2.0, False)):
        links, label, n = jaccard_join.meet(sets, far, np.ones(len(sets), bool), np.arange(len(sets)), 80, derive, skip)
        assert len(links) == len(sets) - len(set(want.tolist()))
        assert len(set(zip(label.tolist(), want.tolist(), strict=True))) == len(set(want.tolist()))
        read.append(n)
    print("entries read", read)
    assert read[0] < read[1] < read[2]
    cut = lambda a, z: pa.RecordBatch.from_pydict({"g": [0, 0, 1, 1, 1][a:z], "p": [0, 1, 1, 1, 2][a:z]})
    assert [(k, len(t)) for k, t in jaccard_join.runs(iter([cut(0, 3), cut(3, 3), cut(3, 5)]), ["g", "p"])] == [((0, 0), 1), ((0, 1), 1), ((1, 1), 2), ((1, 2), 1)]


def test_jaccard_odd_rows(spark):
    docs = odd_docs(spark)
    assert jaccard_join.near_duplicates(docs).count() == docs.count()
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0
    left = jaccard_join.drop_near(docs)
    assert left.columns == docs.columns
    # ids 1, 2 and the second 7 share all words, as do the rows of id 9; the long texts link
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 3, 4, 5, 6, 8, 9, None, None])
    assert jaccard_join.drop_near(empty(spark)).count() == 0


def test_components_of_a_path(spark):
    """A path of 200 nodes with shuffled names."""
    name = lambda i: i * 77 % 211
    edges = spark.createDataFrame([(name(i), name(i + 1)) for i in range(199)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    low = min(name(i) for i in range(200))
    assert all(got[name(i)] == low for i in range(200)) and got[501] == 500 and len(got) == 202


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    assert [r.pos for r in positions(df, F.col("x")).orderBy("x").collect()] == list(range(1, 1001))


def test_components_with_a_hot_centre(spark, monkeypatch):
    """Stars whose centre is on a third of all edges, chains and pairs, with nodes hot and not."""
    from chelate.llm import common

    rng = np.random.default_rng(11)
    edges = [(500, i) for i in range(501, 900)] + [(i, i + 1) for i in range(1_000, 1_060)] + [(2_000 + 2 * i, 2_001 + 2 * i) for i in range(300)] + [(int(a), int(b)) for a, b in rng.integers(0, 400, (150, 2))] + [(3, 700), (5, 5)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [] if n in want else [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    for hot in (1, 10, 1_024):
        monkeypatch.setattr(common, "HOT", hot)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want
