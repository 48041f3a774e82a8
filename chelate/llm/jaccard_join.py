"""N-gram Jaccard self-join with set-relation skipping, and the components of its links.

1. Equal shingle sets are one class. In the order of shingle hashes, two sets that link share at
   least ``shared(n)`` of their first ``prefix(n)`` shingles (extended prefix filter), so a set
   with fewer prefix shingles that any other set has too is settled: it links with nothing.
2. What is left gets a second, rarest-first order from the shingles' counts. The first set of
   each list of a plain prefix shingle leads a group, which every set of the list joins. Two sets
   that link share such a list and so meet in its leader's group.
3. A group is met in parts of bounded size, each with the leader. Index lists hold members by
   position, their distance from the leader, and whole runs that the triangle inequality excludes
   are skipped. A set that is highly similar to one answered before derives its overlaps from
   that answer and the few shingles in which the two differ.
4. Of a group of several parts, members that link with the leader are connected already. The
   others meet the other parts whose bands of distance are within reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chelate.llm.blocks import answer, cut, from_planes, mix, planes, slices, trim, words_of
from chelate.llm.common import HOT, components, keep_found, materialise, small_batches, small_join, table

#: Members and shingles of a group's part, and open members that meet it at once.
MEMBERS, SHINGLES, OPEN = 1024, 1 << 20, 256
#: One more shingle in so many of a set stands in its extended prefix.
EXTRA = 10
#: Sets in a block of the rarest-first order.
SETS = 2048
#: Derive from an answered set when this share of the union is common.
DERIVE = 0.7


def least(n, percent: int):
    """The smallest overlap, and the smallest partner, that a set of n shingles can link with."""
    return -(-percent * n // 100)


def extra(n):
    return np.maximum(1, n // EXTRA)


def shared(n, percent: int):
    return extra(least(n, percent))


def prefix(n, percent: int):
    return n - least(n, percent) + extra(n)


def linked(inter, n, m, percent: int):
    return 100 * inter >= percent * (n + m - inter)


def shingle_sets(rows: list[dict], text: str, words: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending; of fewer words, one for all of them; of none, none."""
    seq, lens, hashes = words_of(rows, text)
    h = hashes[seq]
    ends = np.cumsum(lens)
    for start, end in zip(ends - lens, ends, strict=True):
        doc = h[start:end]
        width = min(words, len(doc))
        out = doc[: len(doc) - width + 1] if width else doc
        for i in range(1, width):
            out = mix(out, doc[i : len(doc) - width + 1 + i])
        yield np.unique((mix(out, np.full(1, width, np.uint64)) if width else out).view(np.int64))


def signature(s: np.ndarray) -> bytes:
    u = s.view(np.uint64)
    return np.array([u.sum(dtype=np.uint64), mix(u, np.ones(1, np.uint64)).sum(dtype=np.uint64) if len(u) else 0], np.uint64).tobytes()


def profiles(words: int, percent: int):
    """Each row's set as its size, signature and extended prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in cut(batches, "text"):
            sets = list(shingle_sets(rows, "text", words))
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array([r["key"] for r in rows], pa.int64()), "mark": pa.array([r["mark"] for r in rows], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "sig": [signature(s) for s in sets], "prefix": [s[: prefix(len(s), percent)].tobytes() for s in sets]},
                schema=pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("prefix", pa.binary())]),
            )

    return run


def prefix_hits(buckets: int):
    """Prefix shingles of each block by bucket. What two sets of the block share is known to be shared and stays there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in cut(batches, "prefix"):
            each = [np.frombuffer(r["prefix"], np.int64).view(np.uint64) for r in rows]
            owner = np.repeat(np.array([r["rep"] for r in rows], np.int64), [len(x) for x in each])
            h = np.concatenate(each)
            order = h.argsort(kind="stable")
            h, owner = h[order], owner[order]
            distinct, first, n = np.unique(h, return_index=True, return_counts=True)
            one = np.where(n == 1, owner[first], -1)
            at = slices(distinct, buckets)
            local = owner[np.repeat(n > 1, n)]
            out: dict[str, list] = {"bucket": [block % buckets], "hashes": [b""], "reps": [planes(local)]}
            for i in np.flatnonzero(np.diff(at)):
                part = slice(at[i], at[i + 1])
                out["bucket"].append(int(i))
                out["hashes"].append(planes(distinct[part]))
                out["reps"].append(planes(one[part]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("reps", pa.binary())]))

    return run


def count_hits(t: pa.Table) -> pa.Table:
    """(rep, hits): how many of a set's prefix shingles another set has in its prefix."""
    hashes, reps, known = [], [], []
    for h, r in zip(t.column("hashes").to_pylist(), t.column("reps").to_pylist(), strict=True):
        (reps if h else known).append(from_planes(r, np.int64))
        if h:
            hashes.append(from_planes(h, np.uint64))
    if hashes:
        h, r = np.concatenate(hashes), np.concatenate(reps)
        _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        known.append(r[(n[inverse] > 1) & (r >= 0)])
    rep, hits = np.unique(np.concatenate(known) if known else np.zeros(0, np.int64), return_counts=True)
    return pa.table({"rep": pa.array(rep, pa.int64()), "hits": pa.array(hits, pa.int64())})


def full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in cut(batches, "text"):
            sets = list(shingle_sets(rows, "text", words))
            yield pa.RecordBatch.from_pydict({"sig": [signature(s) for s in sets], "hashes": [s.tobytes() for s in sets]}, schema=pa.schema([("sig", pa.binary()), ("hashes", pa.binary())]))

    return run


def pack(key: tuple, t: pa.Table) -> pa.Table:
    """A block's sets in one row; a set that came twice, from rows repeated with one id, is there once."""
    sets = dict(zip(t.column("rep").to_pylist(), t.column("hashes").to_pylist(), strict=True))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "rep": [list(sets)], "lens": pa.array([[len(x) // 8 for x in sets.values()]], pa.list_(pa.int32())), "hashes": [b"".join(sets.values())]})


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.cumsum([0, *row["lens"]]) * 8
            yield pa.RecordBatch.from_pydict(
                {"rep": pa.array(row["rep"], pa.int64()), "n": pa.array(row["lens"], pa.int64()), "hashes": [row["hashes"][a:z] for a, z in zip(ends, ends[1:], strict=False)]},
                schema=pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())]),
            )


def ask_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                distinct, n = np.unique(np.frombuffer(row["hashes"], np.int64).view(np.uint64), return_counts=True)
                at = slices(distinct, buckets)
                some = [int(i) for i in np.flatnonzero(np.diff(at))]
                yield pa.RecordBatch.from_pydict(
                    {"bucket": some, "block": [row["block"]] * len(some), "hashes": [planes(distinct[at[i] : at[i + 1]]) for i in some], "counts": [planes(n[at[i] : at[i + 1]].astype(np.uint32)) for i in some]},
                    schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]),
                )

    return run


def give_counts(key: tuple, t: pa.Table) -> pa.Table:
    hashes = [from_planes(x, np.uint64) for x in t.column("hashes").to_pylist()]
    counts = [from_planes(x, np.uint32).astype(np.float64) for x in t.column("counts").to_pylist()]
    each, _ = answer(lambda inverse, n: np.bincount(inverse, n), hashes, counts)
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "counts": pa.array([planes(x.astype(np.uint32)) for x in each], pa.binary())})


def rare_prefix(percent: int):
    """(token, rep, low): of each set's plain prefix in rarest-first order, what occurs in more than one set; low: the block's first set with it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        h = np.frombuffer(row["hashes"], np.int64)
        distinct, inverse = np.unique(h.view(np.uint64), return_inverse=True)
        counts = np.concatenate([from_planes(x, np.uint32) for _, x in sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))])[inverse]
        tokens, reps, end = [], [], 0
        for rep, n in zip(row["rep"], row["lens"], strict=True):
            s, c = h[end : end + n], counts[end : end + n]
            end += n
            order = np.lexsort((s, c))[: n - least(n, percent) + 1]
            tokens.append(s[order][c[order] > 1])
            reps.append(np.full(len(tokens[-1]), rep, np.int64))
        token, rep = np.concatenate(tokens), np.concatenate(reps)
        _, at = np.unique(token, return_inverse=True)
        low = np.full(at.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, at, rep)
        return pa.table({"token": pa.array(token, pa.int64()), "rep": pa.array(rep, pa.int64()), "low": pa.array(low[at], pa.int64())})

    return run


class Lists:
    """Index lists of sets by shingle. A list holds positions in order, so a run of positions is a slice; ``read`` counts the entries read."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.width, self.read = len(sets), 0
        self.tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.lists = np.sort(inverse.astype(np.int64) * self.width + np.repeat(np.arange(self.width), [len(s) for s in sets]))

    def overlaps(self, s: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Common shingles of s with each of the sets lo to hi; a list's other runs are skipped."""
        if lo >= hi or not len(s):
            return np.zeros(max(hi - lo, 0), np.int64)
        t = np.searchsorted(self.tokens, s)
        t = t[(t < len(self.tokens)) & (self.tokens[np.minimum(t, len(self.tokens) - 1)] == s)]
        a, b = np.searchsorted(self.lists, t * self.width + lo), np.searchsorted(self.lists, t * self.width + hi)
        size = b - a
        pick = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.read += len(pick)
        return np.bincount(self.lists[pick] % self.width - lo, minlength=hi - lo)


def distances(leader: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard distance of each set from the leader."""
    n = np.array([len(s) for s in sets])
    all_of = np.concatenate(sets)
    hit = leader[np.minimum(np.searchsorted(leader, all_of), len(leader) - 1)] == all_of
    common = np.bincount(np.repeat(np.arange(len(sets)), n), hit, len(sets))
    return 1 - common / np.maximum(n + len(leader) - common, 1)


def meet(sets: list[np.ndarray], far: np.ndarray, asked: np.ndarray, label: np.ndarray, percent: int, derive: float = DERIVE, skip: bool = True) -> tuple[list[tuple[int, int]], np.ndarray, int]:
    """Links that connect asked sets with any; those that follow from others are left out.

    sets, in ascending order of far, their distance from one common set; label: equal for sets
    known to be connected. Returns links by place, labels that tell what is connected now, and the
    index entries read. With derive above 1, no answer is derived; without skip, no run is skipped.
    """
    lists, label = Lists(sets), label.copy()
    n, width = np.array([len(s) for s in sets]), len(sets)
    reach = 1 - percent / 100 + 1e-9 if skip else 2.0
    links: list[tuple[int, int]] = []
    answers: dict[int, tuple[np.ndarray, int, int]] = {}
    base, best = np.full(width, -1), np.zeros(width)
    for j in np.flatnonzero(asked).tolist():
        s, m = sets[j], int(n[j])
        lo, hi = int(np.searchsorted(far, far[j] - reach)), int(np.searchsorted(far, far[j] + reach, "right"))
        can = (label[lo:hi] != label[j]) & (n[lo:hi] * 100 >= percent * m) & (m * 100 >= percent * n[lo:hi])
        if not can.any():
            continue
        near = int(base[j])
        if near >= 0 and best[j] >= derive:
            common, a, z = answers[near]
            a, z = max(a, lo), min(z, hi)
            gone, new = np.setdiff1d(sets[near], s, True), np.setdiff1d(s, sets[near], True)
            middle = common[a - answers[near][1] : z - answers[near][1]] - lists.overlaps(gone, a, z) + lists.overlaps(new, a, z)
            common = np.concatenate([lists.overlaps(s, lo, a), middle, lists.overlaps(s, z, hi)])
        else:
            common = lists.overlaps(s, lo, hi)
        answers[j] = (common, lo, hi)
        alike = common / np.maximum(n[lo:hi] + m - common, 1)
        closer = alike > best[lo:hi]
        base[lo:hi][closer], best[lo:hi][closer] = j, alike[closer]
        for i in (np.flatnonzero(can & linked(common, m, n[lo:hi], percent)) + lo).tolist():
            if label[i] != label[j]:
                label[label == label[i]] = label[j]
                links.append((j, i))
    return links, label, lists.read


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows with equal keys together, of batches that come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    now: tuple = ()
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        for a, z in pairwise([0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]):
            key = tuple(c[a].item() for c in columns)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


MET = "a long, b long, far double, open boolean"
MET_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("far", pa.float64()), ("open", pa.bool_())])


def inside(percent: int):
    """Links (a, b) inside each part of each group; of a group of several parts also what its members are to its leader, a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, _), t in runs(batches, ["group", "part"]):
            reps, sets = t.column("rep").to_numpy(), [np.frombuffer(x, np.int64) for x in t.column("hashes").to_pylist()]
            far = distances(sets[int(np.flatnonzero(reps == group)[0])], sets)
            order = np.lexsort((reps, reps != group, far))
            reps, sets, far = reps[order], [sets[i] for i in order.tolist()], far[order]
            links, label, _ = meet(sets, far, np.ones(len(reps), bool), np.arange(len(reps)), percent)
            a, b = [reps[i] for i, _ in links], [reps[i] for _, i in links]
            distance: list = [None] * len(links)
            is_open: list = [None] * len(links)
            if t.column("parts")[0].as_py() > 1:
                a += [group] * (len(reps) - 1)
                b += reps[1:].tolist()
                distance += far[1:].tolist()
                is_open += (label[1:] != label[0]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((a, b, distance, is_open), MET_ARROW, strict=True)], schema=MET_ARROW)
        trim()

    return run


def across(percent: int):
    """Links (a, b) of open members with members of other parts of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, ["group", "ab", "hb", "o", "m"]):
            asked = np.zeros(len(t), bool)
            reps, far, is_open, side = (t.column(c).to_numpy() for c in ("rep", "far", "open", "side"))
            order = np.lexsort((-side, reps, far))
            order = order[np.append(True, np.diff(reps[order]) != 0)]  # an asked member may be held too
            asked, reps, far = side[order] == 1, reps[order], far[order]
            hashes = t.column("hashes").take(pa.array(order)).to_pylist()
            label = np.where(is_open[order], np.arange(len(order)), -1)
            links, _, _ = meet([np.frombuffer(x, np.int64) for x in hashes], far, asked, label, percent)
            yield pa.RecordBatch.from_pydict({"a": pa.array([reps[i] for i, _ in links], pa.int64()), "b": pa.array([reps[i] for _, i in links], pa.int64())})
        trim()

    return run


def set_links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, edges): each row's key, row, n and sig; links between class representatives that connect what is connected.

    docs has key and text (binary). A class is a set of equal rows' sets; its representative is
    its smallest row number.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(profiles(words, percent), "key long, mark long, n long, sig binary, prefix binary")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    # of a class, only the representative's prefix travels on
    classes = materialise(rows.where("n > 0").groupBy("sig").agg(F.min("row").alias("row")).select("row"))
    reps = small_join(rows, classes, "row", "left_semi").withColumnRenamed("row", "rep")
    hits = reps.select("rep", "prefix").mapInArrow(prefix_hits(buckets), "bucket int, hashes binary, reps binary")
    hits = hits.groupBy("bucket").applyInArrow(count_hits, "rep long, hits long").groupBy("rep").agg(F.sum("hits").alias("hits"))
    small = F.ceil(F.col("n") * percent / 100)
    left = reps.drop("mark").join(hits, "rep").where(F.col("hits") >= F.greatest(F.lit(1), F.floor(small / EXTRA))).select("rep", "key", "n", "sig")
    left = materialise(left)

    some = small_join(docs, left.select("key").distinct(), "key", "left_semi")
    sets = small_join(some.mapInArrow(full_sets(words), "sig binary, hashes binary"), left.select("sig", "rep"), "sig", "inner")
    blocks = max(1, -(-left.count() // SETS))
    sets = sets.select("rep", "hashes", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("long").alias("block"))
    packed = materialise(sets.groupBy("block").applyInArrow(pack, "block long, rep array<long>, lens array<int>, hashes binary"))
    sets = packed.mapInArrow(unpack, "rep long, n long, hashes binary")
    counts = packed.mapInArrow(ask_counts(buckets), "bucket int, block long, hashes binary, counts binary").groupBy("bucket").applyInArrow(give_counts, "block long, bucket int, counts binary")
    tokens = materialise(packed.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(rare_prefix(percent), "token long, rep long, low long"))
    # a shingle's list is met by its blocks' first sets, so that a frequent one is never in one task
    lows = tokens.select("token", "low").distinct().withColumn("group", F.min("low").over(Window.partitionBy("token")))
    homes = tokens.join(lows, ["token", "low"]).select("group", "rep").distinct()
    homes = materialise(homes.join(left.select("rep", "n"), "rep"))
    sizes = homes.groupBy("group").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    sizes = sizes.withColumn("parts", F.greatest(F.ceil(F.col("size") / MEMBERS), F.ceil(F.col("shingles") / SHINGLES)).cast("int"))
    big = materialise(sizes.where("parts > 1 AND size > 1").select("group", "parts", (F.col("shingles") / F.col("size")).alias("mean")))
    placed = small_join(homes, big.select("group", "parts"), "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    deal = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    placed = placed.select("group", "rep", "parts", F.explode(F.when(F.col("rep") == F.col("group"), upto(F.col("parts"))).otherwise(F.array(deal(F.col("parts"))))).alias("part"))
    members = small_join(sets.select("rep", "hashes"), placed, "rep", "inner")
    met = materialise(members.repartition("group", "part").sortWithinPartitions("group", "part", "rep").mapInArrow(inside(percent), MET))
    edges = met.where("far IS NULL").select("a", "b")
    if big.isEmpty():
        return rows.drop("prefix"), edges

    width = 1 - percent / 100 + 1e-6
    status = met.where("far IS NOT NULL").select(F.col("a").alias("group"), F.col("b").alias("rep"), "far", "open", F.floor(F.col("far") / width).cast("int").alias("band"))
    bands = status.groupBy("group", "band").agg(F.count("*").alias("size"), F.count(F.when(F.col("open"), 1)).alias("opens")).join(big, "group")
    bands = bands.withColumn("parts", F.greatest(F.ceil(F.col("size") / MEMBERS), F.ceil(F.col("size") * F.col("mean") / SHINGLES)).cast("int"))
    bands = materialise(bands)
    who = bands.where("opens > 0").select("group", F.col("band").alias("ab"), F.ceil(F.col("opens") / OPEN).cast("int").alias("os"))
    whom = bands.select("group", F.col("band").alias("hb"), F.col("parts").alias("ms"))
    near = materialise(who.join(whom, "group").where("abs(ab - hb) <= 1"))
    ask = small_join(status.where("open").withColumn("ab", F.col("band")), near, ["group", "ab"], "inner").withColumn("o", deal(F.col("os"))).withColumn("m", F.explode(upto(F.col("ms"))))
    hold = small_join(status.withColumn("hb", F.col("band")), near, ["group", "hb"], "inner").withColumn("m", deal(F.col("ms"))).withColumn("o", F.explode(upto(F.col("os"))))
    columns = ["group", "ab", "hb", "o", "m", "rep", "far", "open"]
    pairs = ask.select(*columns, F.lit(1).alias("side")).unionByName(hold.select(*columns, F.lit(0).alias("side")))
    pairs = small_join(sets.select("rep", "hashes"), pairs, "rep", "inner")
    pairs = pairs.repartition("group", "ab", "hb", "o", "m").sortWithinPartitions("group", "ab", "hb", "o", "m").mapInArrow(across(percent), "a long, b long")
    return rows.drop("prefix"), edges.unionByName(pairs)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, mark, kept.

    Texts link when 100 * common >= percent * united distinct shingles of ``words`` words (A-Z
    lower-cased, cut at ASCII white space); a text with fewer words has one shingle of all; a text
    without words, or null, has none and links with nothing. component_id is the smallest doc_id
    that links reach; of a null id it is null unless another id is reached. kept: of what links
    connect, one row, which has the smallest doc_id. mark: a hash of the text. Rows repeated with
    an id are texts like any other. Empty tables give empty results; other columns aren't read. No
    partner or candidate is capped.
    """
    key = F.coalesce(F.col(id_col), F.lit(-(2**63)).cast("long"))
    text = F.col(text_col).cast("binary")
    rows, edges = set_links(small_batches(docs).select(key.alias("key"), F.xxhash64(text).alias("mark"), text.alias("text")), words, percent)
    ident = F.when(F.col("key") != F.lit(-(2**63)).cast("long"), F.col("key"))
    first = F.struct(ident.isNull().alias("missing"), ident.alias("id"), F.col("row").alias("row"))
    classes = materialise(rows.where("n > 0").groupBy("sig").agg(F.min("row").alias("rep"), F.min(first).alias("low"), F.count("*").alias("size")))
    total = classes.agg(F.sum("size")).first()[0] or 0
    found = components(edges).withColumnRenamed("node", "rep")
    inside = classes.join(found, "rep").select("sig", "low", "component")
    lowest = materialise(inside.groupBy("component").agg(F.min("low").alias("lowest")))
    best = small_join(inside, lowest, "component", "inner").select("sig", "lowest")
    classes = materialise(classes.join(best, "sig", "left").select("sig", "size", F.coalesce("lowest", "low").alias("lowest")))
    # a set that many rows share reaches them by a broadcast of at most HOT rows; rows without words ask for none
    some, hot = rows.where("n > 0"), F.broadcast(classes.where(F.col("size") * HOT > total).select("sig", "lowest"))
    light = some.join(hot.select("sig"), "sig", "left_anti").join(classes.where(F.col("size") * HOT <= total).select("sig", "lowest"), "sig")
    bare = rows.where("n = 0").withColumn("lowest", F.lit(None).cast(classes.schema["lowest"].dataType))
    out = some.join(hot, "sig").unionByName(light).unionByName(bare)
    return out.select(
        ident.alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("lowest.id")).otherwise(ident).alias("component_id"),
        "mark",
        ((F.col("n") == 0) | (F.col("lowest.row") == F.col("row"))).alias("kept"),
    )


def drop_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Columns, whatever their names, stay as they are.

    Only ids of dropped documents are joined. Texts without words all stay, but of rows equal in
    id and text one; an empty table gives an empty result.
    """
    found = materialise(near_duplicates(docs, words, percent).select(F.col("doc_id").alias("id"), "mark", "kept"))
    return keep_found(docs, found, F.xxhash64(F.col("text").cast("binary")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90).drop("mark", "kept")


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES: dict[str, str] = {}
