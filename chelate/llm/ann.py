"""Approximate nearest neighbours with an inverted multi-index.

Unit vectors are split in two halves, each quantised by its own centroids; a pair of centroids is
a cell. A query visits the cells in the order of summed distance, which a heap produces, until
they hold the share of all entries that its recall needs, and what they hold is reranked by exact
cosine. That share is measured on the sample that fits the centroids: vectors in clusters need
little of the index, vectors without any structure more than half.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chelate.llm.common import materialise, table

NEAREST, ROUNDS = 5, 8
#: Entries to a cell, about, and centroids of a half at most.
CELL, MOST = 100, 128
#: Rows that may fit the index: the first by hash. Of these, so many ask for their neighbours.
SAMPLE, PROBES = 20_000, 500
#: Recall that the share of visited entries is measured for.
RECALL = 0.96
#: Entries that one task holds at once, and queries that meet them at once.
PART, ASKED = 4_096, 512


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)


def fit(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of k-means from rows at even steps; fewer if there are fewer rows."""
    at = sample[np.linspace(0, len(sample) - 1, min(k, len(sample)), dtype=int)].copy()
    for _ in range(rounds):
        near = distances(sample, at).argmin(1)
        for i in np.unique(near):
            at[i] = sample[near == i].mean(0)
    return at


def distances(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ at.T + (at * at).sum(1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def cells_by_distance(d1: np.ndarray, d2: np.ndarray, held: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(d2) + j) by ascending d1[i] + d2[j], until they hold ``enough`` entries."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    heap, out, found, n2 = [(d1[o1[0]] + d2[o2[0]], 0, 0)], [], 0, len(d2)
    while heap and found < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * n2 + int(o2[j])
        if held[cell]:
            out.append(cell)
            found += held[cell]
        if j + 1 < n2:
            heapq.heappush(heap, (d1[o1[i]] + d2[o2[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (d1[o1[i + 1]] + d2[o2[0]], i + 1, 0))
    return out


@dataclass(frozen=True)
class Index:
    """Centroids of both halves, and the share of all entries that a query's cells have to hold."""

    half: int
    c1: np.ndarray
    c2: np.ndarray
    share: float

    @staticmethod
    def fit(sample: np.ndarray, count: int, top: int, recall: float = RECALL) -> Index:
        """From a sample of unit vectors, for an index of ``count`` entries."""
        half = sample.shape[1] // 2 or 1
        k = min(MOST, math.ceil(math.sqrt(count / CELL)))
        index = Index(half, fit(sample[:, :half], k), fit(sample[:, half:], k), 1.0)
        return Index(half, index.c1, index.c2, index.needed(sample, top, recall))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return distances(x[:, : self.half], self.c1).argmin(1) * len(self.c2) + distances(x[:, self.half :], self.c2).argmin(1)

    def summed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.c1), distances(x[:, self.half :], self.c2)

    def needed(self, sample: np.ndarray, top: int, recall: float) -> float:
        """The share of the sample, visited by summed distance, in which ``recall`` of true neighbours are found."""
        if len(sample) < 2:
            return 1.0
        cell = self.cells(sample)
        held = np.bincount(cell, minlength=len(self.c1) * len(self.c2))
        at = np.unique(np.linspace(0, len(sample) - 1, min(PROBES, len(sample)), dtype=int))
        near = sample[at] @ sample.T
        near[np.arange(len(at)), at] = -np.inf
        true = np.argpartition(-near, min(top, len(sample) - 1) - 1, 1)[:, : min(top, len(sample) - 1)]
        d1, d2 = self.summed(sample[at])
        shares = []
        for a, b, best in zip(d1, d2, true, strict=True):
            order = (a[:, None] + b).ravel().argsort(kind="stable")
            seen = np.empty(len(order))
            seen[order] = np.cumsum(held[order])
            shares.append(seen[cell[best]] / len(sample))
        return float(np.quantile(np.concatenate(shares), recall, method="higher"))


class Block:
    """Entries of a bin's part, held while its queries pass."""

    def __init__(self, pieces: list[pa.RecordBatch], top: int) -> None:
        t = pa.Table.from_batches(pieces).combine_chunks()
        self.x, self.ids, self.top = vectors_of(t.column("v").chunk(0)), t.column("ids").to_pylist(), top
        self.unit, self.norm = unit(self.x), np.sqrt(np.array([np.dot(x, x) for x in self.x]))
        self.first = np.array([i[0] for i in self.ids], np.int64)
        self.cells, self.of = np.unique(t.column("cell").to_numpy(), return_inverse=True)

    def best(self, asked: pa.RecordBatch) -> Iterator[tuple[int, float, list[int]]]:
        """(query, cosine, ids) of the nearest top + 1 entries in each query's cells; a query's own may be among them.

        What is within rounding of the last place is ranked by exact cosine, ties by smallest id.
        """
        q = vectors_of(asked.column("v"))
        near = unit(q) @ self.unit.T
        for query, x, row, cells in zip(asked.column("key").to_pylist(), q, near, asked.column("cells").to_pylist(), strict=True):
            at = np.flatnonzero(np.isin(self.cells, np.frombuffer(cells, np.int32))[self.of])
            if len(at) > self.top + 1:
                some = row[at]
                at = at[some >= np.partition(some, -self.top - 1)[-self.top - 1] - 1e-9]
            size = np.sqrt(np.dot(x, x))
            score = np.array([np.dot(x, self.x[i]) / (size * self.norm[i]) for i in at.tolist()])
            for i in np.lexsort((self.first[at], -score))[: self.top + 1].tolist():
                yield query, float(score[i]), self.ids[at[i]]


def vectors_of(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy().reshape(len(column), -1))


def search(top: int):
    """Nearest entries of each query, of rows sorted by bin, part and side: a part's entries come first and stay, its queries pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        held: list[pa.RecordBatch] = []
        block: Block | None = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(c).to_numpy() for c in ("bin", "part", "side")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if (at := (columns[0][a], columns[1][a])) != now:
                    now, held, block = at, [], None
                if columns[2][a] == 0:
                    held.append(b.slice(a, z - a))
                    continue
                block = block or (Block(held, top) if held else None)
                for i in range(a, z, ASKED) if block else ():
                    found = list(block.best(b.slice(i, min(ASKED, z - i))))
                    query, score, ids = zip(*found, strict=True) if found else ((), (), ())
                    yield pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int64()), "score": pa.array(score, pa.float64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return run


def bins_of(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's bin, and each bin's parts: neighbouring cells share a bin of at most PART entries; a larger cell has a bin of several parts."""
    bins, sizes = np.zeros(len(held), np.int32), [0]
    for cell, n in enumerate(held.tolist()):
        if sizes[-1] and sizes[-1] + n > PART:
            sizes.append(0)
        sizes[-1] += n
        bins[cell] = len(sizes) - 1
    return bins, np.maximum(1, -(-np.array(sizes) // PART))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", top: int = NEAREST, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``top`` largest cosines among all other rows found.

    Equal vectors are one entry that carries its ``top`` + 1 smallest ids, which is all that any
    query can return of them, so a vector that a third of the rows share is one entry of one
    cell. Ties go to the smaller id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows with a null id, nor vectors of another length than the
    most common one. An id counts once, with the least of its vectors by their components, as a query
    if any of its rows is one. Empty tables give an empty result. The index is fitted on at most ``sample`` distinct vectors; every row is indexed.
    ``recall`` is what the visited share of the entries is measured for.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q"))
    # of an id's vectors one counts: the least by its components
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], out)
    rows = materialise(rows.where(F.size("v") == length.n).withColumn("key", F.xxhash64("v")))
    # the smallest ids of each distinct vector, without gathering all: rank within salted parts, then overall
    salted = Window.partitionBy("key", "v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = rows.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= top + 1)
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("key", "v").orderBy("id"))).where(F.col("r") <= top + 1)
    entries = materialise(ranked.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")))

    some = entries.orderBy("key", "ids").limit(sample).select("v").toPandas()  # `sample` rows at most
    index = Index.fit(unit(matrix(some["v"])), entries.count(), top, recall)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["cell"] = index.cells(unit(matrix(b["v"])))
                yield b

    placed = materialise(entries.select("v", "ids").mapInPandas(place, "v array<double>, ids array<long>, cell int"))
    held = np.zeros(len(index.c1) * len(index.c2), np.int64)
    for cell, n in placed.groupBy("cell").count().collect():  # MOST * MOST numbers at most
        held[cell] = n
    bins, parts = bins_of(held)
    enough = math.ceil(index.share * held.sum())

    asked = rows.where("q").select(F.col("key").alias("qkey"), F.col("v").alias("qv")).distinct().withColumn("query", F.monotonically_increasing_id())
    asked = materialise(asked)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each part of each bin that holds cells of the query."""
        for b in batches:
            if not len(b):
                continue
            d1, d2 = index.summed(unit(matrix(b["qv"])))
            out: list[tuple] = []
            for query, v, x, y in zip(b["query"], b["qv"], d1, d2, strict=True):
                cells = np.array(cells_by_distance(x, y, held, enough), np.int32)
                for one in np.unique(bins[cells]).tolist():
                    inside = cells[bins[cells] == one].tobytes()
                    out += [(one, part, 1, query, None, inside, v, None) for part in range(parts[one])]
            yield pd.DataFrame(out, columns=["bin", "part", "side", "key", "cell", "cells", "v", "ids"])

    fields = "bin int, part int, side int, key long, cell int, cells binary, v array<double>, ids array<long>"
    spread = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // 256)))
    visits = asked.select("query", "qv").repartition(spread).mapInPandas(visit, fields)
    of_cell = spark.createDataFrame([(c, int(b), int(parts[b])) for c, b in enumerate(bins.tolist())], "cell int, bin int, parts int")
    entry = placed.join(F.broadcast(of_cell), "cell").select("bin", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("key"), "cell", F.lit(None).cast("binary").alias("cells"), "v", "ids")
    both = entry.unionByName(visits).repartition("bin", "part").sortWithinPartitions("bin", "part", "side")
    near = both.mapInArrow(search(top), "query long, score double, ids array<long>")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("ids", 1)))).where(F.col("r") <= top + 1)
    lists = best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))  # top + 1 entries at most
    of_row = rows.where("q").join(asked, (F.col("key") == F.col("qkey")) & (F.col("v") == F.col("qv"))).select(F.col("id").alias("query_id"), "query")
    answers = of_row.join(lists, "query").select(
        "query_id",
        F.filter(F.flatten(F.transform("found", lambda e: F.transform(e.ids, lambda i: F.struct((-e.score).alias("minus"), i.alias("vec_id"))))), lambda e: e.vec_id != F.col("query_id")).alias("found"),
    )
    answers = answers.select("query_id", F.posexplode(F.slice(F.array_sort("found"), 1, top)).alias("pos", "e"))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.minus")).alias("score"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op7_ann": op7_ann}
ORACLES: dict[str, str] = {}  # approximate by design: the tests hold it against brute force
