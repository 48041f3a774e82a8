"""Text files read by splits where what a line means depends on the lines before it.

A split of a file doesn't know in which state it begins. A first pass over the splits writes for
each what it does to any state that may enter it; these functions, one small row for each split, are
composed in order of the file, so the second pass knows where every split begins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = "spark.sql.files.minPartitionNum"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block, value: lines in order; block is the first byte of their split. Compressed files are one split.

    Both passes have to see the same splits, so the number that Spark derives them from is fixed
    in the session where it is unset: else it follows the executors that happen to be alive.
    """
    if spark.conf.get(PARTITIONS, None) is None:
        spark.conf.set(PARTITIONS, spark.sparkContext.defaultParallelism)
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """((path, block), rows): batches cut where the split changes."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        path = batch.column("path").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (path[1:] != path[:-1])) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if z > a:
                yield (batch.column("path")[a].as_py(), int(block[a])), batch.slice(a, z - a)


@dataclass(frozen=True)
class Begin:
    """Where a split begins: its first line's number, lines that belong to an open record, and that record's first line."""

    line: int
    skip: int = 0
    head: int = -1


def effect(n: int, at: np.ndarray, size: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """What a split of n lines does to the number of lines to skip that enters it.

    A line at[k] that begins a record takes size[k] lines with it. An entry of up to upper[i] (and
    more than upper[i - 1]) leaves exits[i] lines to skip, of the record that line heads[i] began;
    an entry beyond the last upper leaves none.
    """
    after = at + size
    follows = np.searchsorted(at, after)
    last = list(range(len(at)))
    for k in range(len(at) - 1, -1, -1):  # the record in which the chain from k ends
        if follows[k] < len(at):
            last[k] = last[follows[k]]
    keep = [k for k in range(len(at)) if k + 1 == len(at) or last[k] != last[k + 1]]
    return [int(at[k]) for k in keep], [max(0, int(after[last[k]]) - n) for k in keep], [int(at[last[k]]) for k in keep]


def effects(rows: DataFrame, size: str) -> DataFrame:
    """path, block, n, uppers, exits, heads of each split of rows (path, block, ...); ``size`` is null on lines that begin nothing."""
    kind = "path string, block long, n long, uppers array<long>, exits array<long>, heads array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, at, sizes = None, 0, [], []

        def row() -> pa.RecordBatch:
            ints = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            uppers, exits, heads = effect(n, ints(at), ints(sizes))
            many = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([n]), pa.array([uppers], many), pa.array([exits], many), pa.array([heads], many)], ["path", "block", "n", "uppers", "exits", "heads"])

        for key, part in stretches(batches):
            if key != now:
                if now is not None:
                    yield row()
                now, n, at, sizes = key, 0, [], []
            column = part.column("size")
            found = np.flatnonzero(np.asarray(column.is_valid()))
            at.append(found + n)
            sizes.append(column.drop_null().to_numpy())
            n += part.num_rows
        if now is not None:
            yield row()

    return rows.select("path", "block", F.expr(size).cast("long").alias("size")).mapInArrow(work, kind)


def begins(found: DataFrame) -> tuple[dict[tuple[str, int], Begin], bool]:
    """Where each split begins, from the effects of all, and whether any split's end leaves a record open.

    A row for each split comes to the driver, as for Spark's own plan.
    """
    out: dict[tuple[str, int], Begin] = {}
    file, begin, open_ = None, Begin(0), False
    for r in sorted(found.collect(), key=lambda r: (r.path, r.block)):
        begin = begin if r.path == file else Begin(0)
        file, out[r.path, r.block] = r.path, begin
        i = bisect_left(r.uppers, begin.skip)
        if begin.skip >= r.n:  # the open record takes the whole split
            begin = Begin(begin.line + r.n, begin.skip - r.n, begin.head)
        elif i < len(r.uppers):
            begin = Begin(begin.line + r.n, r.exits[i], begin.line + r.heads[i])
        else:
            begin = Begin(begin.line + r.n)
        open_ = open_ or begin.skip > 0
    return out, open_


@dataclass
class Part:
    """Lines of one record that stand in one split: all of it (whole), or some, from the record's line ``first``."""

    path: str
    head: int
    first: int
    lines: list[str]
    whole: bool


def parts(batches: Iterator[pa.RecordBatch], known: dict[tuple[str, int], Begin], size_of) -> Iterator[Part]:
    """The records of a task's splits; size_of(line) is the number of lines that a record takes, or None."""
    now, part, left, line = None, None, 0, 0
    for key, rows in stretches(batches):
        if key != now:
            if part is not None:
                part.whole = False
                yield part
            if key not in known:
                raise RuntimeError(f"{key[0]} changed, or its splits did, while it was read")
            now, part, begin = key, None, known[key]
            left, line = begin.skip, begin.line
            if left:
                part = Part(key[0], begin.head, line - begin.head, [], False)
        for text in rows.column("value").to_pylist():
            if not left and (n := size_of(text)) is not None:
                part, left = Part(key[0], line, 0, [], True), n
            line += 1
            if left:
                part.lines.append(text)
                left -= 1
                if not left:
                    yield part
                    part = None
    if part is not None:
        part.whole = False
        yield part
