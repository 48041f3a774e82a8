"""Periodic runs: stretches of words that repeat with one period, and texts without the repeats.

A run of period q has at least ``max(shortest, times * q)`` words, so it overlaps itself, shifted by
q, in at least k words, whatever q is. Hence each of its words lies in a k-gram that its document
holds twice. Words outside such k-grams are masked, and only the segments between them are divided
as Main and Lorentz do: a run crosses the centre of some node of the halving, and half of the run, at
least two periods, lies on one side of that centre. So squares that end or begin at a centre are
sought there, for all centres of one level at once, and extended to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.llm.blocks import cut, mix, number
from chelate.llm.common import SPACE, id_text, small_batches, table

#: Bytes of text that a worker holds at once, and the least length of a run in words and in periods.
BLOCK_BYTES = 2 << 20
SHORTEST, TIMES = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"


def least_overlap(shortest: int, times: int) -> int:
    """Words that any run shares with itself when moved by its period."""
    return min(max(shortest - q, (times - 1) * q) for q in range(1, shortest + 1))


def repeated(seq: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Marks the words that lie in a k-gram which their text holds twice; a few more where hashes collide."""
    marked = np.zeros(len(seq), bool)
    if len(seq) < k:
        return marked
    n = len(seq) - k + 1
    gram = owner[:n].astype(np.uint64)
    for j in range(k):
        gram = mix(gram, seq[j : j + n].astype(np.uint64))
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    order = at[np.argsort(gram[at], kind="stable")]
    same = gram[order[1:]] == gram[order[:-1]]
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    for j in range(k):
        marked[starts + j] = True
    return marked


def segments(seq: np.ndarray, owner: np.ndarray, marked: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Marked stretches of at least ``shortest`` words, a unique negative number between them.

    Returns the words, each one's place in seq (-1 for the numbers between) and the longest stretch.
    """
    at = np.flatnonzero(marked)
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    which = np.cumsum(first) - 1
    size = np.bincount(which) if len(at) else np.zeros(0, np.int64)
    long = size[which] >= shortest if len(at) else np.zeros(0, bool)
    at, first = at[long], first[long]
    new = np.arange(len(at)) + np.cumsum(first)
    words = -1 - np.arange(len(at) + int(first.sum()) + 1)
    place = np.full(len(words), -1)
    words[new], place[new] = seq[at], at
    return words, place, int(size.max(initial=0))


class Stretches:
    """Equality of equally long stretches, by prefix sums of a polynomial hash modulo 2 to the power of 64."""

    def __init__(self, x: np.ndarray, seed: int) -> None:
        with np.errstate(over="ignore"):
            code = mix(x.astype(np.uint64), np.full(len(x), seed, np.uint64))
            base = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & ((1 << 64) - 1) | 1)
            self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(x), base))])
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * self.power[:-1])])

    def same(self, a: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a equal the n words from a + q."""
        with np.errstate(over="ignore"):
            return (self.sums[a + n] - self.sums[a]) * self.power[q] == self.sums[a + q + n] - self.sums[a + q]

    def reach(self, a: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The largest n up to ``most`` for which same() holds from a on, or before a."""
        low, high = np.zeros_like(a), most.copy()
        while (open_ := low < high).any():
            n = (low + high + 1) // 2
            good = self.same(a - n if back else a, q, n)
            low, high = np.where(open_ & good, n, low), np.where(open_ & ~good, n - 1, high)
        return low


def squares(x: np.ndarray, h: Stretches, half: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(centre, start, period) of squares of periods up to ``most`` that end, then that begin, at a centre."""
    centre = np.arange(half, len(x), 2 * half)
    rows = max(1, (1 << 20) // most)
    for a in range(0, len(centre), rows):
        c, q = centre[a : a + rows, None], np.arange(1, most + 1)[None, :]
        for left in (True, False):
            # one word on either side of the period first: it leaves few to be hashed
            start = c - 2 * q if left else c + 0 * q
            fits = start + 2 * q <= len(x)
            start = np.where(fits, start, 0)
            i, j = np.nonzero(fits & (x[start] == x[start + q]) & (x[start + q - 1] == x[start + 2 * q - 1]))
            s, p = start[i, j], j + 1
            good = h.same(s, p, p)
            yield c[i[good], 0], s[good], p[good]


def extended(x: np.ndarray, h: Stretches, centre: np.ndarray, start: np.ndarray, period: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of the maximal stretches that hold these squares, but for multiples of a period found."""
    order = np.lexsort((period, centre))
    c, a, q = centre[order], start[order], period[order]
    while len(c):
        first = np.ones(len(c), bool)
        first[1:] = c[1:] != c[:-1]
        a0, q0 = a[first], q[first]
        s = a0 - h.reach(a0, q0, np.minimum(a0, longest), back=True)
        e = a0 + q0 + h.reach(a0, q0, np.minimum(len(x) - q0 - a0, longest))
        yield s, e, q0
        of = np.cumsum(first) - 1
        # a square inside this run, of a multiple of its period, belongs to no other
        stay = ~first & ~((q % q0[of] == 0) & (a >= s[of]) & (a + 2 * q <= e[of]))
        c, a, q = c[stay], a[stay], q[stay]


def runs_of(x: np.ndarray, longest: int, shortest: int = SHORTEST, times: int = TIMES, seed: int = 1) -> np.ndarray:
    """Rows (start, end, period) of all runs in x, none of which is longer than ``longest``."""
    if times < 4 or shortest < 2:
        raise ValueError("runs of fewer than four periods or two words need squares across the centres")
    h, found, half = Stretches(x, seed), [np.zeros((0, 3), np.int64)], 2
    while half < len(x):
        most = min(2 * half, longest) // times
        for square in squares(x, h, half, most) if most else ():
            found += [np.stack(r, 1) for r in extended(x, h, *square, longest)]
        half *= 2
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(shortest, times * runs[:, 2])]
    # of one stretch the smallest period
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])] if len(runs) else runs
    for s, e, q in runs.tolist():
        ends = s == 0 or x[s - 1] != x[s - 1 + q], e == len(x) or x[e] != x[e - q]
        if not all(ends) or not np.array_equal(x[s : e - q], x[s + q : e]):
            return runs_of(x, longest, shortest, times, seed + 1)  # hashes collided
    return runs


def of_texts(texts: list[bytes | None], shortest: int, times: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Number of words, rows (start, length, period), and the words that no run repeats, of each text."""
    seq, lens, words = number(texts, lower=False)
    seq = seq.astype(np.int64)
    owner, begin = np.repeat(np.arange(len(lens)), lens), np.cumsum(lens) - lens
    x, place, longest = segments(seq, owner, repeated(seq, owner, least_overlap(shortest, times)), shortest)
    runs = runs_of(x, longest, shortest, times)
    kept = np.ones(len(seq) + 1, np.int64)
    begins, ends = place[runs[:, 0]] + runs[:, 2], place[runs[:, 0]] + runs[:, 1] - runs[:, 0]
    step = np.bincount(begins, minlength=len(seq) + 1) - np.bincount(ends, minlength=len(seq) + 1)
    kept = np.cumsum(step) == 0
    start = place[runs[:, 0]]
    text = owner[start] if len(runs) else np.zeros(0, np.int64)
    rows = np.stack([start - begin[text], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    order = np.lexsort((rows[:, 2], rows[:, 0], text))
    cuts = np.searchsorted(text[order], np.arange(len(lens) + 1))
    for i, n in enumerate(lens.tolist()):
        a = int(begin[i])
        left = seq[a : a + n][kept[a : a + n]]
        yield n, rows[order[cuts[i] : cuts[i + 1]]], b" ".join(map(words.__getitem__, left.tolist()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of words whose smallest period is ``period``, of at least ``shortest`` words
    and ``times`` periods (4 or more), that no neighbouring word extends. collapsed: the words
    joined by one space, without those that a run holds after its first period. A null or empty text
    has no words, no runs and an empty collapsed text; a text of one word repeated is one run. Rows
    repeated, with or without an id, each give their row; an empty table gives an empty result; other
    columns, whatever their names, are not read. A text is worked on whole, in memory linear in it.
    """
    kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in cut(batches, "text", BLOCK_BYTES):
            found = list(of_texts([r["text"] for r in rows], shortest, times))
            each = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()] for _, runs, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["id"] for r in rows], id_type),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array(each, kind),
                    pa.array([c for _, _, c in found], pa.binary()),
                ],
                ["id", "n_words", "runs", "collapsed"],
            )

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    name = rows.schema["id"].dataType.simpleString()
    id_type = pa.string() if name == "string" else pa.int32() if name == "int" else pa.int64()
    out = rows.mapInArrow(work, f"id {name}, n_words long, runs {RUNS}, collapsed binary")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def repeat_tail(docs: DataFrame) -> DataFrame:
    """doc_id and text; in each document whose id's crc32 h is divisible by 10, the words from a on repeat.

    With g = floor(h / 10), n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), word i >= a
    becomes word a + (i - a) % p. Null ids count as the empty text.
    """
    h = F.crc32(id_text(F.col("doc_id")).cast("binary"))
    words = F.expr(rf"filter(split(text, r'{SPACE}'), w -> w <> '')")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumns({"n": F.size("words"), "g": F.expr("h div 10")}).withColumn("a", F.expr("IF(n > 0, g % n, 0)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tiled = "array_join(concat(slice(words, 1, int(a)), transform(sequence(a, n - 1L), i -> words[int(a + (i - a) % p)])), ' ')"
    return rows.select("doc_id", F.expr(f"IF(n > 0, {tiled}, text)").alias("text"))


def longest_of(runs: str) -> Column:
    """The run with the greatest length / period, the first of equal ones; null of none."""
    better = f"aggregate({runs}, {runs}[0], (b, r) -> IF(r.length * b.period > b.length * r.period, r, b))"
    return F.expr(f"IF(size({runs}) > 0, {better}, null)")


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(repeat_tail(table(spark, sf_dir, "documents"))).withColumn("best", longest_of("runs"))
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic": op11_periodic}
ORACLES: dict[str, str] = {}  # all periods of all texts are too many for SQL: the tests compare with brute force
