"""Periodic runs against all periods of all stretches."""

import hashlib
import random
import zlib

import pytest
from odd import LONG, ROWS, empty, odd_docs
from pyspark.sql import functions as F

from chelate.llm import periodic
from conftest import DATA


def brute(words, shortest=6, times=4):
    """Rows (start, length, period): maximal stretches of each period, the smallest period of each stretch."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept_words(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def cut_words(text):
    return (text or "").encode().split()


def random_words(rng):
    few, words = rng.choice([1, 2, 3, 10, 50]), []
    while len(words) < rng.randint(0, 120):
        part = [f"w{rng.randrange(few)}" for _ in range(rng.randint(1, 12))]
        words += (part * rng.randint(1, 9))[: rng.randint(1, len(part) * 9)]
    return words


@pytest.mark.parametrize("shortest,times", [(6, 4), (4, 4), (12, 5), (2, 4)])
def test_runs_equal_brute_force(shortest, times):
    rng = random.Random(shortest * times)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randint(0, 5))]
        for words, (n, runs, collapsed) in zip(texts, periodic.of_texts([" ".join(t).encode() for t in texts], shortest, times), strict=True):
            want = brute(words, shortest, times)
            assert n == len(words) and [tuple(r) for r in runs.tolist()] == want
            assert collapsed.decode() == " ".join(kept_words(words, want))


def test_mask_keeps_every_word_of_a_run():
    """k is what any run at least overlaps itself in, and no more."""
    assert periodic.least_overlap(6, 4) == 5
    words = ["x"] * 6  # the shortest run: 5 words of overlap
    (found,) = periodic.of_texts([" ".join(["a", *words, "b"]).encode()], 6, 4)
    assert found[1].tolist() == [[1, 6, 1]] and found[2] == b"a x b"


def test_colliding_hashes_are_noticed(monkeypatch):
    """Where the first hash calls all stretches equal, the runs are still right."""
    plain = periodic.Stretches.same

    def same(self, a, q, n):
        return a >= 0 if self.seed == 1 else plain(self, a, q, n)

    start = periodic.Stretches.__init__
    monkeypatch.setattr(periodic.Stretches, "__init__", lambda self, x, seed: (setattr(self, "seed", seed), start(self, x, seed))[1])
    monkeypatch.setattr(periodic.Stretches, "same", same)
    words = ["p", "a", "b", "c"] + ["x", "y"] * 9 + ["a", "b", "c", "p"]
    (found,) = periodic.of_texts([" ".join(words).encode()], 6, 4)
    assert [tuple(r) for r in found[1].tolist()] == brute(words)


def test_hard_texts():
    """All words equal, two words in turn, long periods, Fibonacci words: no run is lost, none is found twice."""
    fib = ["a", "ab"]
    while len(fib[-1]) < 5_000:
        fib.append(fib[-1] + fib[-2])
    texts = [["a"] * 50_000, ["a", "b"] * 20_000 + ["c"], [f"w{i % 5_003}" for i in range(30_000)], list(fib[-1])]
    found = [[tuple(r) for r in runs.tolist()] for _, runs, _ in periodic.of_texts([" ".join(t).encode() for t in texts], 6, 4)]
    assert found[:3] == [[(0, 50_000, 1)], [(0, 40_000, 2)], [(0, 30_000, 5_003)]]
    assert found[3] == brute(texts[3])


def tiled(i, text):
    words, h = cut_words(text), zlib.crc32(("" if i is None else str(i)).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
    return words


def row_of(i, text):
    words = tiled(i, text)
    runs = brute(words)
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    digest = lambda s: hashlib.sha256(s).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, digest(listed), digest(b" ".join(kept_words(words, runs))))


def test_query_equals_brute_force(spark):
    rows = periodic.op11_periodic(spark, DATA).collect()
    assert rows and rows[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in texts if len(cut_words(r.text)) < 1_500}
    assert len(rows) == len(texts) and len(short) > 100
    assert sorted(tuple(r) for r in rows if r.doc_id in short) == sorted(row_of(*d) for d in short.items())
    assert any(r.n_runs and r.doc_id in short and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = periodic.periodic_runs(docs).collect()
    words = {i: len(cut_words(t)) for i, t in ROWS}
    assert sorted(r.n_words for r in rows) == sorted(len(cut_words(t)) for _, t in ROWS)
    assert all(r.n_words == words[r.doc_id] for r in rows if r.doc_id in (1, 3, 4, 5, 6, 8, 9))
    assert {(r.collapsed, len(r.runs)) for r in rows if r.doc_id in (3, 4, 5)} == {("", 0)}
    assert all(r.collapsed == "a text without an id" for r in rows if r.doc_id is None and r.n_words)
    long = next(r for r in rows if r.doc_id == 6)
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 977)] and long.collapsed == " ".join(LONG.split()[:977])
    assert periodic.periodic_runs(empty(spark)).count() == 0 and periodic.repeat_tail(empty(spark)).count() == 0
    named = docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("runs"))
    assert periodic.periodic_runs(named, "name", "runs").columns == ["name", "n_words", "runs", "collapsed"]
    tails = sorted((str(r.doc_id), r.text.encode().split()) for r in periodic.repeat_tail(docs).collect())
    assert tails == sorted((str(i), tiled(i, t)) for i, t in ROWS)
