"""Quality rules against plain counts, expectation-maximisation against a plain one and a known mixture."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from odd import LONG, ROWS, empty, odd_docs
from pyspark.sql import functions as F

from chelate.llm import rules
from conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    """The base measures and whether they fail."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    held = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    counts = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held))
    return (*counts, len(words) < 10 or 100 * len(held) > 20 * len(words))


def more(text):
    """The measures that rules alone use."""
    text = text or ""
    words = WORD.findall(text)
    signs = [m for m in re.finditer(r"([!?#$%&*|<>=~^])\1+", text)]
    return {
        "n_bare": sum(not any(c.isalnum() for c in w) for w in words),
        "n_doubled": len(signs),
        "n_ends": sum(w[-1] in ".!?" for w in words),
        "n_stutter": sum(a == b for a, b in zip(words, words[1:], strict=False)),
        "n_capitals": sum(c.isupper() for c in text if c.isalpha()),
        "n_lines": len([x for x in text.split("\n") if WORD.search(x)]),
    }


def test_measures_equal_plain_counts(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in rules.op13_quality_rules(spark, DATA).collect()}
    assert len(rows) == len(texts)
    assert all(tuple(rows[i][c] for c in (*BASE, "base_failed")) == plain(t) for i, t in texts)
    assert all(not (r.kept and r.base_failed) and r.kept == (not r.base_failed and r.quality >= 0.5) for r in rows.values())
    for r in rules.measures(spark.read.parquet(f"{DATA}/documents.parquet")).collect():
        want = more(dict(texts)[r.doc_id])
        assert {k: r[k] for k in want} == want


def test_windows_of_random_texts(spark):
    """Few words, many repeats, separators that other languages' rules take for space."""
    rng = random.Random(3)
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", " \n \n"]
    texts = ["".join(rng.choice(["a", "b", "x y", " ", "c$", "|"][: rng.randint(1, 6)]) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["\n".join(["a b", "", " ", "a b", "a b ", "a b"]), "a b c d e", "a b c d e " * 2, " " * 5_000 + "a"]
    rows = rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert sorted((r.doc_id, *(r[c] for c in (*BASE, "base_failed"))) for r in rows) == [(i, *plain(t)) for i, t in enumerate(texts)]


def test_colliding_hashes_are_told_apart(spark):
    """Steps with one hash for all windows still tell different windows apart where equal ones stand together."""
    words = spark.createDataFrame([(list("abcdefghijkl"),), (list("aaaaaaaaaa"),)], "words array<string>")
    steps = rules.repeated_words("words")
    steps[0] = {"hashes": re.sub(r"xxhash64\(.*?\)\)", "7L)", steps[0]["hashes"])}
    for step in steps:
        words = words.withColumns({k: F.expr(v) for k, v in step.items()})
    assert [r.n_repeat_words for r in words.collect()] == [0, 10]


def mixture(share, right, n=200_000, seed=5, silent=0.3):
    """Vote patterns of texts whose class is known."""
    rng = np.random.default_rng(seed)
    bad = rng.random(n) < share
    votes = np.stack([np.where(bad, np.where(rng.random(n) < b, 1, -1), np.where(rng.random(n) < g, -1, 1)) for b, g in right], 1)
    votes[rng.random(votes.shape) < silent] = 0
    keys, counts = np.unique(votes, axis=0, return_counts=True)
    return dict(zip(map(tuple, keys.tolist()), counts.tolist(), strict=True))


@pytest.mark.parametrize("false_bad", [0.001, 0.02, 0.05, 0.1])
def test_accuracies_are_recovered(false_bad):
    """Overlapping rules of known accuracy, whose bad votes are wrong this often on good texts."""
    right = [(0.8, 1 - false_bad), (0.7, 1 - false_bad / 2), (0.75, 1 - false_bad), (0.6, 1 - false_bad), (0.85, 1 - 2 * false_bad)]
    model = rules.weigh(mixture(0.15, right))
    assert model.share == pytest.approx(0.15, abs=0.02)
    assert np.allclose(model.right, right, atol=0.02)
    one = [0, 0, 0, 1, 0]
    odds = 0.15 / 0.85 * 0.6 / false_bad
    assert 1 / (1 + np.exp(-model.logit(one))) == pytest.approx(odds / (1 + odds), abs=0.05)


def test_weights_equal_plain_maximisation():
    """The same steps over single texts, not patterns, with arrays."""
    patterns = mixture(0.2, [(0.7, 0.95), (0.8, 0.97), (0.6, 0.9)], 3_000)
    v = np.array([k for k, n in patterns.items() for _ in range(n)])
    p = 1 - 0.2 ** (v == 1).sum(1)
    for _ in range(40):
        share = (p.sum() + 1) / (len(v) + 2)
        bad = ((p[:, None] * (v == 1)).sum(0) + 1) / ((p[:, None] * (v != 0)).sum(0) + 2)
        good = (((1 - p)[:, None] * (v == -1)).sum(0) + 1) / (((1 - p)[:, None] * (v != 0)).sum(0) + 2)
        like = lambda yes, no: np.where(v == 1, yes, np.where(v == -1, no, 1)).prod(1)
        a, b = share * like(bad, 1 - bad), (1 - share) * like(1 - good, good)
        p = a / (a + b)
    model = rules.weigh(patterns, rounds=40)
    assert model.share == pytest.approx(share) and np.allclose(model.right, np.stack([bad, good], 1))


def test_labels_it_never_sees(spark):
    """Against held labels: bad texts go, good ones of ten words and more stay."""
    sf = DATA.replace("0.001", "0.01")
    rows = rules.op13_quality_rules(spark, sf).withColumnRenamed("quality", "score").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    bad, good = [r for r in rows if not r.quality], [r for r in rows if r.quality and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad) and sum(r.kept for r in good) >= 0.98 * len(good)
    # the base rule alone finds far fewer: the votes take effect
    assert sum(not r.base_failed for r in bad if not r.kept) > 0.3 * len(bad)


def test_odd_rows(spark):
    rows = rules.judged(odd_docs(spark)).collect()
    got = sorted((str(r.doc_id), *(r[c] for c in (*BASE, "base_failed"))) for r in rows)
    assert got == sorted((str(i), *plain(t)) for i, t in ROWS)
    assert not any(r.kept for r in rows if not r.n_words)
    assert rules.judged(empty(spark)).count() == 0
    assert rules.weigh({}).right == ()
    clash = spark.createDataFrame([(1, LONG, 0, "x", 0.5)], "doc_id long, text string, n_words int, votes string, quality double")
    assert rules.judged(clash).first().n_words == 60_000


def test_ties_stay(spark, monkeypatch):
    """A probability of exactly one half keeps the text."""
    monkeypatch.setattr(rules, "weigh", lambda patterns: rules.Weighed(0.5, ((0.5, 0.5),) * len(rules.RULES)))
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven.")], "doc_id long, text string")
    (row,) = rules.judged(docs).collect()
    assert row.quality == 0.5 and row.kept
