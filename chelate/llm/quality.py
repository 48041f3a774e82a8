"""Quality classifier from weak labels.

Overlapping heuristics vote bad or good on every document, or abstain between their bars and where
a text is too short to tell. Expectation-maximisation over the counts of vote patterns estimates,
without any label, how often each heuristic's votes are right on bad and on good documents, and so
the patterns' posteriors; no rate is bounded. The posteriors train a linear scorer over hashed
shapes of words, which decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.llm.blocks import number, trim
from chelate.llm.common import small_batches, table
from chelate.llm.rules import Weighed, weigh

#: Documents, chosen by hash, that fit the linear scorer; twice as many at most. Hashed features.
SAMPLE, WIDTH = 8_000, 1 << 14
REJECT = 0.5
#: Bytes of text whose features a worker holds at once.
BLOCK_BYTES = 1 << 20
#: Words that a short text is taken to have besides its own: it needs clear evidence against it.
FEW = 8
#: Of each heuristic: up to which measure it votes good, and from which bad. Several look for one fault in different ways.
HEURISTICS = (
    ("repeats", 0.03, 0.15),
    ("tables", 0.02, 0.10),
    ("bare", 0.02, 0.10),
    ("symbols", 0.02, 0.10),
    ("marks", 0.05, 0.25),
    ("shouts", 0.05, 0.30),
    ("capitals", 0.10, 0.30),
    ("sameness", 0.50, 0.70),
    ("lines", 0.05, 0.30),
    ("lengths", 2.00, 3.50),
)
#: Words and lines from which a text is measured, and from which sameness and lengths are.
ENOUGH_WORDS, ENOUGH_LINES, MORE_WORDS = 5, 3, 20
BARE = re.compile(rb"[A-Za-z0-9\x80-\xff]")
MARK = re.compile(rb"[#$%&*=~^_+<>|]$|[!?]{2}$")
#: Bytes that aren't capitals.
LOWER = bytes(c for c in range(256) if not 65 <= c <= 90)
SYMBOLS = re.compile(rb"[#$%&*!?=~^_+<>|]{2,}")
RUNS = re.compile(rb"([A-Z])[A-Z]+|([a-z])[a-z]+|([0-9])[0-9]+|([\x80-\xff])[\x80-\xff]+|([^A-Za-z0-9\x80-\xff])\5+")


def shape(word: bytes) -> bytes:
    """Runs of capitals, small letters, digits, other letters and repeated signs, each as one or two characters."""
    kind = lambda c: b"A" if c.isupper() else b"a" if c.islower() else b"0" if c.isdigit() else b"u" if c[0] > 127 else c
    return RUNS.sub(lambda m: kind(m[0][:1]) * 2, word)


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= BLOCK_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


@dataclass
class Measured:
    seq: np.ndarray
    lens: np.ndarray
    words: list[bytes]
    owner: np.ndarray
    same: np.ndarray


def measure(texts: list[bytes | None]) -> Measured:
    seq, lens, words = number(texts, lower=False)
    owner = np.repeat(np.arange(len(lens)), lens)
    same = np.zeros(len(seq), bool)
    same[1:] = (seq[1:] == seq[:-1]) & (owner[1:] == owner[:-1])
    return Measured(seq, lens, words, owner, same)


#: What a word alone tells, each a bit.
OF_WORD = {
    "tables": lambda w: len(w) == 1 and w in b"|;\\/-=+*",
    "bare": lambda w: BARE.search(w) is None,
    "symbols": lambda w: SYMBOLS.search(w) is not None,
    "marks": lambda w: MARK.search(w) is not None,
    "shouts": lambda w: len(w) > 2 and w.isupper(),
}


def marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, its bits of OF_WORD and its capitals; words of small ASCII letters, as most are, have none."""
    bits, capitals = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        if not (w.islower() and w.isalpha()):
            bits[i] = sum(1 << j for j, f in enumerate(OF_WORD.values()) if f(w))
            capitals[i] = len(w.translate(None, LOWER))
    return bits, capitals


def votes(texts: list[bytes | None], m: Measured) -> np.ndarray:
    """1 bad, -1 good, 0 abstains: rows are texts, columns HEURISTICS."""
    rows, some = len(texts), np.maximum(m.lens, 1)
    share = lambda flags: np.bincount(m.owner, flags, rows) / some
    pairs = np.unique((m.owner.astype(np.uint64) << np.uint64(32)) | m.seq.astype(np.uint64))
    distinct = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=rows) / some
    lines = [[x for x in (t or b"").split(b"\n") if x.strip()] for t in texts]
    n_lines, length = np.array(list(map(len, lines)), np.int64), np.fromiter(map(len, m.words), np.int64, len(m.words))[m.seq]
    letters = np.maximum(np.bincount(m.owner, length, rows), 1)
    bits, capitals = (x[m.seq] for x in marked(m.words))
    measures = {name: share(bits >> j & 1) for j, name in enumerate(OF_WORD)} | {
        "repeats": share(m.same),
        "capitals": np.bincount(m.owner, capitals, rows) / letters,
        "sameness": 1 - distinct,
        "lines": np.array([1 - len(set(x)) / len(x) if x else 0 for x in lines]),
        "lengths": np.abs(share(length) - 5.2),
    }
    values = np.stack([measures[name] for name, _, _ in HEURISTICS], 1)
    found = (values >= np.array([bad for _, _, bad in HEURISTICS])).astype(int) - (values <= np.array([good for _, good, _ in HEURISTICS]))
    least = {"sameness": MORE_WORDS, "lengths": MORE_WORDS}
    told = np.stack([n_lines >= ENOUGH_LINES if name == "lines" else m.lens >= least.get(name, ENOUGH_WORDS) for name, _, _ in HEURISTICS], 1)
    return np.where(told, found, 0)


def features(m: Measured, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight): hashed words, shapes, pairs of shapes and repeats, each as its share of the text's words and FEW more."""
    shapes = [shape(w) for w in m.words]
    of = lambda kind, names: np.fromiter((xxhash.xxh3_64_intdigest(n, kind) % width for n in names), np.int64, len(names))[m.seq]
    s = of(2, shapes)
    before = np.where(m.same, 1, 0)
    before[1:] += np.where(m.owner[1:] == m.owner[:-1], s[:-1] + 2, 0)
    pair = ((s * 31 + before) * 2654435761 >> 7) % width
    repeat = np.where(m.same, xxhash.xxh3_64_intdigest(b"same", 3) % width, xxhash.xxh3_64_intdigest(b"new", 3) % width)
    all_of = np.concatenate([of(1, [w.lower() for w in m.words]), s, pair, repeat])
    key, n = np.unique(np.tile(m.owner, 4) * width + all_of, return_counts=True)
    text = key // width
    return text, key % width, n / (m.lens + FEW)[text]


def posteriors(patterns: dict[tuple[int, ...], int]) -> tuple[dict[tuple[int, ...], float], Weighed]:
    """P(bad) of each vote pattern, and what expectation-maximisation found out of the heuristics."""
    model = weigh(patterns)
    return {k: 1 / (1 + math.exp(-max(-700.0, min(700.0, model.logit(k))))) for k in patterns}, model


def fit(text: np.ndarray, feature: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, rounds: int = 250, rate: float = 50.0, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic weights by full gradients with momentum."""
    w, b, mw, mb = np.zeros(width), 0.0, np.zeros(width), 0.0
    for _ in range(rounds):
        z = np.bincount(text, x * w[feature], len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / max(len(y), 1)
        mw = 0.9 * mw + np.bincount(feature, x * g[text], width) + decay * w
        mb = 0.9 * mb + g.sum()
        w, b = w - rate * mw, b - rate * mb * 0.1
    return w, b


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    #: P(bad) of each vote pattern
    posterior: dict[tuple[int, ...], float]

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """P(good) of each text."""
        out = []
        for a, z in blocks(texts):
            m = measure(texts[a:z])
            text, feature, x = features(m, len(self.weights))
            logit = np.bincount(text, x * self.weights[feature], z - a) + self.bias
            logit[m.lens == 0] = -self.bias if self.bias > 0 else self.bias  # nothing speaks against an empty text
            out.append(1 / (1 + np.exp(np.clip(logit, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)

    def column(self, text: Column) -> Column:
        @F.arrow_udf("double")
        def p_good(texts: pa.Array) -> pa.Array:
            return pa.array(self.score(texts.to_pylist()), pa.float64())

        return p_good(text.cast("binary"))


def train(docs: DataFrame, sample: int = SAMPLE, width: int = WIDTH) -> QualityModel | None:
    """The classifier of these documents; None of an empty table.

    Vote patterns are counted over all texts. Their number, not the documents', bounds what the
    driver gets: 3 to the power of the heuristics. The scorer fits on about ``sample`` documents,
    chosen by the hash of id and text; copies with one id count once, so the bound holds for them too.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for a, z in blocks(texts):
                found = votes(texts[a:z], measure(texts[a:z]))
                keys, n = np.unique(found, axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({"pattern": [",".join(map(str, k)) for k in keys.tolist()], "n": pa.array(n, pa.int64())})
        trim()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, z in blocks(texts):
                m = measure(texts[a:z])
                text, feature, x = features(m, width)
                cut = np.searchsorted(text, np.arange(1, z - a))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": b.column("key")[a:z],
                        "pattern": [",".join(map(str, k)) for k in votes(texts[a:z], m).tolist()],
                        "feature": [f.astype(np.int32).tobytes() for f in np.split(feature, cut)],
                        "x": [f.astype(np.float32).tobytes() for f in np.split(x, cut)],
                    }
                )
        trim()

    texts = small_batches(docs).select(F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = {tuple(map(int, r.pattern.split(","))): r.n for r in counted}
    total = sum(patterns.values())
    if not total:
        return None
    posterior, _ = posteriors(patterns)
    share = int(min(1.0, sample / total) * (1 << 31))
    key = F.xxhash64("doc_id", "text")
    some = docs.select(key.alias("key"), F.col("text").cast("binary").alias("text")).where(F.pmod("key", F.lit(1 << 31)) <= share)
    rows = some.mapInArrow(describe, "key long, pattern string, feature binary, x binary").dropDuplicates(["key"]).toPandas().sort_values("key")
    feature = [np.frombuffer(f, np.int32) for f in rows["feature"]]
    text = np.repeat(np.arange(len(rows)), [len(f) for f in feature])
    y = np.array([posterior.get(tuple(map(int, p.split(","))), 0.0) for p in rows["pattern"]])
    if not len(rows):
        return QualityModel(np.zeros(width), -5.0, posterior)
    weights, bias = fit(text, np.concatenate(feature), np.concatenate([np.frombuffer(v, np.float32) for v in rows["x"]]).astype(float), y, width)
    return QualityModel(weights, bias, posterior)


def classify(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """One row per input row: doc_id, score (P(good)), kept.

    Trained on the same table without labels. kept: score above ``reject``. A null text is empty,
    and an empty text is kept: no heuristic has anything to vote on. Rows repeated score alike;
    an empty table gives an empty result; other columns aren't read.
    """
    model = train(docs)
    score = model.column(F.col("text")) if model else F.lit(1.0)
    return docs.select("doc_id", score.alias("score")).withColumn("kept", F.col("score") > reject)


def drop_bad(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """docs without the rows that the classifier rejects; columns, whatever their names, stay as they are.

    A null text counts as empty, and empty ones stay. A score of exactly ``reject`` is rejected. Rows
    repeated, with or without an id, fare alike; a very long text is scored whole; an empty table gives
    an empty result. Rows pass through in small batches with their texts, so that none waits for a score.
    """
    model = train(docs)
    if model is None:
        return docs
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                good = model.score(b.column(text).cast(pa.binary()).to_pylist()) > reject
                yield b.filter(pa.array(good, pa.bool_()))
        trim()

    return docs.mapInArrow(keep, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}  # trained: the tests hold it against the labels it never sees
