"""Language-model scoring with a weighted backoff automaton.

States are histories seen in training: pairs of words, words, and the root; a text starts in the
state of its mark. A seen n-gram is an arc out of its history, weighted by its smoothed
probability, into the state of the longest seen history that ends the text so far. A state
without an arc for the next word fails over to its shorter history, whose arcs it enters with the
weight that its unseen words share. A text is scored by one traversal from left to right that
carries the state and adds log-probabilities.

    root:      P(w) = (c(w) - d) / N, unknown: d V / N,   d = (hapaxes + 0.1) / (V + hapaxes + 0.2)
    state h:   P(w|h) = (c(hw) + m(h) P(w|h')) / (c(h) + m(h)),   failure weight m(h) / (c(h) + m(h))

h' is h without its first word; m(h) = scale * c(h)^power follows the growth of a history's
distinct successors with its count. The counts cover all training texts; no n-gram is pruned.
They stay distributed: each block of documents gets just the arcs that its own texts can take.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.llm.blocks import answer, cut, from_planes, mix, planes, slices, trim, words_of
from chelate.llm.common import id_text, materialise, small_batches, table

HEAPS_SCALE, HEAPS_POWER = 1.0, 0.9
#: Hashes of the marks for a text's start and end.
START, END = np.uint64(0x5BD1E995C2B2AE35), np.uint64(0x27D4EB2F165667C5)
ORDERS = 3
#: Bits that tell pairs and triples of words apart: of 10^12 distinct ones, with 56, one in 70,000 shares its count with another. Words keep all 64.
GRAM_BITS = 56
#: Bytes of text in a block: larger ones repeat fewer n-grams, but their arcs must fit a task.
BLOCK_BYTES = 10 << 20
#: Bytes of text whose n-grams one bucket counts, about.
BUCKET_BYTES = 12 << 20


def packed(a: np.ndarray) -> bytes:
    """Sorted or small numbers as compressed planes of their differences or themselves."""
    return len(a).to_bytes(4, "little") + pa.compress(planes(a), "zstd", asbytes=True) if len(a) else b""


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:4], "little") * np.dtype(kind).itemsize
    return from_planes(pa.decompress(data[4:], size, "zstd", asbytes=True), kind) if data else np.zeros(0, kind)


def packed_hashes(sorted_hashes: np.ndarray) -> bytes:
    return packed(np.diff(sorted_hashes, prepend=np.uint64(0)))


def unpacked_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


@dataclass
class Tokens:
    """A block's texts token by token: words, then one end for each text."""

    first: np.ndarray
    lens: np.ndarray
    #: By order: each token's n-gram that ends with it, as a number in the distinct n-grams, and these' hashes, ascending.
    number: list[np.ndarray]
    hashes: list[np.ndarray]
    #: Each token's history one and two words long, as numbers among words and pairs; -1: starts before the text.
    before: list[np.ndarray]

    @staticmethod
    def of(seq: np.ndarray, lens: np.ndarray, hashes: np.ndarray, bits: int = GRAM_BITS) -> Tokens:
        cur = np.insert(hashes[seq], np.cumsum(lens), END)
        lens = lens + 1
        first = np.cumsum(lens) - lens
        prev = np.concatenate([[START], cur[:-1]]).astype(np.uint64)
        prev[first] = START
        pair = mix(prev, cur)
        last = np.concatenate([[START], pair[:-1]]).astype(np.uint64)
        kept = np.uint64((1 << 64) - (1 << (64 - bits)))
        grams = [cur, pair & kept, mix(last, cur) & kept]
        second = np.zeros(len(cur), bool)
        second[first] = True  # a text's first token has no history of two
        found = [np.unique(g if k < 2 else g[~second], return_inverse=True) for k, g in enumerate(grams)]
        number = [n.astype(np.int32) for _, n in found]
        third = np.full(len(cur), -1, np.int32)
        third[~second] = number[2]
        number[2] = third
        before = []
        for k in range(2):
            at = np.concatenate([[-1], number[k][:-1]]).astype(np.int32)
            at[first] = -1
            before.append(at)
        return Tokens(first, lens, number, [h for h, _ in found], before)


@dataclass(frozen=True)
class Smoothing:
    types: int
    hapaxes: int
    n: int
    scale: float
    power: float

    def root(self, count: np.ndarray) -> np.ndarray:
        d = (self.hapaxes + 0.1) / (self.types + self.hapaxes + 0.2)
        return np.where(count > 0, count - d, d * self.types) / self.n

    def share(self, count: np.ndarray) -> np.ndarray:
        """m(h) / (c(h) + m(h)): what a history leaves to its unseen words; without a history, all."""
        m = self.scale * count**self.power
        return np.where(count > 0, m / np.maximum(count + m, 1e-300), 1.0)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.n + 0.1 * (self.types + 1)))


class Automaton:
    """What a block's texts can reach: the root is state 0, then words, then pairs, by number.

    fail and fail_weight (log10) lead from a state to its shorter history. An arc belongs to an
    n-gram; arc (log10 weights by order) is NaN where training has not seen it, to is where it leads.
    """

    def __init__(self, t: Tokens, counts: list[np.ndarray], texts: float, smooth: Smoothing) -> None:
        c1, c2, c3 = counts
        words, pairs = len(c1), len(c2)
        # each distinct n-gram is read where it stands last
        at = [np.zeros(len(c), np.int64) for c in counts]
        for k in range(ORDERS):
            some = np.flatnonzero(t.number[k] >= 0)
            at[k][t.number[k][some]] = some
        h1 = t.before[0][at[1]]  # the history of each pair; -1: the start
        size1 = np.where(h1 >= 0, c1[h1], texts)
        h2 = t.before[1][at[2]]
        p1 = smooth.root(c1)
        p2 = np.where(size1 > 0, c2 / np.maximum(size1, 1) * (1 - smooth.share(size1)), 0) + smooth.share(size1) * p1[t.number[0][at[1]]]
        size2 = c2[h2] if len(h2) else np.zeros(0)
        p3 = np.where(size2 > 0, c3 / np.maximum(size2, 1) * (1 - smooth.share(size2)), 0) + smooth.share(size2) * p2[t.number[1][at[2]]]
        with np.errstate(divide="ignore"):
            self.arc = [np.log10(p1), np.where(c2 > 0, np.log10(p2), np.nan), np.where(c3 > 0, np.log10(p3), np.nan)]
        self.start = 1 + words + pairs
        self.fail = np.zeros(self.start + 1, np.int64)
        self.fail_weight = np.zeros(self.start + 1)
        self.fail_weight[1 : 1 + words] = np.log10(smooth.share(c1))
        self.fail[1 + words : self.start] = np.where(c1[t.number[0][at[1]]] > 0, 1 + t.number[0][at[1]], 0)
        self.fail_weight[1 + words : self.start] = np.log10(smooth.share(c2))
        self.fail_weight[self.start] = np.log10(smooth.share(np.array([texts])))[0]
        self.level = np.concatenate([[0], np.ones(words), np.full(pairs, 2), [1]]).astype(np.int8)
        #: The state after a token by its word and pair: the longest history that training has seen.
        self.to = [np.where(c1 > 0, 1 + np.arange(words), 0), np.where(c2 > 0, 1 + words + np.arange(pairs), -1)]

    def follow(self, state: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
        """log10 weight of the step from each state by the token that ends each n-gram: failure arcs until there is an arc."""
        weight, open_ = np.zeros(len(state)), np.arange(len(state))
        state = state.copy()
        while len(open_):
            level = self.level[state[open_]]
            arc = np.select([level == 0, level == 1], [self.arc[0][grams[0][open_]], self.arc[1][grams[1][open_]]], self.arc[2][grams[2][open_]] if len(self.arc[2]) else 0.0)
            there = ~np.isnan(arc)
            weight[open_[there]] += arc[there]
            open_ = open_[~there]
            weight[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
        return weight

    def after(self, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return np.where(self.to[1][pair] >= 0, self.to[1][pair], self.to[0][word])

    def traverse(self, t: Tokens) -> np.ndarray:
        """log10 probability of each text. A state depends on two tokens only, so all texts' steps are taken side by side."""
        after = self.after(t.number[0], t.number[1])
        state = np.concatenate([[self.start], after[:-1]])
        state[t.first] = self.start
        return np.add.reduceat(self.follow(state, t.number), t.first)

    def walk(self, t: Tokens, text: int) -> float:
        """The same of one text, step by step with the state carried."""
        state, total = np.array([self.start]), 0.0
        for i in range(t.first[text], t.first[text] + t.lens[text]):
            grams = [n[i : i + 1] for n in t.number]
            total += float(self.follow(state, grams)[0])
            state = self.after(grams[0], grams[1])
        return total


def requests(buckets: int, limit: int, bits: int):
    """Distinct n-grams of each block with their training counts, sliced by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in cut(batches, "text", limit):
            t = Tokens.of(*words_of(rows, "text"), bits)
            train = np.repeat(np.array([not r["held_out"] for r in rows]), t.lens)
            out: dict[str, list] = {"bucket": [], "block": [], "hashes": [], "counts": []}
            for k, (number, distinct) in enumerate(zip(t.number, t.hashes, strict=True)):
                counts = np.bincount(number[number >= 0], train[number >= 0], len(distinct)).astype(np.uint32)
                at = slices(distinct, buckets)
                for i in np.flatnonzero(np.diff(at)):
                    part = slice(at[i], at[i + 1])
                    for key, v in zip(out, (int(i) * ORDERS + k, block, packed_hashes(distinct[part]), packed(counts[part])), strict=True):
                        out[key].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    return run


def total(key: tuple, asked: pa.Table) -> pa.Table:
    """Corpus counts for each block's hashes; one more row has the bucket's types, hapaxes and tokens."""
    hashes = [unpacked_hashes(x) for x in asked.column("hashes").to_pylist()]
    counts = [unpacked(x, np.uint32).astype(np.float64) for x in asked.column("counts").to_pylist()]
    each, distinct = answer(lambda inverse, n: np.bincount(inverse, n), hashes, counts)
    known = distinct[distinct > 0] if key[0].as_py() % ORDERS == 0 else np.zeros(0)
    out = pa.table(
        {
            "block": pa.array([*asked.column("block").to_pylist(), None], pa.int64()),
            "bucket": pa.array([key[0].as_py()] * (len(each) + 1), pa.int32()),
            "counts": pa.array([*(packed(x.astype(np.uint64)) for x in each), None], pa.binary()),
            "check": pa.array([*(int(h.sum().view(np.int64)) for h in hashes), None], pa.int64()),
            "types": pa.array([None] * len(each) + [len(known)], pa.int64()),
            "hapaxes": pa.array([None] * len(each) + [int((known == 1).sum())], pa.int64()),
            "tokens": pa.array([None] * len(each) + [int(known.sum())], pa.int64()),
        }
    )
    hashes = counts = each = []
    trim()
    return out


def structure(limit: int):
    """One row for each block: its documents and their words."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32())), ("seq", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in cut(batches, "text", limit):
            seq, lens, hashes = words_of(rows, "text")
            yield pa.RecordBatch.from_pydict({"block": [block], "doc_id": [[r["doc_id"] for r in rows]], "held_out": [[r["held_out"] for r in rows]], "lens": [lens], "seq": [packed(seq)], "hashes": [packed(hashes)]}, schema=schema)

    return run, "block long, doc_id array<long>, held_out array<boolean>, lens array<int>, seq binary, hashes binary"


def scorer(smooth: Smoothing, texts: int, bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        counts: list[list] = [[] for _ in range(ORDERS)]
        checks = [0] * ORDERS
        for bucket, check in zip(right.column("bucket").to_pylist(), right.column("check").to_pylist(), strict=True):
            checks[bucket % ORDERS] = (checks[bucket % ORDERS] + check) % (1 << 64)
        for bucket, data in sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True)):
            counts[bucket % ORDERS].append(unpacked(data, np.uint64).astype(np.float64))
        of = [np.concatenate([np.zeros(0), *c]) for c in counts]
        t = Tokens.of(unpacked(row["seq"], np.uint32), np.array(row["lens"], np.int64), unpacked(row["hashes"], np.uint64), bits)
        # the n-grams counted and those of this scan have to be the same: their number and the sum of their hashes
        if [len(c) for c in of] != [len(h) for h in t.hashes] or checks != [int(h.sum()) for h in t.hashes]:
            raise ValueError("the documents changed between two scans; write them to a table first")
        known = of[0][t.number[0]]
        if smooth.n:
            score, base = Automaton(t, of, texts, smooth).traverse(t), np.add.reduceat(smooth.base(known), t.first)
        else:  # no training text: the unknown word has all mass
            score = base = np.zeros(len(t.first))
        out = pa.table(
            {
                "doc_id": pa.array(row["doc_id"], pa.int64()),
                "held_out": pa.array(row["held_out"], pa.bool_()),
                "n_tokens": pa.array(t.lens, pa.int64()),
                "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), t.first), pa.int64()),
                "train_tokens": pa.array(np.full(len(t.lens), smooth.n, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(score),
            }
        )
        row = counts = of = t = known = None
        trim()
        return out

    return run


def score_texts(docs: DataFrame, held_out=None, scale: float = HEAPS_SCALE, power: float = HEAPS_POWER, block_bytes: int = BLOCK_BYTES, gram_bits: int = GRAM_BITS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a condition; the other rows train the model. By default a row is held out where
    crc32 of its id as text (null: empty) is a multiple of 10. Tokens are the text's words with
    A-Z lower-cased, then one end; a null or empty text is one token. base_score: add-0.1 unigrams;
    score: the model; both are log10 probabilities, 0 where nothing trains, and finite always.
    Repeated rows count and are scored each by itself; an empty table gives an empty result; other
    columns aren't read. docs is scanned three times and must return the same rows in each scan.
    gram_bits, up to 64: the bits that tell pairs and triples apart; words, on which the base and the
    known tokens rest, have all 64.
    """
    out = held_out if held_out is not None else F.crc32(id_text(F.col("doc_id")).cast("binary")) % 10 == 0
    rows = small_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(out, F.lit(False)).alias("held_out"))
    # as many buckets as the texts' bytes ask for, so that what one holds doesn't grow
    texts, size = rows.agg(F.count(F.when(~F.col("held_out"), 1)), F.sum(F.octet_length("text"))).first()
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(size or 0) // BUCKET_BYTES))
    asked = rows.mapInArrow(requests(buckets, block_bytes, gram_bits), "bucket int, block long, hashes binary, counts binary")
    given = materialise(asked.groupBy("bucket").applyInArrow(total, "block long, bucket int, counts binary, check long, types long, hapaxes long, tokens long"))
    types, hapaxes, n = (int(x or 0) for x in given.where("block IS NULL").agg(F.sum("types"), F.sum("hapaxes"), F.sum("tokens")).first())
    shape, schema = structure(block_bytes)
    counts = given.where("block IS NOT NULL").select("block", "bucket", "counts", "check")
    return (
        rows.mapInArrow(shape, schema)
        .groupBy("block")
        .cogroup(counts.groupBy("block"))
        .applyInArrow(scorer(Smoothing(types, hapaxes, n, scale, power), texts, gram_bits), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
#: SQL for the base alone; the automaton is held against brute force in the tests.
ORACLES: dict[str, str] = {}
