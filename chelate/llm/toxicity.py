"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the classes of a clause's words: one each for insults, threats, targets,
negation and reported speech. The target's reads from both ends: from the right it marks each word
that a target follows, and with these marks the others, composed to one automaton, read from the
left. It emits each match with what holds around it, so a clause is scored, not a word. The arcs'
weights (the lexicon of insults, threats, and each circumstance) are learned from labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.llm.blocks import number
from chelate.llm.common import id_text, materialise, small_batches, small_join, table
from chelate.llm.quality import blocks

#: Labelled documents that fit the lexicon: about so many, chosen by hash, twice as many at most.
SAMPLE = 20_000
#: Chance that any entry of the lexicon is there by accident.
ACCIDENT = 0.01
STEMS = (4, 5, 6, 7)
PREDICT = 0.7
OTHER, INSULT, HARM, INTENT, TARGET, NEGATION, REPORT = range(7)
CLASSES = 7
WORDS = {
    HARM: "kill hurt beat destroy shoot stab burn crush punch töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    INTENT: "will gonna shall going should must i'll werde wirst soll vais allons voy vamos",
    TARGET: "you your you're yourself he she they them these those du dich dir euch ihr sie tu toi te vous ils usted ustedes ellos",
    NEGATION: "not no never isn't aren't don't nobody neither nicht kein keine nie pas jamais ne nunca ni tampoco",
    REPORT: "said says wrote called claims claimed quote quoted according alleged sagte schrieb nannte dit écrit selon dijo escribió según",
}
KNOWN = {w: kind for kind, words in WORDS.items() for w in words.split()}
#: Words over which a negation, an intent or a target reaches.
REACH = 3
#: What an arc adds to the log odds of its clause, before labels tell, and how firmly that is held: as by so many matches.
#: An insult's arc counts its word's weight; a threat's has one weight alone and one more where it is aimed.
ARCS = {"insult": (1.0, 10.0), "aimed insult": (0.5, 5.0), "threat": (0.0, 2.0), "aimed threat": (3.0, 2.0), "negated": (-1.5, 5.0), "reported": (-1.0, 5.0), "clauses": (0.5, 10.0), "constant": (0.0, 0.1)}
START, PULL = (np.array(x) for x in zip(*ARCS.values(), strict=True))
#: Words whose class a worker keeps.
KEPT = 200_000


def fading(kind: int):
    """A transducer that outputs whether ``kind`` stood among the last REACH words; state: words left."""
    return REACH + 1, lambda s, c: (REACH if c == kind else max(s - 1, 0), s > 0 and c != kind)


def lasting(kind: int):
    """A transducer that outputs whether ``kind`` stood before in the clause."""
    return 2, lambda s, c: (int(s or c == kind), bool(s))


def insult():
    """A transducer that outputs an insult; it needs no state."""
    return 1, lambda s, c: (0, c == INSULT)


def threat():
    """A transducer that outputs harm within reach of an intent; state: words that the intent still reaches."""
    return REACH + 1, lambda s, c: (REACH if c == INTENT else max(s - 1, 0), c == HARM and s > 0)


def compose() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, match, circumstance) by state and class, of the transducers' product.

    A class is a word's, plus CLASSES where a target follows it. match: 0 none, 1 insult, 2 threat.
    circumstance: bits negated 1, reported 2, aimed 4: of an insult, a target on either side; of a
    threat, whose doer stands before it, one behind it. State 0 starts a clause.
    """
    parts = [insult(), threat(), fading(TARGET), fading(NEGATION), lasting(REPORT)]
    states = list(product(*(range(n) for n, _ in parts)))
    at = {s: i for i, s in enumerate(states)}
    to, match, around = (np.zeros((len(states), 2 * CLASSES), np.int16) for _ in range(3))
    for s in states:
        for marked in range(2 * CLASSES):
            ahead, c = divmod(marked, CLASSES)
            steps = [f(x, c) for x, (_, f) in zip(s, parts, strict=True)]
            insulted, threatened, behind, negated, reported = (on for _, on in steps)
            to[at[s], marked] = at[tuple(n for n, _ in steps)]
            match[at[s], marked] = 1 if insulted else 2 if threatened else 0
            around[at[s], marked] = negated + 2 * reported + 4 * (ahead or (behind and insulted))
    return to, match, around


def followed(kind: np.ndarray, clause: np.ndarray) -> np.ndarray:
    """The target's transducer from the right: whether one of the next REACH words of a word's clause is a target."""
    out = np.zeros(len(kind), bool)
    for d in range(1, REACH + 1):
        out[:-d] |= (kind[d:] == TARGET) & (clause[d:] == clause[:-d])
    return out


def features(match: int, around: int, weight: float) -> np.ndarray:
    """What a match puts on each arc of ARCS but the last two."""
    aimed = around >> 2 & 1
    return np.array([weight * (match == 1), aimed * (match == 1), match == 2, aimed * (match == 2), around & 1, around >> 1 & 1], float)


TO, MATCH, AROUND = compose()


def clean(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}«»„“”‘’*_-")


def entries(word: str) -> list[str]:
    """What of a word can stand in the lexicon: itself and, with a mark, its first letters."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)] if word else []


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    #: log-odds of a labelled text, and the probability of one without a match
    prior: float = 0.0
    unmatched: float = 0.1
    #: the weights of ARCS
    arcs: tuple[float, ...] = tuple(START.tolist())
    #: class, weight and end of a clause, of words met before
    seen: dict[bytes, tuple[int, float, bool]] = field(default_factory=dict, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}}

    def kind(self, w: bytes) -> tuple[int, float, bool]:
        """Class and weight of a word, and whether a clause ends after it."""
        if (got := self.seen.get(w)) is None:
            plain = clean(w)
            found = [self.lexicon[e] for e in entries(plain) if e in self.lexicon]
            quoted = w[:1] in b"\"'" or w.startswith("„".encode()) or w.startswith("«".encode())
            got = (INSULT if found else KNOWN.get(plain, REPORT if quoted else OTHER), max(found, default=0.0), w[-1:] in b".!?;:")
            if len(self.seen) < KEPT:
                self.seen[w] = got
        return got

    def matches(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int, float]]]:
        """Of each text, its matches as (clause, match, circumstance, the word's weight)."""
        seq, lens, words = number(texts)
        of = [self.kind(w) for w in words]
        kind, weight, end = (np.array([x[i] for x in of], t) for i, t in enumerate((np.int64, np.float64, bool)))
        k = kind[seq]
        hot = (k == INSULT) | (k == HARM)
        owner = np.repeat(np.arange(len(lens)), lens)
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        some = np.bincount(owner[hot], minlength=len(lens)) > 0
        take = some[owner]  # texts without an insult or harm have no match
        seq, k, owner = seq[take], k[take], owner[take]
        if not len(seq):
            return found
        stop = end[seq]
        fresh = np.ones(len(seq), bool)
        fresh[1:] = stop[:-1] | (owner[1:] != owner[:-1])
        clause = np.cumsum(fresh)
        first = np.zeros(len(lens), np.int64)
        first[owner[::-1]] = clause[::-1]
        marked = k + CLASSES * followed(k, clause)
        state = 0
        for i, (w, c, new) in enumerate(zip(seq.tolist(), marked.tolist(), fresh.tolist(), strict=True)):
            state = 0 if new else state
            if m := MATCH[state, c]:
                found[owner[i]].append((int(clause[i] - first[owner[i]]), int(m), int(AROUND[state, c]), float(weight[w])))
            state = TO[state, c]
        return found

    def heaviest(self, found: list[tuple[int, int, int, float]]) -> tuple[float, np.ndarray]:
        """The weight of a text's heaviest clause, and what it and the number of clauses put on the arcs; a clause weighs what its best match does."""
        clauses: dict[int, tuple[float, int]] = {}
        each = [features(*m[1:]) for m in found]
        values = [float(x @ np.array(self.arcs[:-2])) for x in each]
        for i, (m, v) in enumerate(zip(found, values, strict=True)):
            if m[0] not in clauses or v > clauses[m[0]][0]:
                clauses[m[0]] = (v, i)
        if not clauses:
            return 0.0, np.zeros(len(ARCS))
        most, i = max(clauses.values(), key=lambda c: (c[0], -c[1]))
        n = sum(v > 0 for v, _ in clauses.values())
        return most, np.concatenate([each[i], [math.log(max(n, 1)), 1.0]])

    def weigh(self, texts: list[bytes | None]) -> np.ndarray:
        """The weight of each text's heaviest clause and the log odds beyond the prior; 0 without a match."""
        out = np.zeros((len(texts), 2))
        for a, z in blocks(texts):
            for i, found in enumerate(self.matches(texts[a:z]), a):
                most, x = self.heaviest(found)
                out[i] = most, x @ np.array(self.arcs)
        return out

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        z = self.weigh(texts)
        odds = np.clip(z[:, 1] + self.prior, -30, 30)
        return np.where(z[:, 0] > 0, np.maximum(self.unmatched, 1 / (1 + np.exp(-odds))), self.unmatched)

    def column(self, text: Column) -> Column:
        @F.arrow_udf("double")
        def toxic(texts: pa.Array) -> pa.Array:
            return pa.array(self.score(texts.to_pylist()), pa.float64())

        return toxic(text.cast("binary"))


def contexts(wanted: set[str] | None):
    """(entry, toxic, context) of a labelled batch, once each; a context is the words before and after.

    Copies of a text repeat its contexts, so an entry's support counts passages, not copies.
    wanted: of texts that aren't toxic, only these entries matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, toxic = b.column("text").to_pylist(), np.array(b.column("toxic").to_pylist(), np.int64)
            for a, z in blocks(texts):
                seq, lens, words = number(texts[a:z])
                flag = np.repeat(toxic[a:z], lens)
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[seq]
                first = np.zeros(len(seq), bool)
                first[(np.cumsum(lens) - lens)[lens > 0]] = True
                before = np.where(first, 0, np.roll(h, 1)).astype(np.uint64)
                after = np.where(np.roll(first, -1), 0, np.roll(h, -1)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    around = (before * np.uint64(3) + after * np.uint64(7)).view(np.int64)
                plain = [clean(w) for w in words]
                of = {i: [e for e in entries(p) if wanted is None or e in wanted] for i, p in enumerate(plain)}
                rows = {(e, f, c) for i, f, c in zip(seq.tolist(), flag.tolist(), around.tolist(), strict=True) for e in of[i]}
                names, flags, where = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_pydict({"entry": pa.array(names, pa.string()), "toxic": pa.array(flags, pa.int64()), "context": pa.array(where, pa.int64())})

    return run


def calibrate(model: ToxicityModel, texts: list[tuple[float, list]], rounds: int = 6) -> ToxicityModel:
    """The model with arcs fitted to labelled texts (toxic, matches), by Newton steps drawn to START as by PULL matches.

    The heaviest clause of a text hangs on the weights, so fitting and choosing take turns.
    """
    y = np.array([t for t, _ in texts])
    for _ in range(rounds):
        at, x = np.array(model.arcs), np.array([model.heaviest(m)[1] for _, m in texts])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ at + model.prior, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(PULL), x.T @ (p - y) + PULL * (at - START))
            at = at - np.clip(step, -1, 1)
            at[0] = max(at[0], 0.05)
        model = replace(model, arcs=tuple(at.tolist()))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: Column | None = None) -> ToxicityModel:
    """Lexicon and weights from labelled documents that aren't held out.

    Repeated labels of an id count by their mean. About ``sample`` ids, chosen by their hash, fit the
    model. An entry is learned when its contexts are toxic so often that, among all entries tried,
    chance would give less than ACCIDENT such. Without toxic labels the lexicon is empty.
    """
    out = held_out if held_out is not None else F.crc32(id_text(F.col("doc_id")).cast("binary")) % 3 == 1
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~out).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("long").alias("toxic"))
    known = materialise(known)
    total = known.count()
    if not total:
        return ToxicityModel()
    share = int(min(1.0, sample / total) * (1 << 31))
    known = materialise(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) <= share))
    rows = small_join(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")), known, "doc_id", "inner")
    rows = materialise(rows.select("doc_id", "text", "toxic").distinct().select("text", "toxic"))  # copies of a labelled row count once
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad:
        return ToxicityModel(prior=math.log(0.5 / (good + 0.5)), unmatched=0.5 / (good + 1))
    rate = (bad + 0.5) / (bad + good + 1)

    schema = "entry string, toxic long, context long"
    support = rows.where("toxic = 1").mapInArrow(contexts(None), schema).distinct().groupBy("entry").count()
    support = materialise(support)
    least = max(4, math.ceil(math.log(max(support.count(), 1) / ACCIDENT) / -math.log(rate))) if rate < 1 else 4
    found = {r.entry: r["count"] for r in support.where(F.col("count") >= least).collect()}  # of the sample
    against = rows.where("toxic = 0").mapInArrow(contexts(set(found)), schema).distinct().groupBy("entry").count().collect()
    neg = {r.entry: r["count"] for r in against}
    odds = math.log((bad + 0.5) / (good + 0.5))
    lexicon = {e: w for e, p in found.items() if (w := math.log((p + 0.5) / (neg.get(e, 0) + 2 * math.sqrt(neg.get(e, 0) + 1) + 0.5)) - odds) > 2 and neg.get(e, 0) * 9 <= p}
    model = ToxicityModel(lexicon, odds)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, toxic = b.column("text").to_pylist(), b.column("toxic").to_pylist()
            for a, z in blocks(texts):
                found = model.matches(texts[a:z])
                # of matches alike in kind and circumstance, the heaviest word of each clause
                best = [{} for _ in found]
                for of, some in zip(best, found, strict=True):
                    for clause, m, around, weight in some:
                        of[clause, m, around] = max(weight, of.get((clause, m, around), 0.0))
                yield pa.RecordBatch.from_pydict({"toxic": pa.array(toxic[a:z], pa.int64()), "m": pa.array([[{"c": c, "m": m, "a": r, "w": w} for (c, m, r), w in of.items()] for of in best], pa.list_(pa.struct([("c", pa.int64()), ("m", pa.int64()), ("a", pa.int64()), ("w", pa.float64())])))})

    told = materialise(rows.mapInArrow(matched, "toxic long, m array<struct<c:long,m:long,a:long,w:double>>"))
    seen = {r.toxic: r.n for r in told.where("size(m) = 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    unmatched = (seen.get(1, 0) + 0.5) / (seen.get(1, 0) + seen.get(0, 0) + 1)
    model = replace(model, unmatched=min(unmatched, 0.5))
    texts = sorted((float(r.toxic), [(x.c, x.m, x.a, x.w) for x in r.m]) for r in told.where("size(m) > 0").collect())  # of the sample
    return calibrate(model, texts) if texts else model


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.7).

    held_out: crc32 of the id as text (null: empty) leaves 1 modulo 3; the labels of other
    documents train, and nothing but its text bears on a document's score. Texts without a match,
    empty and null ones too, get the share of toxic texts among labelled ones without a match.
    Repeated rows score alike; an empty table gives an empty result; other columns aren't read.
    """
    out = F.crc32(id_text(F.col("doc_id")).cast("binary")) % 3 == 1
    model = train(small_batches(docs), labels, sample)
    rows = docs.select("doc_id", out.alias("held_out"), model.column(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}  # trained: the tests hold it against held-out labels
