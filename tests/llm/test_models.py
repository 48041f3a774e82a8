"""Trained operators, subword encoding, personal data, nearest neighbours and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd import ROWS, empty, odd_docs
from pyspark.sql import functions as F

import corpus_pipeline
from chelate.llm import ann, lm_scoring, pii, quality, subwords, toxicity
from conftest import DATA
from test_tables import brute_components

MORE = "/root/testdata/sf0.01"


def docs_of(spark, folder=MORE):
    return spark.read.parquet(f"{folder}/documents.parquet")


# SentencePiece encoding


@pytest.fixture(scope="module")
def vocabulary():
    return subwords.Vocabulary.load(subwords.default_model())


def test_no_dropout_is_the_library_encoding(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=subwords.default_model())
    docs = docs_of(spark, DATA)
    got = {r.doc_id: list(r.ids) for r in subwords.encode(docs, dropout=0.0).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == sp.encode(r.text)


def test_side_by_side_equals_agenda(vocabulary):
    chunks = [" encoding", " internationalisation", "aaaaaaaaaa", "  x", "\n", " ", " 漢字かな", " don't"]
    for limit in (0, subwords.threshold(0.1), subwords.threshold(0.5)):
        keys = np.arange(len(chunks), dtype=np.uint64) * np.uint64(977)
        ids, n = subwords.merge_all(vocabulary, chunks, keys, limit)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [subwords.agenda(vocabulary, c, int(k), limit) for c, k in zip(chunks, keys, strict=True)]


def test_dropout_varies_and_decodes(spark):
    docs = docs_of(spark, DATA)
    plain, varied, again = (subwords.encode(docs, dropout=d).orderBy("doc_id").collect() for d in (0.0, 0.3, 0.3))
    assert varied == again and sum(r.n_tokens for r in varied) > 1.05 * sum(r.n_tokens for r in plain)
    back = subwords.decode(subwords.encode(docs, dropout=0.3)).join(docs.select("doc_id", "text"), "doc_id")
    assert back.where(~F.col("decoded").eqNullSafe(F.col("text").cast("binary"))).count() == 0
    other = subwords.encode(docs, dropout=0.3, seed=18).orderBy("doc_id").collect()
    assert other != varied


def test_each_occurrence_is_cut_by_itself(spark):
    n, word = 40, "internationalisation"
    docs = spark.createDataFrame([(i, " ".join([word] * n)) for i in range(50)], "doc_id long, text string")
    cuts = {}
    pieces = subwords.Vocabulary.load(subwords.default_model()).bytes
    for r in subwords.encode(docs, check=True).collect():
        parts = b"\0".join(pieces[i] for i in r.ids).split(b" ")[1:]
        assert r.lossless and len(parts) == n
        cuts[r.doc_id] = [p.strip(b"\0") for p in parts]
    assert len({c for some in cuts.values() for c in some}) > 20
    assert all(len(set(some)) > 2 for some in cuts.values()) and len({tuple(some) for some in cuts.values()}) == 50


def test_encoder_equals_agenda(spark, vocabulary):
    texts = [(r.text or "").encode() for r in docs_of(spark, DATA).limit(30).collect()] + [b"", None, "漢字 \ufffd ".encode() * 3 + b"x" * 99 + b" \xff the the the"]
    for most in (0, 10**6):
        encoder = subwords.Encoder(vocabulary, 0.1, 17, most)
        for _ in range(2):  # once with nothing kept, once with what the first call kept
            ids, n = encoder.encode(texts, [str(i) for i in range(len(texts))], [0] * len(texts))
            for i, part in enumerate(np.split(ids, np.cumsum(n)[:-1])):
                chunks = subwords.CHUNK.findall(" " + texts[i].decode("utf-8", "surrogateescape")) if texts[i] else []
                keys = subwords.chunk_keys(np.full(len(chunks), subwords.doc_key(str(i), 0, 17), np.uint64), np.arange(len(chunks)))
                assert part.tolist() == [x for c, k in zip(chunks, keys.tolist(), strict=True) for x in encoder.ids(c, subwords.agenda(vocabulary, c, k, encoder.limit))]


def test_copies_of_the_mix_are_cut_by_themselves(spark):
    docs = spark.createDataFrame([(7, "internationalisation of encodings " * 20)] * 3, "doc_id long, text string")
    rows = corpus_pipeline.encoding_stage(spark, docs, DATA).collect()
    assert len({tuple(r.ids) for r in rows}) == 3 and all(r.lossless for r in rows)


def test_decode_odd_rows(spark):
    """Null and no ids, repeats, an empty table, and a column that has the result's name already."""
    df = subwords.encode(odd_docs(spark)).select("doc_id", F.when(F.col("doc_id") != 9, F.col("ids")).alias("ids"), F.lit("mine").alias("Decoded"))
    out = subwords.decode(df)
    assert out.columns == ["doc_id", "ids", "Decoded", "decoded_"]
    rows = out.select("doc_id", "decoded_", "Decoded").collect()
    want = [(str(i), None if i in (9, None) else (t or "").encode()) for i, t in ROWS]
    assert sorted(((str(r.doc_id), r.decoded_ and bytes(r.decoded_)) for r in rows), key=str) == sorted(want, key=str)
    assert {r.Decoded for r in rows} == {"mine"} and subwords.decode(df.where("false")).count() == 0


def test_encode_odd_rows(spark):
    rows = subwords.encode(odd_docs(spark), check=True).collect()
    assert len(rows) == len(ROWS) and all(r.lossless for r in rows)
    assert all(r.n_tokens == len(r.ids) for r in rows) and [r.n_tokens for r in rows if r.doc_id == 3] == [0]
    assert subwords.encode(empty(spark)).count() == 0
    raw = spark.createDataFrame([(1, bytearray(b"\xff\xfe ab \x00"))], "doc_id long, text binary")
    assert subwords.encode(raw, check=True).first().lossless


# Quality


def test_quality_agrees_with_labels_it_never_sees(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet").where("quality IS NOT NULL")
    rows = quality.classify(docs_of(spark)).join(labels, "doc_id").select("quality", "kept").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows) / len(rows)
    good_kept = sum(r.kept for r in rows if r.quality == 1) / sum(r.quality == 1 for r in rows)
    print("quality", right, good_kept)
    assert right > 0.9 and good_kept > 0.97


def test_quality_odd_rows(spark):
    rows = quality.classify(odd_docs(spark)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.kept for r in rows if r.doc_id in (3, 4, 5))
    assert quality.classify(empty(spark)).count() == quality.drop_bad(empty(spark)).count() == 0
    assert quality.drop_bad(odd_docs(spark)).columns == odd_docs(spark).columns


def test_shapes_of_long_words_differ_at_their_ends():
    assert quality.shape(b"a1" * 40 + b"X") != quality.shape(b"a1" * 40 + b"-")


@pytest.mark.parametrize("false_bad", [0.001, 0.02, 0.05])
def test_accuracies_are_recovered(false_bad):
    """Overlapping labellers of known rates on a mixture: rates, share and posteriors are those of the mixture."""
    rng = np.random.default_rng(3)
    bad = rng.random(100_000) < 0.15
    right = np.array([0.7, 0.8, 0.75, 0.6])
    votes = np.where(rng.random((len(bad), 4)) < np.where(bad[:, None], right, false_bad), 1, -1)
    patterns = Counter(map(tuple, votes.tolist()))
    p, model = quality.posteriors(dict(patterns))
    assert np.allclose(model.right, np.stack([right, np.full(4, 1 - false_bad)], 1), atol=0.02) and abs(model.share - 0.15) < 0.02
    off = 0.0
    for k, n in patterns.items():
        v = np.array(k)
        a, b = (s * np.where(v == 1, r, 1 - r).prod() for s, r in ((0.15, right), (0.85, np.full(4, false_bad))))
        off += n * abs(p[k] - a / (a + b)) / len(bad)
    assert off < 0.01


def plain_votes(text):
    """Each heuristic's vote on a text, by counting."""
    words = (text or b"").split()
    lines = [x for x in (text or b"").split(b"\n") if x.strip()]
    n, letters = max(len(words), 1), max(sum(map(len, words)), 1)
    share = lambda f: sum(map(f, words)) / n
    value = {
        "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "tables": share(lambda w: w in (b"|", b";", b"\\", b"/", b"-", b"=", b"+", b"*")),
        "bare": share(lambda w: not any(c > 127 or chr(c).isalnum() for c in w)),
        "symbols": share(lambda w: re.search(rb"[#$%&*!?=~^_+<>|]{2,}", w) is not None),
        "marks": share(lambda w: w[-1:] in b"#$%&*=~^_+<>|" or w[-2:] in (b"!!", b"??", b"!?", b"?!")),
        "shouts": share(lambda w: len(w) > 2 and w.isupper()),
        "capitals": sum(65 <= c <= 90 for w in words for c in w) / letters,
        "sameness": 1 - len(set(words)) / n,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0,
        "lengths": abs(sum(map(len, words)) / n - 5.2),
    }
    least = {"sameness": quality.MORE_WORDS, "lengths": quality.MORE_WORDS}
    told = lambda name: len(lines) >= quality.ENOUGH_LINES if name == "lines" else len(words) >= least.get(name, quality.ENOUGH_WORDS)
    return tuple((value[h] >= bad) - (value[h] <= good) if told(h) else 0 for h, good, bad in quality.HEURISTICS)


def test_votes_equal_plain_counts(spark):
    texts = [(r.text or "").encode() for r in docs_of(spark).collect()] + [b"", None, b"| | | |", b"A!! B!! C??", "ÄÖ Ü".encode()]
    got = quality.votes(texts, quality.measure(texts))
    assert [tuple(v) for v in got.tolist()] == [plain_votes(t) for t in texts]
    assert all((got[:, j] == v).any() for j in range(len(quality.HEURISTICS)) for v in (-1, 0, 1))


def test_labels_do_not_hang_on_copies(spark):
    """A third of all rows equal, with no id: they are voted on each, and fit the scorer once."""
    base = docs_of(spark).select("doc_id", "text")
    many = base.unionByName(spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy of one line\n" * 30).alias("text")))
    rows = quality.classify(many).collect()
    assert len(rows) == base.count() + 500 and len({r.score for r in rows if r.doc_id is None}) == 1
    again = quality.classify(many).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)


def test_quality_tie_is_rejected(spark, monkeypatch):
    """A score equal to the bar does not pass it."""
    monkeypatch.setattr(quality, "train", lambda docs, *a: quality.QualityModel(np.zeros(16), 0.0, {}))
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    assert [(r.score, r.kept) for r in quality.classify(docs).collect()] == [(0.5, False)] and quality.drop_bad(docs).count() == 0


# LM scoring


def brute_lm(rows):
    tokens = [(i, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]) for i, t in rows]
    out = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in tokens}
    train = [[0, *t] for i, t in tokens if not out[i]]
    count = Counter(tuple(t[j : j + k]) for t in train for k in (1, 2, 3) for j in range(len(t) - k + 1))
    n, words = sum(map(len, train)) - len(train), {g[0]: c for g, c in count.items() if len(g) == 1 and g != (0,)}
    v, hapaxes = len(words), sum(c == 1 for c in words.values())
    gone = (hapaxes + 0.1) / (v + hapaxes + 0.2)

    def p(history, w):
        if not history:
            return ((words[w] - gone) if words.get(w) else gone * v) / n
        seen, shorter = count[history], p(history[1:], w)
        m = lm_scoring.HEAPS_SCALE * seen**lm_scoring.HEAPS_POWER
        return (count[*history, w] + m * shorter) / (seen + m) if seen else shorter

    result = {}
    for i, t in tokens:
        t = [0, *t]
        score = sum(math.log10(p(tuple(t[max(0, j - 2) : j]), t[j])) for j in range(1, len(t)))
        base = sum(math.log10((words.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t[1:])
        result[i] = (out[i], len(t) - 1, sum(words.get(w, 0) > 0 for w in t[1:]), n, base, score)
    return result


def close(got, want):
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-9)


@pytest.mark.parametrize("block,bits", [(2_000, 56), (8 << 20, 56), (8 << 20, 64)])
def test_lm_equals_brute_force(spark, block, bits):
    rows = [(r.doc_id, r.text) for r in docs_of(spark, DATA).select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "never seen zzqx words"), (10**6 + 10, ROWS[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    want = brute_lm(rows)
    got = lm_scoring.score_texts(docs, block_bytes=block, gram_bits=bits).collect()
    assert len(got) == len(rows)
    close(got, want)


def test_lm_words_keep_all_bits():
    """Words whose hashes differ in the last bits alone are told apart, pairs are by the bits asked for."""
    hashes = np.array([0x1234567800000000, 0x1234567800000001], np.uint64)
    t = lm_scoring.Tokens.of(np.array([0, 1, 1]), np.array([3]), hashes, 56)
    assert len(t.hashes[0]) == 3 and set(hashes.tolist()) <= set(t.hashes[0].tolist())
    assert all(h % 256 == 0 for h in t.hashes[1].tolist()) and any(h % 256 for h in lm_scoring.Tokens.of(np.array([0, 1, 1]), np.array([3]), hashes, 64).hashes[1].tolist())


def test_lm_notices_other_texts(spark):
    """As many n-grams, but others, in the scan that scores: an error, not a wrong score."""
    smooth = lm_scoring.Smoothing(3, 1, 5, 1.0, 0.9)
    one, two = (lm_scoring.Tokens.of(*lm_scoring.words_of([{"text": x}], "text")) for x in (b"a b c", b"a b d"))
    right = pa.table({"bucket": pa.array(range(3), pa.int32()), "counts": [lm_scoring.packed(np.ones(len(h), np.uint64)) for h in one.hashes], "check": [int(h.sum().view(np.int64)) for h in one.hashes]})
    for text, ok in ((b"a b c", True), (b"a b d", False)):
        seq, lens, hashes = lm_scoring.words_of([{"text": text}], "text")
        left = pa.table({"block": [0], "doc_id": [[1]], "held_out": [[False]], "lens": pa.array([lens], pa.list_(pa.int32())), "seq": [lm_scoring.packed(seq)], "hashes": [lm_scoring.packed(hashes)]})
        if ok:
            assert lm_scoring.scorer(smooth, 1, 56)(left, right).num_rows == 1
        else:
            with pytest.raises(ValueError):
                lm_scoring.scorer(smooth, 1, 56)(left, right)
    assert len(two.hashes[0]) == len(one.hashes[0])


def test_lm_of_two_texts(spark):
    """All words are hapaxes: the score is finite still."""
    rows = [(0, "a b c"), (6, "c a b")]
    assert len({zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}) in (1, 2)
    out = F.col("doc_id") == 6
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), out).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    close(lm_scoring.score_texts(spark.createDataFrame(rows + [(11, "a b")], "doc_id long, text string")).collect(), brute_lm(rows + [(11, "a b")]))


def test_lm_walk_equals_traversal():
    """The state carried from token to token leads where all steps side by side do, over arcs and failure arcs."""
    texts = [b"a b c a b d", b"a b c", b"x a b", b"", b"c a"]
    t = lm_scoring.Tokens.of(*lm_scoring.words_of([{"text": x} for x in texts], "text"))
    train = np.repeat([True, True, False, True, False], t.lens)
    counts = [np.bincount(n[n >= 0], train[n >= 0], len(h)) for n, h in zip(t.number, t.hashes, strict=True)]
    auto = lm_scoring.Automaton(t, counts, 3, lm_scoring.Smoothing(5, 2, int(train.sum()), 1.0, 0.9))
    assert [auto.walk(t, i) for i in range(len(texts))] == pytest.approx(auto.traverse(t).tolist(), rel=1e-12)
    assert {int(auto.level[s]) for s in auto.after(t.number[0], t.number[1])} == {0, 1, 2}


def test_lm_beats_base_on_held_out(spark):
    r = lm_scoring.score_texts(docs_of(spark)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    print("bits a token", -r.s / r.n / math.log10(2), -r.b / r.n / math.log10(2))
    assert r.s > r.b


def test_lm_odd_rows(spark):
    assert lm_scoring.score_texts(odd_docs(spark)).count() == len(ROWS)
    assert lm_scoring.score_texts(empty(spark)).count() == 0


# Toxicity


def test_toxicity_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    rows = toxicity.score_toxicity(docs_of(spark), labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("toxic", "predicted", "score").collect()
    hit = sum(r.predicted for r in rows if r.toxic)
    wrong = sum(r.predicted for r in rows if not r.toxic)
    print("toxic", hit, wrong, sum(r.toxic for r in rows), len(rows))
    assert wrong <= 0.02 * len(rows)
    assert hit >= 0.5 * sum(r.toxic for r in rows)


def test_words_of_any_length_are_learned(spark):
    long = "q" * 45
    rows = [(i, f"a{i} zz b{i} {long} c{i}" if i % 5 == 0 else f"a{i} plain b{i} words c{i}", int(i % 5 == 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), held_out=F.lit(False))
    assert {"zz", long} <= set(model.lexicon) and not {"plain", "words"} & set(model.lexicon)


THREATS = ["I will kill you", "i am going to kill you tonight", "We will hurt them.", "I will burn your house"]
HARMLESS = ["they will destroy the enemy", "he said: I like you", "you will never hurt", "I will call you", "we will not hurt anybody"]


def test_toxicity_grammar():
    m = toxicity.ToxicityModel({"moron": 6.0}, -2.0, 0.1)
    plain, after, negated, reported, clean = m.weigh([b"you are a moron", b"moron, that you are", b"you are not a moron", b"he said you are a moron", b"you are a friend"])[:, 0]
    assert plain == after > negated > clean == 0 and plain > reported > 0
    assert m.weigh([t.encode() for t in THREATS])[:, 0].tolist() == [3.0] * 4 and (m.weigh([t.encode() for t in HARMLESS])[:, 0] <= 0).all()


def test_threats_are_learned(spark):
    """Labels that hold threats give their arcs a weight: threats score above the bar, other texts as without a match."""
    rng = np.random.default_rng(8)
    common = ["tree", "house", "walk", "today", "the", "a", "of", "river", "green", "talk", "see", "often"]
    some = lambda n: " ".join(rng.choice(common, n))
    parts = [("I", "will", "kill", "you"), ("we", "will", "hurt", "him and you"), ("he", "is going to", "burn", "your house"), ("we", "shall", "shoot", "them")]
    rows = []
    for i in range(400):
        threat = " ".join(parts[i % 4])
        mild = ["they will destroy the enemy", "we will not kill you", "I said he will hurt you", ""][i // 5 % 4]
        rows.append((i, f"{some(8)}. {threat if i % 5 == 0 else mild}. {some(8)}", int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), held_out=F.lit(False))
    arcs = dict(zip(toxicity.ARCS, model.arcs, strict=True))
    assert arcs["aimed threat"] > 3 and arcs["negated"] < -1.5
    bare = toxicity.replace(model, lexicon={})  # the grammar alone
    assert (bare.score([t.encode() for t in THREATS]) > 0.7).all() and (bare.score([t.encode() for t in HARMLESS]) < 0.3).all()


def plain_score(m, text):
    """A score by summing the arcs of each match, clause by clause."""
    w = dict(zip(toxicity.ARCS, m.arcs, strict=True))
    best = {}
    for clause, match, around, weight in m.matches([text])[0]:
        value = weight * w["insult"] + (around >= 4) * w["aimed insult"] if match == 1 else w["threat"] + (around >= 4) * w["aimed threat"]
        value += (around & 1) * w["negated"] + (around >> 1 & 1) * w["reported"]
        best[clause] = max(best.get(clause, -math.inf), value)
    top = max(best.values(), default=0.0)
    if top <= 0:
        return m.unmatched
    z = m.prior + top + w["constant"] + w["clauses"] * math.log(sum(v > 0 for v in best.values()))
    return max(m.unmatched, 1 / (1 + math.exp(-z)))


def test_scores_equal_plain_sums(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    docs = docs_of(spark)
    model = toxicity.train(docs, labels)
    texts = [(r.text or "").encode() for r in docs.limit(300).collect()] + [b" ".join([b"you", list(model.lexicon)[0].rstrip("*").encode(), b"not", b"kill."]) * 3, b"", None]
    assert model.score(texts) == pytest.approx([plain_score(model, t) for t in texts])
    assert len(model.lexicon) > 3 and any(s > 0.7 for s in model.score(texts))


def test_toxicity_tie_is_predicted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: toxicity.ToxicityModel({}, 0.0, 0.7))
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in toxicity.score_toxicity(docs, docs.limit(0)).collect()] == [(0.7, 1)] * 2


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 1), (9, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(odd_docs(spark), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(odd_docs(spark), labels.limit(0)).count() == len(ROWS)
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0


# Personal data

FIXED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_pii(text):
    spans = []
    for k, (kind, pattern) in enumerate(FIXED.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]  # noqa: B023
            if ok():
                spans.append((m.start(), k, m.end(), kind))
    spans.sort()
    return [f"{kind}:{a}:{z}" for a, _, z, kind in spans]


TRICKY = [
    "a@b@c.de x@y..z 1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 01.002.0003.4",
    "4111-1111-1111-1111 4111 1111 1111 1111 4111  1111 1111 1111 41111111111111112 +1 (212) 555-0100. +12 +1234567890123456",
    "😀 é a.b+c%d@sub-domain.example.org, then ++49 30 123456789 and 10.0.0.1:80",
    "-4111111111111111- @a.b a@b a@-.- 12 34 56 78 90 12 34 56 78 +1 +1 +1234567890",
    "",
]


def test_pii_base_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in docs_of(spark).select("doc_id", "text").collect()] + [(10**7 + i, t) for i, t in enumerate([*TRICKY, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(docs).select("doc_id", F.expr(pii.text_of("base")).alias("base"), F.expr(pii.text_of("concat(base, added)")).alias("spans"))
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute_pii(text)
        assert got[i].base == ",".join(want), text
        assert set(want) <= set(got[i].spans.split(",")) or not want


def test_pii_query_and_odd_rows(spark):
    row = pii.op6_pii(spark, DATA).first()
    text = docs_of(spark, DATA).where(F.col("doc_id") == row.doc_id).first().text
    assert row.base_sha256 == hashlib.sha256(",".join(brute_pii(text)).encode()).hexdigest()
    assert pii.personal_data(odd_docs(spark)).count() == len(ROWS)
    assert pii.personal_data(empty(spark)).count() == 0


PLANTED = [
    ("token = \"{h}\" here", "secret", "{h}"),
    ("the api_key: {k}, then", "secret", "{k}"),
    ("write to jane.roe{i} at mail{i}.example dot com today", "email", "jane.roe{i} at mail{i}.example dot com"),
    ("or to jane{i} (at) example [dot] org", "email", "jane{i} (at) example [dot] org"),
    ("call 212-555-01{i:02d} soon", "phone", "212-555-01{i:02d}"),
    ("ssn: 123-45-67{i:02d}.", "ssn", "123-45-67{i:02d}"),
    ("Dear Mrs. Anna Tester, hello", "name", "Mrs. Anna Tester"),
    ("iban DE89370400440532013000 please", "iban", "DE89370400440532013000"),
]
#: What looks alike but is contradicted by its form or edges.
ALIKE = ["see the state-of-the-art-solutions-of-2024 there", "part #000-555-0100x and 012-155-0100", "number 000-45-6789 or 912-45-6789", "DE89370400440532010300 is mistyped"]


def planted():
    rng, out = np.random.default_rng(6), []
    for i in range(60):
        h, k = ("".join(rng.choice(list(abc), 40)) for abc in ("0123456789abcdef", "ABCDEFGHabcdefgh23456789"))
        for text, kind, m in PLANTED:
            values = {"h": "0a" + h[2:], "k": "aA1" + k[3:], "i": i}
            whole = "Lorem ipsum é 😀 " + text.format(**values)
            out.append((len(out), whole, kind, whole.index(m.format(**values)), len(m.format(**values))))
        out += [(len(out) + j, f"{a} {i}", None, 0, 0) for j, a in enumerate(ALIKE)]
    return out


def test_planted_data_is_found(spark):
    rows = planted()
    found = pii.personal_data(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    spans = {r.doc_id: {(x.kind, x.start, x.end) for x in r.added} for r in found}
    kinds = {k for _, _, k, _, _ in rows if k}
    for kind in kinds:
        mine = [r for r in rows if r[2] == kind]
        assert sum((kind, a, a + n) in spans[i] for i, _, _, a, n in mine) > 0.9 * len(mine), kind
    assert not any(spans[r[0]] for r in rows if r[2] is None)


def test_candidates_are_many(spark):
    """The documents hold secrets, which only the wider patterns find."""
    sf = MORE.replace("0.01", "0.1")
    r = pii.personal_data(docs_of(spark, sf)).select(F.explode("added.kind").alias("kind")).groupBy("kind").count().collect()
    assert sum(x["count"] for x in r) >= 100


def test_votes_contradict(spark):
    """A candidate whose labelers disagree goes with the more reliable ones."""
    patterns = {(1, 0, 1, 0): 500, (-1, 0, 0, -1): 300, (-1, 0, 0, 0): 200, (-1, 0, 1, 0): 20, (1, 0, 0, -1): 15, (0, 1, 0, 0): 40}
    p = pii.reliabilities(patterns)
    assert p[1, 0, 1, 0] > 0.95 and p[-1, 0, 0, -1] < 0.05 and p[-1, 0, 0, 0] < 0.1
    w = pii.classifier(patterns, p)
    accepted = {k: sum(a * b for a, b in zip(w, (*k, 1), strict=True)) >= 0 for k in patterns}
    assert accepted[1, 0, 1, 0] and not accepted[-1, 0, 0, -1] and not accepted[-1, 0, 0, 0]


def brute_reliabilities(votes, rounds):
    """The same steps over single candidates, with arrays."""
    v = np.array(votes)
    p = 1 / (1 + np.exp(-1.5 * v.sum(1)))
    for _ in range(rounds):
        log = np.full(len(v), math.log((p.sum() + 1) / (len(v) - p.sum() + 1)))
        for j in range(v.shape[1]):
            of = {(c, s): (q * (v[:, j] == s)).sum() + (4 if (c == 1) == (s == 1) else 1) for c, q in ((1, p), (0, 1 - p)) for s in (1, -1)}
            for s in (1, -1):
                log += (v[:, j] == s) * (math.log(of[1, s] / (of[1, 1] + of[1, -1])) - math.log(of[0, s] / (of[0, 1] + of[0, -1])))
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return p


def test_reliabilities_equal_plain_maximisation():
    rng = np.random.default_rng(2)
    votes = [tuple(v) for v in rng.choice([-1, 0, 1], (400, 4), p=[0.2, 0.4, 0.4]).tolist()]
    p = pii.reliabilities(dict(Counter(votes)), rounds=20)
    assert [p[v] for v in votes] == pytest.approx(brute_reliabilities(votes, 20).tolist())


def test_many_matches_of_one_text(spark):
    """Offsets of more matches than one chunk holds, with wide characters between."""
    text = "".join(f"é😀 {i % 256}.1.2.3 a{i}@b.de\n" for i in range(1_500))
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.expr(pii.text_of("base")).alias("b")).first()
    assert row.b == ",".join(brute_pii(text))


def test_account_numbers_are_checked(spark):
    """Rests of published examples, and of one with two digits exchanged."""
    numbers = {"DE89370400440532013000": 1, "GB82WEST12345698765432": 1, "FR1420041010050500013M02606": 1, "DE89370400440532010300": None}
    for m, want in numbers.items():
        rest = spark.sql(f"SELECT {pii.iban_rest(repr(m))}").first()[0]
        assert rest == int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97
        assert (rest == 1) == (want == 1)


def test_pii_runs_no_python(spark):
    plan = pii.op6_pii(spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Nearest neighbours


def ann_recall(got, ids, x, every=50):
    """Share of the true nearest five that are found, with every score compared."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = {i: k for k, i in enumerate(ids.tolist())}
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in ids[ids % every == 0].tolist():
        near = unit @ unit[at[q]]
        near[at[q]] = -9
        want = set(ids[np.lexsort((ids, -near))[:5]].tolist())
        assert sorted(found[q]) == [1, 2, 3, 4, 5]
        hits += len(want & {v for v, _ in found[q].values()})
        for v, s in found[q].values():
            assert s == pytest.approx(near[at[v]], abs=1e-12)
    return hits / (5 * len(found))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall_and_exact_scores(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    recall = ann_recall(ann.op7_ann(spark, folder).collect(), np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    print("recall", sf, recall)
    assert recall >= 0.9


def test_ann_recall_on_many_clustered_vectors(spark):
    """24,000 vectors in 300 clusters: under a tenth of the entries are visited."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(300, 32))[rng.integers(0, 300, 24_000)] + 0.25 * rng.normal(size=(24_000, 32))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 32)}))
    sample = ann.unit(x[:: len(x) // 10_000].astype(float))
    share = ann.Index.fit(sample, len(x), 5).share
    recall = ann_recall(ann.nearest(df, F.col("vec_id") % 200 == 0).collect(), np.arange(len(x)), x.astype(float), 200)
    print("share", share, "recall", recall)
    assert share < 0.1 and recall >= 0.9


def test_ann_ties_go_to_smaller_ids(spark, monkeypatch):
    """Parallel vectors of several lengths are tied at cosine 1, also over parts."""
    df = spark.createDataFrame([(i, [float(2 ** ((i * 7) % 23)), 0.0]) for i in range(1, 47)] + [(50, [1.0, 0.0]), (100, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for part in (4096, 4):
        monkeypatch.setattr(ann, "PART", part)
        got = [(r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 50).orderBy("rank").collect()]
        assert got == [(i, i, 1.0) for i in range(1, 6)]


def test_ann_odd_vectors(spark):
    v = [(0, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, float("nan"), 0.0]), (7, [None, 1.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (100, [0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, x, None, None, None) for i, x in v], "vec_id long, embedding array<double>, label int, key string, entry string")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (50, 1.0), (0, 3): (2, 0.0), (50, 1): (0, 1.0), (50, 2): (1, 1.0), (50, 3): (2, 0.0)}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ann_repeated_ids(spark):
    """Of an id with several vectors the least counts, once: five ranks a query, each rank once."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    more = [*rows, *[(0, rng.normal(size=8).tolist()) for _ in range(3)], (7, rows[7][1]), (50, None)]
    got = ann.nearest(spark.createDataFrame(more, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    kept = {i: np.array(min(v for j, v in more if j == i and v)) for i in range(120)}
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in (0, 50, 100) for k in range(1, 6)]
    for r in got:
        a, b = kept[r.query_id], kept[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b))) and r.vec_id != r.query_id


def test_cells_come_by_distance():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random(6), rng.random(5)
    order = ann.cells_by_distance(d1, d2, np.ones(30, np.int64), 30)
    assert [d1[c // 5] + d2[c % 5] for c in order] == sorted(a + b for a in d1 for b in d2)


# Pipeline


def test_stages_keep_columns_and_take_effect(spark):
    docs = docs_of(spark, DATA)
    good = corpus_pipeline.quality_stage(spark, docs, DATA)
    assert good.columns == docs.columns
    one = corpus_pipeline.exact_stage(spark, good, DATA)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    kept = {}
    for r in good.orderBy("doc_id").collect():
        kept.setdefault(normal(r.text), r.doc_id)
    assert sorted(r.doc_id for r in one.collect()) == sorted(kept.values())
    near = corpus_pipeline.near_stage(spark, one, DATA)
    brute = brute_components([(r.doc_id, r.text) for r in one.collect()], 5, 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in brute.items() if i == c)
    mixed = corpus_pipeline.mixing_stage(spark, near, DATA)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.where("NOT lossless").count() == 0


def test_stages_on_odd_and_empty_rows(spark):
    for docs in (odd_docs(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, DATA).count()


def test_toxicity_matches_equal_plain_rules():
    """The composed automaton against the rules of its transducers, clause by clause."""
    rng = np.random.default_rng(4)
    m = toxicity.ToxicityModel({"moron": 6.0, "fool*": 4.0}, -2.0, 0.1)
    words = ["you", "are", "a", "moron", "fools", "fooled", "not", "said", "will", "kill", "hurt", "he", "them.", "fine;", "never", "friend", "moron."]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))).encode() for _ in range(300)]

    def plain(text):
        out, clauses = [], [[]]
        for w in text.decode().split():
            c = toxicity.clean(w.encode())
            hit = [m.lexicon[e] for e in toxicity.entries(c) if e in m.lexicon]
            clauses[-1].append((toxicity.INSULT if hit else toxicity.KNOWN.get(c, toxicity.OTHER), max(hit, default=0.0)))
            if w[-1] in ".!?;:":
                clauses.append([])
        for n, clause in enumerate(clauses):
            kinds = [k for k, _ in clause]
            for i, (kind, weight) in enumerate(clause):
                near, ahead = kinds[max(0, i - toxicity.REACH) : i], kinds[i + 1 : i + 1 + toxicity.REACH]
                around = (toxicity.NEGATION in near) + 2 * (toxicity.REPORT in kinds[:i])
                if kind == toxicity.INSULT:
                    out.append((n, 1, around + 4 * (toxicity.TARGET in near + ahead), weight))
                elif kind == toxicity.HARM and toxicity.INTENT in near:
                    out.append((n, 2, around + 4 * (toxicity.TARGET in ahead), 0.0))
        return out

    assert m.matches(texts) == [plain(t) for t in texts]
