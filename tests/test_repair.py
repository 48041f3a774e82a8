"""Repair by context against a plain loop that scores each place with the tokens that then stand beside it."""

import random
from collections import Counter, defaultdict

import pytest

from chelate.operators import scoring
from chelate.operators.repair import LEFT_INVALID, NO_TOKENS, context_scorer, failure_counts, repair_by_context, repair_evaluation

CLEAN = ["[Metal:", "Fe", "]", "<", "S", ">", "{", "N", "}", "{", "O", "}", "|", "L1=N", "|"]


def balanced(text):
    text = text.strip()
    stack, partner = [], {")": "(", "]": "[", "}": "{", ">": "<"}
    for c in text:
        if c in "([{<":
            stack.append(c)
        elif c in partner and (not stack or stack.pop() != partner[c]):
            return False
    return not stack and len(text) >= 10 and ("[Metal:" in text or "|L" in text)


def plain_scorer(texts, k):
    counts = defaultdict(Counter)
    for t in texts:
        for i, x in enumerate(t):
            counts[t[i - 1] if i else "", t[i + 1] if i + 1 < len(t) else ""][x] += 1
    return {key: [(x, n / sum(c.values())) for x, n in sorted(c.items(), key=lambda e: (-e[1], e[0]))[:k]] for key, c in counts.items()}


def plain_repair(tokens, scorer, k):
    """(tokens, edits)"""
    now, edits = list(tokens or []), []
    if not now or balanced("".join(now)):
        return now, edits
    places = [i for i, t in enumerate(tokens) if t in scoring.STRUCTURE or t.startswith("[UNK")] or list(range(len(tokens)))
    for i in places:
        context = (now[i - 1] if i else "", now[i + 1] if i + 1 < len(now) else "")
        for token, prob in scorer.get(context, [])[:k]:
            if token != now[i] and balanced("".join([*now[:i], token, *now[i + 1 :]])):
                edits.append((i, now[i], token, prob))
                now[i] = token
                break
    return now, edits


def damaged(rng, tokens):
    out = list(tokens)
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(out))
        out[i] = rng.choice([*scoring.STRUCTURE, "[UNK]", "N"])
    return out


@pytest.mark.parametrize("k", [1, 3, 5])
def test_equals_plain_loop(spark, k):
    """Random damage, a scorer of damaged texts too, so that edits follow edits and change each other's scores."""
    rng = random.Random(k)
    train = [damaged(rng, CLEAN) for _ in range(150)] + [CLEAN] * 20
    rows = [damaged(rng, CLEAN) for _ in range(250)] + [["a", "b"], ["[Metal:", "x", "y", "z"], CLEAN]
    scorer = context_scorer(spark.createDataFrame([(t,) for t in train], "tokens array<string>"), "tokens", k)
    plain = plain_scorer(train, k)
    assert {(r.before, r.after): [(e.token, e.prob) for e in r.topk] for r in scorer.collect()} == plain
    df = spark.createDataFrame(list(enumerate(rows)), "id int, tokens array<string>")
    found = {r.id: r for r in repair_by_context(df, "tokens", scorer, k).collect()}
    assert len(found) == len(rows)
    several = 0
    for i, tokens in enumerate(rows):
        want, edits = plain_repair(tokens, plain, k)
        r = found[i]
        assert r.repaired == "".join(want) and [tuple(e) for e in r.edits] == edits and r.tokens == tokens
        assert r.was_valid_before == balanced("".join(tokens)) and r.is_valid_after == balanced(r.repaired)
        assert r.failure_reason == (None if r.is_valid_after else LEFT_INVALID)
        several += any(b[0] == a[0] + 1 for a, b in zip(edits, edits[1:], strict=False))
    assert several  # neighbours were edited one after the other


def test_odd_rows_and_reports(spark):
    broken = [*CLEAN[:5], "|", *CLEAN[6:]]
    rows = [(1, "swap", broken, "".join(CLEAN)), (1, "swap", broken, "".join(CLEAN)), (2, None, None, None), (3, "cut", [], ""), (4, "cut", ["x", "y"], "xy"), (5, "none", CLEAN, "".join(CLEAN))]
    df = spark.createDataFrame(rows, "id int, kind string, tokens array<string>, clean string")
    scorer = context_scorer(spark.createDataFrame([(CLEAN,)], "tokens array<string>"), "tokens")
    out = repair_by_context(df, "tokens", scorer)
    assert sorted(out.columns) == sorted(["id", "kind", "tokens", "clean", "repaired", "was_valid_before", "is_valid_after", "edits", "failure_reason"])
    got = sorted(((r.id, r.repaired, r.failure_reason, len(r.edits)) for r in out.collect()), key=repr)
    clean = "".join(CLEAN)
    assert got == sorted([(1, clean, None, 1), (1, clean, None, 1), (2, None, NO_TOKENS, 0), (3, "", NO_TOKENS, 0), (4, "xy", LEFT_INVALID, 0), (5, clean, None, 0)], key=repr)
    report = {r.kind: r for r in repair_evaluation(out, "clean", "kind").collect()}
    assert report["swap"].uplift == 1.0 and report["swap"].edits == 2 and report["overall"].total == 6 and report["overall"].exact_match == 6
    assert {r.failure_reason: r.n for r in failure_counts(out).collect()} == {NO_TOKENS: 2, LEFT_INVALID: 1}
    assert repair_by_context(df.where("id > 9"), "tokens", scorer).count() == 0
    none = scorer.where("false")
    assert {r.id: r.failure_reason for r in repair_by_context(df, "tokens", none).collect()}[1] == LEFT_INVALID
