"""The probe against a plain loop, and what it draws against the scorer's shares."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chelate.operators.probe import completed, probe_summary, probed, sampled
from chelate.operators.repair import context_scorer

TRAIN = [["{trans:", "L1", ":N}", "|L1=", "N", "|"]] * 6 + [["{trans:", "L2", ":N}", "|L1=", "N", "|"]] * 3 + [["{trans:", "L1", ":N}", "|L1=", "O", "|"]] * 3
ROWS = [(1, ["{trans:", "[MASK]", ":N}", "|L1=", "[MASK]", "|"]), (2, ["{trans:", "L2", ":N}", "|L1=", "[MASK]", "|"]), (3, ["[MASK]", "x"]), (4, ["|L1=", "N", "|"]), (5, []), (6, None)]
SCHEMA = "id long, tokens array<string>"
TARGET = "{trans:L1:N}|L1=N|"


def plain_fill(tokens, lists, rank):
    out = []
    for i, t in enumerate(tokens):
        key = (tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else "")
        known = lists.get(key, [])
        out.append(known[rank] if t == "[MASK]" and rank < len(known) else t)
    return "".join(out)


def plain_syntax(s):
    refs = set(re.findall(r"L(\d+)(?=[:@)])", s.split("|")[0]))
    return bool(s.strip()) and refs <= set(re.findall(r"\|L(\d+)=", s))


def plain_constraint(s, target):
    of = lambda x: set(re.findall(r"\{trans:([^}]+)\}", x))
    return len(of(s) & of(target)) / len(of(target)) if of(target) else float(not of(s))


def test_probe_equals_plain_loop(spark):
    scorer = context_scorer(spark.createDataFrame([(t,) for t in TRAIN], "tokens array<string>"), "tokens")
    lists = {(r.before, r.after): [e.token for e in r.topk] for r in scorer.collect()}
    assert lists["{trans:", ":N}"] == ["L1", "L2"] and lists["|L1=", "|"] == ["N", "O"]
    df = completed(spark.createDataFrame(ROWS, SCHEMA), "id", "tokens", scorer, 3)
    df = probed(df.withColumn("target", F.lit(TARGET)), "outputs", "target")
    rows = {r.id: r for r in df.collect()}
    want = {}
    for i, tokens in ROWS[:-1]:
        outputs = [plain_fill(tokens, lists, k) for k in range(3)]
        want[i] = (plain_syntax(outputs[0]), any(map(plain_syntax, outputs)), plain_constraint(outputs[0], TARGET))
        assert rows[i].outputs == outputs and (rows[i].syntax1, rows[i].syntax5, rows[i].constraint) == want[i]
    total = probe_summary(df.where("id < 6")).first()
    for k, name in enumerate(("syntax1", "syntax5", "constraint")):
        assert total[name] == pytest.approx(sum(w[k] for w in want.values()) / len(want))
    assert probe_summary(df.where("id > 9")).first().n == 0 and rows[6].tokens is None


def test_samples_have_the_scorers_shares(spark):
    scorer = context_scorer(spark.createDataFrame([(t,) for t in TRAIN], "tokens array<string>"), "tokens")
    df = spark.createDataFrame(ROWS[:2], SCHEMA)
    rows = sampled(df, "id", "tokens", scorer, 20_000, 7).select("id", "copy", "output").collect()
    assert len(rows) == 40_000 and len({(r.id, r.copy) for r in rows}) == 40_000
    first = [r.output for r in rows if r.id == 1]
    count = Counter(first)
    for text, share in (("{trans:L1:N}|L1=N|", 0.75 * 0.75), ("{trans:L2:N}|L1=N|", 0.25 * 0.75), ("{trans:L1:N}|L1=O|", 0.75 * 0.25), ("{trans:L2:N}|L1=O|", 0.25 * 0.25)):
        assert count[text] / len(first) == pytest.approx(share, abs=0.01)
    again = sampled(df, "id", "tokens", scorer, 20_000, 7).select("id", "copy", "output").collect()
    assert sorted(again) == sorted(rows)
    other = sampled(df, "id", "tokens", scorer, 20_000, 8).select("id", "copy", "output").collect()
    assert sorted(other) != sorted(rows)
