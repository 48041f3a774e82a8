"""The tools' reports against plain loops over the records."""

import random
from collections import Counter

import pytest

from chelate import schema
from chelate.operators import reports, tool_reports


def made(n=600, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        metal, cn = rng.choice(["Fe", "Ni", "Pt", "", None]), rng.choice([4, 5, 6, None])
        donor = rng.choice(["N", "N", "O", "Cl", "S", "P", "C"]) if rng.random() < 0.95 else None
        task = rng.choice(["mask_donor", "mask_structure"])
        token = rng.choice(["L", "(", "[", "+", "|", ";", "x"])
        target = donor if task == "mask_donor" else token
        guesses = rng.sample(["N", "O", "Cl", "S", "P", "C", "L1", "(", "|", "]"], 6)
        if rng.random() < 0.5 and target:
            guesses.insert(0, target)
        if rng.random() < 0.05:
            guesses = []
        topk = [(g, round(1 / (k + 2), 3)) for k, g in enumerate(guesses)]
        top1, top5 = bool(guesses) and guesses[0] == target, target in guesses[:5]
        out.append((f"r{i:04d}", task, top1, top5, donor if task == "mask_donor" else None, token if task != "mask_donor" else None, metal, cn, topk[0][1] if topk else 0.0, topk))
    return out


def frame(spark, rows):
    kind = "id string, task string, correct_top1 boolean, correct_top5 boolean, y_true struct<donor_atom:string,structure_token:string>, `group` struct<metal_element:string,cn:int>, pred struct<top1_prob:double,topk:array<struct<token:string,prob:double>>>"
    assert "correct_top1" in schema.PREDICTION
    return spark.createDataFrame([(i, t, a, b, (d, s), (m, c), (p, k)) for i, t, a, b, d, s, m, c, p, k in rows], kind)


def rate(flags):
    return round(sum(flags) / len(flags), 4)


def tops(labels):
    """Labels by count, then by where they are seen first."""
    return [x for x, _ in Counter(labels).most_common()]


@pytest.mark.parametrize("apart", [False, True])
def test_leaderboard(spark, apart):
    rows, more = made(), made(400, 2)
    report = tool_reports.donor_report(frame(spark, rows), train=frame(spark, more) if apart else None)
    got = {r.method: (r.top1_acc, r.top5_acc, r.n) for r in report["leaderboard"].collect()}
    donors = [r for r in rows if r[1] == "mask_donor"]
    train = [r for r in (more if apart else rows) if r[1] == "mask_donor"]
    whole = tops([r[4] for r in train])
    own = {m: tops([r[4] for r in train if r[6] == m and r[4]]) for m in {r[6] for r in train if r[6]}}
    pair = lambda top: (rate([bool(top(r)) and r[4] is not None and top(r)[0] == r[4] for r in donors]), rate([r[4] is not None and r[4] in top(r)[:5] for r in donors]), len(donors))
    n = len(tool_reports.CANDIDATES)
    assert n == 15
    assert got["model"] == (rate([r[2] for r in donors]), rate([r[3] for r in donors]), len(donors))
    assert got["random"] == (round(1 / n, 4), round(5 / n, 4), len(donors))
    assert got["global_frequency"] == pair(lambda r: whole) and got["conditional_frequency"] == pair(lambda r: own.get(r[6], []))


def test_cards_gains_and_strata(spark):
    rows = made()
    report = tool_reports.donor_report(frame(spark, rows))
    donors = [r for r in rows if r[1] == "mask_donor"]
    good = sorted((r for r in donors if r[2]), key=lambda r: (-r[8], r[0]))[:4]
    partly, bad = [r for r in donors if r[3] and not r[2]][:3], [r for r in donors if not r[3]][:3]
    cards = {r.id: r for r in report["casecards"].collect()}
    assert set(cards) == {r[0] for r in good + partly + bad}
    for status, some in (("correct_top1", good), ("correct_top5", partly), ("failed", bad)):
        for r in some:
            c = cards[r[0]]
            tokens = [t for t, _ in r[9][:5]]
            want = {"correct_top1": 1, "failed": -1}.get(status) or (tokens.index(r[4]) + 1 if r[4] in tokens else -1)
            assert (c.status, c.target_rank, [p.token for p in c.predictions]) == (status, want, tokens)
    gains = {r.label: r for r in report["gain_vs_random"].collect()}
    assert set(gains) == {r[4] for r in donors if r[4]}
    for label, g in gains.items():
        flags = [r[2] for r in donors if r[4] == label]
        assert g.n_samples == len(flags) and g.top1_acc == rate(flags) and g.x_random == pytest.approx(sum(flags) / len(flags) * 15, abs=0.0051)
    assert {r.cn: r.n_samples for r in report["donor_by_cn"].collect()} == Counter(r[7] for r in donors if r[7])


def plain_error(target, guess):
    if guess is None:
        return "empty_prediction"
    if target == "L" and guess.startswith("L"):
        return "ligand_index_confusion"
    if target in tool_reports.BRACKETS and guess in tool_reports.BRACKETS:
        return "bracket_confusion"
    if target in tool_reports.CHARGES:
        return "charge_error"
    return "delimiter_confusion" if target in tool_reports.DELIMITERS else "other"


def test_structure_report(spark):
    rows = made()
    report = tool_reports.structure_report(frame(spark, rows), 20)
    mine = [r for r in rows if r[1] == "mask_structure"]
    wrong = Counter(plain_error(r[5], r[9][0][0] if r[9] else None) for r in mine if not r[2])
    got = {r.error_type: (r["count"], r.rate, r.pct_of_errors) for r in report["error_types"].collect()}
    assert got == {k: (n, round(n / len(mine), 4), round(n / wrong.total(), 4)) for k, n in wrong.items()} and len(got) >= 5
    by = Counter(r[6] for r in mine if r[6])
    assert {r.metal: r.n_samples for r in report["structure_by_metal"].collect()} == {m: n for m, n in by.items() if n >= 20}
    assert {r.label: r.n for r in report["tokens"].collect()} == Counter(r[5] for r in mine)
    none = tool_reports.donor_report(frame(spark, rows).where("id = ''"))
    assert {r.method: (r.top1_acc, r.n) for r in none["leaderboard"].collect()}["model"] == (None, 0) and none["casecards"].count() == none["gain_vs_random"].count() == 0


def test_absent_groups_do_not_count(spark):
    """Null and empty metals are in the whole, but in no stratum and no lift."""
    df = spark.createDataFrame([(m, 4, True, True, False, False) for m in ["Fe"] * 12 + [""] * 12 + [None] * 12], "metal string, cn int, top1 boolean, top5 boolean, base1 boolean, base5 boolean")
    assert [(r.metal, r.n_samples) for r in reports.lift_by_group(df, ["metal", "cn"], "top1", "base1", "top5", "base5").collect()] == [("Fe", 12)]
    assert sorted((r.stratum, r.value, r.n) for r in reports.stratified_accuracy(df, ["metal", "cn"]).collect()) == [("cn", "4", 36), ("metal", "Fe", 12), ("overall", "all", 36)]
