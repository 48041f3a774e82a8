"""Quality rules that vote or abstain, weighed by expectation-maximisation, in SQL expressions alone.

Every rule compares one measure of a text with two bars: beyond one it votes bad, beyond the other
good, in between, or where the text is too short to tell, it abstains. The counts of vote patterns
over all texts, at most 3 to the power of the rules, go through expectation-maximisation: it
estimates, without labels, how often each rule's votes are right on bad and on good texts, and the
share of bad ones. A text stays where the posterior probability that it is good reaches a half,
instead of where it passes every rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.llm.common import SPACE, materialise, table

WINDOW = 5
KEEP = 0.5
#: Words below which, and hundredths of repeated words above which, a text fails whatever the votes.
FEWEST, MOST_REPEATED = 10, 20


@dataclass(frozen=True)
class Rule:
    """SQL over the columns of measures(): when there is enough to vote on, and the two kinds of votes."""

    name: str
    enough: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "n_words >= 10", "n_symbols >= 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("bare_signs", "n_words >= 10", "n_bare >= 0.1 * n_words", "n_bare <= 0.02 * n_words"),
    Rule("doubled_signs", "n_words >= 10", "n_doubled >= 0.1 * n_words", "n_doubled <= 0.02 * n_words"),
    Rule("capitals", "word_chars >= 40", "n_capitals >= 0.3 * word_chars", "n_capitals <= 0.1 * word_chars"),
    Rule("repeated_windows", "n_words >= 20", "n_repeat_words >= 0.2 * n_words", "n_repeat_words <= 0.02 * n_words"),
    Rule("repeated_lines", "n_lines >= 3", "n_dup_lines >= 0.3 * n_lines", "n_dup_lines = 0"),
    Rule("stutter", "n_words >= 20", "n_stutter >= 0.1 * n_words", "n_stutter <= 0.02 * n_words"),
    Rule("word_length", "n_words >= 20", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3.5 * n_words AND 8 * n_words"),
    Rule("sentences", "n_words >= 50", "n_ends < 0.01 * n_words", "n_ends BETWEEN 0.03 * n_words AND 0.5 * n_words"),
)


def count_of(pattern: str) -> Column:
    """Characters of the text that the pattern's matches hold."""
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def repeated_words(words: str, size: int = WINDOW) -> list[dict[str, str]]:
    """Steps of columns, the last of which counts the words in windows that a text holds twice or more.

    Windows are sorted by hash, and neighbours of one hash compared word by word. Texts whose
    hashes are all different, as most are, end there.
    """
    hashed = ", ".join(f"{words}[i + {j}]" for j in range(size))
    same = lambda k: f"coalesce(get(by_hash, {k}).h = s.h AND slice({words}, get(by_hash, {k}).i + 1, {size}) = slice({words}, s.i + 1, {size}), false)"
    return [
        {"hashes": f"IF(size({words}) > {size}, transform(sequence(0, size({words}) - {size}), i -> xxhash64({hashed})), cast(array() AS array<bigint>))"},
        {"by_hash": "IF(size(array_distinct(hashes)) < size(hashes), sort_array(transform(hashes, (h, i) -> named_struct('h', h, 'i', i))), null)"},
        {"starts": f"IF(by_hash IS NULL, cast(array() AS array<int>), sort_array(transform(filter(by_hash, (s, k) -> {same('k - 1')} OR {same('k + 1')}), s -> s.i)))"},
        {"n_repeat_words": f"aggregate(transform(starts, (p, k) -> least({size}, coalesce(get(starts, k + 1) - p, {size}))), 0L, (a, x) -> a + x)"},
    ]


def measures(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id and whole numbers that describe its text; null is empty."""
    gap = r"\x20\x09-\x0D"
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("parts", F.split("text", SPACE))
    # only the first and the last part may be empty
    begin = "IF(parts[0] = '', 1, 0)"
    rows = rows.withColumn("words", F.expr(f"slice(parts, 1 + {begin}, greatest(0, size(parts) - {begin} - IF(get(parts, size(parts) - 1) = '', 1, 0)))"))
    rows = rows.withColumns(
        {
            "lines": F.expr(f"filter(split(text, '\\n'), x -> x RLIKE r'[^{gap}]')"),
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": count_of("[#*$%&|<>]+").cast("long"),
            "n_capitals": count_of(r"\p{Lu}+").cast("long"),
            "n_bare": F.regexp_count("text", F.lit(rf"(?<![^{gap}])[^\p{{L}}\p{{N}}{gap}]++(?![^{gap}])")).cast("long"),
            "n_doubled": F.regexp_count("text", F.lit(r"([!?#$%&*|<>=~^])\1++")).cast("long"),
            "n_ends": F.regexp_count("text", F.lit(rf"[.!?](?![^{gap}])")).cast("long"),
            "n_stutter": F.expr("size(filter(words, (w, i) -> w = get(words, i - 1)))").cast("long"),
        }
    )
    for step in repeated_words("words"):
        rows = rows.withColumns({name: F.expr(sql) for name, sql in step.items()})
    lines = {"n_lines": F.size("lines").cast("long"), "n_dup_lines": F.expr("cast(size(lines) - size(array_distinct(lines)) AS bigint)")}
    names = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_bare", "n_doubled", "n_ends", "n_stutter", "n_repeat_words")
    return rows.select("doc_id", *names, *[c.alias(k) for k, c in lines.items()])


def votes(rules: Sequence[Rule]) -> Column:
    """1 bad, -1 good, 0 abstains: one vote of each rule."""
    return F.array(*[F.expr(f"CASE WHEN NOT ({r.enough}) THEN 0 WHEN {r.bad} THEN 1 WHEN {r.good} THEN -1 ELSE 0 END") for r in rules])


@dataclass(frozen=True)
class Weighed:
    """share: of bad texts. right: of each rule, how often its votes are right on bad and on good texts."""

    share: float
    right: tuple[tuple[float, float], ...]

    def logit(self, pattern: Sequence[int]) -> float:
        """The log odds that a text with these votes is bad."""
        return math.log(self.share / (1 - self.share)) + sum(self.weights(j)[v] for j, v in enumerate(pattern) if v)

    def weights(self, j: int) -> dict[int, float]:
        bad, good = self.right[j]
        return {1: math.log(bad / (1 - good)), -1: math.log((1 - bad) / good)}


def weigh(patterns: dict[tuple[int, ...], int], rounds: int = 500) -> Weighed:
    """Expectation-maximisation over vote patterns.

    It starts from what rules are written for: a bad vote is taken to be right four times of five,
    and good votes to tell little, as each rule looks for one fault only. No rate is bounded; one
    more vote of either kind on each class keeps the logarithms finite.
    """
    n_rules = len(next(iter(patterns), ()))
    keys, whole = list(patterns), sum(patterns.values())
    p = [1 - 0.2 ** sum(v == 1 for v in k) for k in keys]
    model = Weighed(0.5, ((0.5, 0.5),) * n_rules)
    for _ in range(rounds):
        mass = sum(patterns[k] * x for k, x in zip(keys, p, strict=True))
        right = []
        for j in range(n_rules):
            count = {(c, v): 1.0 for c in (True, False) for v in (1, -1)}
            for k, x in zip(keys, p, strict=True):
                if k[j]:
                    count[True, k[j]] += patterns[k] * x
                    count[False, k[j]] += patterns[k] * (1 - x)
            right.append((count[True, 1] / (count[True, 1] + count[True, -1]), count[False, -1] / (count[False, 1] + count[False, -1])))
        last, model = model, Weighed((mass + 1) / (whole + 2), tuple(right))
        p = [1 / (1 + math.exp(-max(-700.0, min(700.0, model.logit(k))))) for k in keys]
        if max(abs(a - b) for x, y in zip(((last.share,), *last.right), ((model.share,), *model.right), strict=True) for a, b in zip(x, y, strict=True)) < 1e-9:
            break
    return model


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: float = KEEP) -> DataFrame:
    """One row per input row: doc_id, the measures, votes, quality (probability that it is good), base_failed, kept.

    base_failed: fewer than 10 words, or more than a fifth of them in repeated windows; such texts
    are not kept. Of others, those of quality ``keep`` and above are (ties stay). A null text is
    empty, has no words and fails. Rows repeated, with or without an id, are judged alike; a very
    long text is judged whole; an empty table gives an empty result; other columns, whatever their
    names, are not read. Measures alone are written between the two passes, not texts.
    """
    rows = materialise(measures(docs).withColumn("votes", votes(rules)))
    counted = rows.groupBy("votes").count().collect()
    model = weigh({tuple(r.votes): r["count"] for r in counted})
    each = [f"CASE votes[{j}] WHEN 1 THEN {w[1]!r}D WHEN -1 THEN {w[-1]!r}D ELSE 0D END" for j, w in ((j, model.weights(j)) for j in range(len(model.right)))]
    odds = " + ".join([f"({model.logit(()) if model.right else 0.0!r}D)", *each])
    rows = rows.withColumn("quality", F.expr(f"1 / (1 + exp({odds}))"))
    rows = rows.withColumn("base_failed", F.expr(f"n_words < {FEWEST} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))
    return rows.withColumn("kept", F.expr(f"NOT base_failed AND quality >= {keep}D"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op13_quality_rules": op13_quality_rules}
ORACLES: dict[str, str] = {}  # the verdict is estimated: the tests compare with a plain count of everything
