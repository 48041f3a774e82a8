"""Scores of tokens at masked places from a frequency table, what is done with them, and their evaluation.

A scorer is a table (keys, topk array<struct<token, prob>>), best first, so that any model whose
scores are written as such a table takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chelate.functions.strings import is_valid
from chelate.operators.baselines import ranked_labels
from chelate.operators.reports import half_even

#: The tokens of a string's structure.
STRUCTURE = ["(", ")", "[", "]", "{", "}", "<", ">", "|", ";", ",", "+", "-", "=", ":"]


def frequency_scorer(train: DataFrame, keys: list[str], token: str, seq: str) -> DataFrame:
    """keys, topk: each token's share among rows with the same keys, best first; ties as in ranked_labels()."""
    ranked = ranked_labels(train, keys, token, seq)
    lists = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(token).alias("token"), F.col("share").alias("prob")))).alias("l"))
    return lists.select(*keys, F.transform("l", lambda e: F.struct(e.token.alias("token"), e.prob.alias("prob"))).alias("topk"))


def topk_at_masks(df: DataFrame, scorer: DataFrame, keys: list[str], k: int = 5, length: str = "n_tokens") -> DataFrame:
    """df with topk: for each of mask_positions the k best; of a place outside the text, and of keys without scores, none."""
    none = F.array().cast("array<struct<token:string,prob:double>>")
    best = F.slice(F.coalesce("_best", none), 1, k)
    out = F.transform("mask_positions", lambda p: F.when((p >= 0) & (p < F.col(length)), best).otherwise(none))
    return df.join(scorer.withColumnRenamed("topk", "_best"), keys, "left").withColumn("topk", out).drop("_best")


def candidate_probs(topk: str, candidates: list[str]) -> Column:
    """Map of each candidate to its probability; 0 where it has none."""
    table = F.map_from_entries(F.col(topk))
    return F.map_from_arrays(F.array(*map(F.lit, candidates)), F.array(*[F.coalesce(F.try_element_at(table, F.lit(c)), F.lit(0.0)) for c in candidates]))


def allowed_only(topk: Column, allowed: list[str]) -> Column:
    """topk without tokens that aren't allowed, its probabilities divided by their sum where that is above 0."""
    kept = F.filter(topk, lambda e: e.token.isin(allowed))
    total = F.aggregate(kept, F.lit(0.0), lambda s, e: s + e.prob)
    return F.transform(kept, lambda e: F.struct(e.token.alias("token"), F.when(total > 0, e.prob / total).otherwise(e.prob).alias("prob")))


def predict_donors(df: DataFrame, scorer: DataFrame, keys: list[str], allowed: list[str] | None = None, k: int = 5, length: str = "n_tokens") -> DataFrame:
    """df with topk: for each of mask_positions the k best tokens; with ``allowed``, of these elements alone, their probabilities made to add up to 1."""
    if allowed is not None:
        scorer = scorer.withColumn("topk", allowed_only(F.col("topk"), allowed))
    return topk_at_masks(df, scorer, keys, k, length)


def repair_places(tokens: str) -> str:
    """Places of structure tokens and unknown ones, where repair may put another token."""
    names = ", ".join(f"'{t}'" for t in STRUCTURE)
    return f"filter(sequence(0, size({tokens}) - 1), i -> size({tokens}) > 0 AND ({tokens}[i] IN ({names}) OR {tokens}[i] LIKE '[UNK%'))"


def repair_by_scores(df: DataFrame, tokens: str, topk: str, k: int = 5) -> DataFrame:
    """repaired tokens: a valid text stays; else each place in turn takes the first of the k best tokens (array<string>)
    that is another and makes the whole valid.

    A pass that finds nothing changes nothing, so that further passes can't either.
    """
    whole = lambda t: is_valid(f"array_join({t}, '')")
    put = "concat(slice(s, 1, i), array(c), slice(s, i + 2, size(s)))"
    step = f"(s, i) -> coalesce(get(filter(transform(filter(slice({topk}, 1, {k}), c -> c <> s[i]), c -> {put}), t -> {whole('t')}), 0), s)"
    return df.withColumn("repaired", F.expr(f"CASE WHEN {whole(tokens)} THEN {tokens} ELSE aggregate({repair_places(tokens)}, {tokens}, {step}) END"))


def recovery(df: DataFrame, targets: str = "target_tokens", topk: str = "topk", by: str = "cn") -> DataFrame:
    """by (or overall), total_samples, top1_correct, top5_correct and their shares: each masked place counts by itself."""
    pairs = df.select(by, F.explode(F.arrays_zip(F.col(targets).alias("t"), F.col(topk).alias("k"))).alias("p"))
    names = F.transform("p.k", lambda e: e.token)
    hits = pairs.select(by, F.coalesce(F.get(names, F.lit(0)) == F.col("p.t"), F.lit(False)).alias("top1"), F.coalesce(F.array_contains(F.slice(names, 1, 5), F.col("p.t")), F.lit(False)).alias("top5"))
    rows = hits.withColumn(by, F.col(by).cast("string")).rollup(by).agg(F.grouping(by).alias("_all"), F.count("*").alias("total_samples"), F.count_if("top1").alias("top1_correct"), F.count_if("top5").alias("top5_correct"))
    return with_percent(rows.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col(by)).alias(by), "total_samples", "top1_correct", (F.col("top1_correct") / F.col("total_samples")).alias("top1_acc"), "top5_correct", (F.col("top5_correct") / F.col("total_samples")).alias("top5_acc")), ["top1_acc", "top5_acc"])


def with_percent(df: DataFrame, columns: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """df with ``<column>_pct``, 100 times as much at two digits, for the columns that it has, and columns renamed."""
    return df.withColumns({f"{c}_pct": half_even(F.col(c) * 100, 2) for c in columns if c in df.columns}).withColumnsRenamed(names or {})


def in_report(df: DataFrame, by: str = "cn", n: str = "n_samples", low: int = 4, high: int = 8, least: int = 100) -> DataFrame:
    """Rows of ``by`` from low to high with enough samples; the overall row isn't one."""
    return df.where((F.col(by).cast("string") != "overall") & F.col(by).cast("int").between(low, high) & (F.col(n) >= least))


def field_of(token: str) -> Column:
    """Which field of a string a token belongs to."""
    t = F.col(token)
    return F.when(F.contains(t, F.lit("Shape")) | t.startswith("V_"), "Shape").when(F.contains(t, F.lit("trans")) | F.contains(t, F.lit("cis")), "Constraint").when(t.startswith("[") | t.startswith(";"), "Metal").otherwise("Ligand")


def field_accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """field, total, correct, accuracy of labelled tokens; null labels are not counted."""
    rows = df.where(F.col(label).isNotNull()).groupBy(field_of(label).alias("field")).agg(F.count("*").alias("total"), F.count_if(F.col(label) == F.col(predicted)).alias("correct"))
    return rows.withColumn("accuracy", F.col("correct") / F.col("total"))
