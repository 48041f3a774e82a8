"""Probe of what a scorer writes at masks: the best tokens, or samples of them, and whether the texts hold together.

Samples are Gumbel maxima keyed by seed, row, copy, place and token, so a rerun or a lost executor
draws the same, and the shares of what is drawn are the scorer's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chelate.functions.strings import constraint_recall, refs_defined

MASK = "[MASK]"
SCORED = "array<struct<pos:int,topk:array<struct<token:string,prob:double>>>>"


def scored(df: DataFrame, id_col: str, tokens: str, scorer: DataFrame) -> DataFrame:
    """df with _scored: the scores (before, after, topk) of each mask by what stands beside it; ids have to be unique."""
    text = lambda d: F.coalesce(F.get(tokens, F.col("_pos") + d), F.lit(""))
    places = F.expr(f"filter(transform({tokens}, (t, i) -> IF(t = '{MASK}', i, null)), i -> i IS NOT NULL)")
    asked = df.select(id_col, tokens, F.explode(places).alias("_pos")).select(id_col, "_pos", text(-1).alias("before"), text(1).alias("after"))
    lists = asked.join(scorer, ["before", "after"]).groupBy(id_col).agg(F.collect_list(F.struct(F.col("_pos").alias("pos"), "topk")).alias("_scored"))
    return df.join(lists, id_col, "left").withColumn("_scored", F.coalesce(F.col("_scored").cast(SCORED), F.array().cast(SCORED)))


def put(tokens: str, chosen: str) -> str:
    """The tokens with ``chosen`` (SQL over x, the mask's scores) at each scored mask; a mask without stays."""
    return f"transform({tokens}, (t, i) -> coalesce(get(transform(filter(_scored, x -> x.pos = i), x -> {chosen}), 0), t))"


def completed(df: DataFrame, id_col: str, tokens: str, scorer: DataFrame, k: int = 5) -> DataFrame:
    """df with outputs: the text with every mask's best token, with every one's second best, and so on to the k-th."""
    ranks = F.array(*[F.array_join(F.expr(put(tokens, f"get(x.topk, {r}).token")), "") for r in range(k)])
    return scored(df, id_col, tokens, scorer).withColumn("outputs", ranks).drop("_scored")


def sampled(df: DataFrame, id_col: str, tokens: str, scorer: DataFrame, copies: int, seed: int = 0) -> DataFrame:
    """A row for each copy: copy and output, every mask with a token drawn with its share among the scored ones."""
    rows = scored(df, id_col, tokens, scorer).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    u = f"(pmod(xxhash64({seed}, {id_col}, copy, x.pos, c.token), 9007199254740992L) + 0.5D) / 9007199254740992D"
    keyed = f"transform(filter(x.topk, c -> c.prob > 0), c -> named_struct('g', ln(c.prob) - ln(-ln({u})), 'token', c.token))"
    return rows.withColumn("output", F.array_join(F.expr(put(tokens, f"array_max({keyed}).token")), "")).drop("_scored")


def probed(df: DataFrame, outputs: str, target: str) -> DataFrame:
    """df with syntax1 and syntax5, whether the first and any output refers to defined ligands only, and constraint, the share of the target's trans constraints in the first."""
    first = f"get({outputs}, 0)"
    return df.withColumns({"syntax1": F.expr(refs_defined(first)), "syntax5": F.expr(f"exists({outputs}, o -> {refs_defined('o')})"), "constraint": F.expr(constraint_recall(first, target))})


def probe_summary(df: DataFrame) -> DataFrame:
    """One row: n, and the means of syntax1, syntax5 and constraint; null of none."""
    return df.agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("syntax1", "syntax5", "constraint")])
