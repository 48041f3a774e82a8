"""The two tools' whole reports from prediction records: leaderboard, cards, gains, strata, kinds of errors.

A report is a dict of tables by name; each has a row for each group, method, kind or card, and is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chelate.operators.baselines import random_accuracy, ranked_labels, top_lists
from chelate.operators.reports import half_even, present

#: Elements among which a random choice is made.
CANDIDATES = ["C", "N", "O", "S", "P", "F", "Cl", "Br", "I", "Se", "Te", "As", "Si", "B", "H"]
#: Cards of each status, and rows from which a stratum of structures counts.
CARDS = {"correct_top1": 4, "correct_top5": 3, "failed": 3}
LEAST = 50
#: Tokens by kind of error.
BRACKETS, CHARGES, DELIMITERS = ["(", ")", "[", "]", "{", "}"], ["+", "-", "+1", "-1"], ["|", ";", ","]


def flat(predictions: DataFrame, task: str, label: str) -> DataFrame:
    """id, metal, cn, label, top1, top5, conf, topk of one task's records."""
    rows = predictions.where(F.col("task") == task)
    return rows.select("id", F.col("group.metal_element").alias("metal"), F.col("group.cn").alias("cn"), F.col(f"y_true.{label}").alias("label"), F.col("correct_top1").alias("top1"), F.col("correct_top5").alias("top5"), F.col("pred.top1_prob").alias("conf"), F.col("pred.topk").alias("topk"))


def share(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def leaderboard(rows: DataFrame, seq: str, candidates: int, train: DataFrame | None = None) -> DataFrame:
    """method, top1_acc, top5_acc, n: the model, a random choice, the most frequent labels of all, and of the same metal.

    Frequencies come from ``train``, or from the rows themselves. Rows without a metal that was seen
    count as wrong for the last method. An empty table gives null shares.
    """
    train = rows if train is None else train
    whole = top_lists(ranked_labels(train, [], "label", seq), [], "label").withColumnRenamed("topk", "_all")
    known = train.where(present("metal") & present("label"))
    own = top_lists(ranked_labels(known, ["metal"], "label", seq), ["metal"], "label").withColumnRenamed("topk", "_own")  # a row for each metal
    df = rows.join(own, "metal", "left").join(F.broadcast(whole), how="left")
    hit = lambda top: F.get(top, F.lit(0)) == F.col("label")
    rates = {"model": (F.col("top1"), F.col("top5")), "global_frequency": (hit("_all"), F.array_contains("_all", F.col("label"))), "conditional_frequency": (hit("_own"), F.array_contains("_own", F.col("label")))}
    one = df.agg(F.count("*").alias("n"), *[share(c).alias(f"{m}_{k}") for m, two in rates.items() for k, c in zip((1, 5), two, strict=True)])
    row = lambda m, a, b: F.struct(F.lit(m).alias("method"), half_even(a, 4).alias("top1_acc"), half_even(b, 4).alias("top5_acc"), F.col("n").alias("n"))
    out = [row(m, F.col(f"{m}_1"), F.col(f"{m}_5")) for m in rates]
    out.insert(1, row("random", *[F.lit(random_accuracy(candidates, k)) for k in (1, 5)]))
    return one.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def stratum(rows: DataFrame, by: str, least: int = 1) -> DataFrame:
    """by, n_samples, top1_acc, top5_acc of the groups that are present and have enough rows."""
    out = rows.where(present(by)).groupBy(by).agg(F.count("*").alias("n_samples"), share(F.col("top1")).alias("a"), share(F.col("top5")).alias("b"))
    return out.where(F.col("n_samples") >= least).select(by, "n_samples", half_even(F.col("a"), 4).alias("top1_acc"), half_even(F.col("b"), 4).alias("top5_acc"))


def cards(rows: DataFrame, seq: str) -> DataFrame:
    """id, metal, cn, label, predictions, target_rank, status: the surest successes, then the first of those in the top five and of failures."""
    place = F.expr("int(array_position(transform(slice(topk, 1, 5), e -> e.token), label))")
    out = None
    for status, kept, order in (
        ("correct_top1", F.col("top1"), [F.desc("conf"), F.asc(seq)]),
        ("correct_top5", F.col("top5") & ~F.col("top1"), [F.asc(seq)]),
        ("failed", ~F.col("top5"), [F.asc(seq)]),
    ):
        rank = {"correct_top1": F.lit(1), "correct_top5": F.when(place > 0, place).otherwise(F.lit(-1)), "failed": F.lit(-1)}[status]
        best = F.transform(F.slice("topk", 1, 5), lambda e: F.struct(e.token.alias("token"), half_even(e.prob, 4).alias("prob")))
        some = rows.where(kept).orderBy(*order).limit(CARDS[status])
        some = some.select("id", "metal", "cn", "label", best.alias("predictions"), rank.alias("target_rank"), F.lit(status).alias("status"))
        out = some if out is None else out.unionByName(some)
    return out


def gains(rows: DataFrame, candidates: int) -> DataFrame:
    """label, top1_acc, top5_acc, n_samples, random_baseline, x_random of each label."""
    chance = random_accuracy(candidates, 1)
    out = rows.where(present("label")).groupBy("label").agg(F.count("*").alias("n_samples"), share(F.col("top1")).alias("a"), share(F.col("top5")).alias("b"))
    return out.select("label", half_even(F.col("a"), 4).alias("top1_acc"), half_even(F.col("b"), 4).alias("top5_acc"), "n_samples", half_even(F.lit(chance), 4).alias("random_baseline"), half_even(F.col("a") / chance, 2).alias("x_random"))


def donor_report(predictions: DataFrame, seq: str = "id", candidates: int = len(CANDIDATES), train: DataFrame | None = None) -> dict[str, DataFrame]:
    """leaderboard, casecards, gain_vs_random, donor_by_cn; ``seq`` is the order in which records came."""
    rows = flat(predictions, "mask_donor", "donor_atom")
    seen = None if train is None else flat(train, "mask_donor", "donor_atom")
    return {"leaderboard": leaderboard(rows, seq, candidates, seen), "casecards": cards(rows, seq), "gain_vs_random": gains(rows, candidates), "donor_by_cn": stratum(rows, "cn")}


def error_type(label: str = "label", first: str = "first") -> Column:
    """What kind of error a wrong token is; ``first`` is null where nothing was predicted."""
    t, p = F.col(label), F.col(first)
    return (
        F.when(p.isNull(), "empty_prediction")
        .when((t == "L") & p.startswith("L"), "ligand_index_confusion")
        .when(t.isin(BRACKETS) & p.isin(BRACKETS), "bracket_confusion")
        .when(t.isin(CHARGES), "charge_error")
        .when(t.isin(DELIMITERS), "delimiter_confusion")
        .otherwise("other")
    )


def error_types(rows: DataFrame) -> DataFrame:
    """error_type, count, rate of all rows and pct_of_errors, of the wrong ones; rows need label, top1 and first."""
    kind = F.when(~F.coalesce(F.col("top1"), F.lit(False)), error_type())
    counts = rows.groupBy(kind.alias("error_type")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_n"), F.sum(F.when(F.col("error_type").isNotNull(), F.col("count"))).alias("_e"))  # seven rows at most
    out = counts.where("error_type IS NOT NULL").join(F.broadcast(total))
    return out.select("error_type", "count", half_even(F.col("count") / F.col("_n"), 4).alias("rate"), half_even(F.col("count") / F.col("_e"), 4).alias("pct_of_errors"))


def structure_report(predictions: DataFrame, least: int = LEAST) -> dict[str, DataFrame]:
    """cn_stratified, error_types, structure_by_metal, tokens (how often each is the target)."""
    rows = flat(predictions, "mask_structure", "structure_token").withColumn("first", F.get(F.col("topk.token"), F.lit(0)))
    tokens = rows.groupBy("label").agg(F.count("*").alias("n"))
    return {"cn_stratified": stratum(rows, "cn", least), "error_types": error_types(rows), "structure_by_metal": stratum(rows, "metal", least), "tokens": tokens}
