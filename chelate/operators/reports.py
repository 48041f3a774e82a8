"""Stratified evaluation of predictions and the report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chelate.operators.datasets import digest_rank

MIN_SUPPORT = 10


def half_even(c: Column, digits: int) -> Column:
    """Round half to even as arrays do; round() and bround() differ on decimal fractions."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def present(c: str) -> Column:
    """A group value that counts: neither null nor empty."""
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def stratified_accuracy(predicted: DataFrame, strata: list[str], right: str = "top1", right_k: str = "top5") -> DataFrame:
    """stratum, value, n, top1_acc, top5_acc: overall and by each column's present values, in one pass of grouping sets."""
    sets = ", ".join(f"({c})" for c in strata)
    which = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in strata)
    value = " ".join(f"WHEN grouping({c}) = 0 THEN cast({c} AS string)" for c in strata)
    q = f"""SELECT CASE {which} ELSE 'overall' END AS stratum, CASE {value} ELSE 'all' END AS value, count(*) AS n,
        avg(cast({right} AS double)) AS top1_acc, avg(cast({right_k} AS double)) AS top5_acc
        FROM {{df}} GROUP BY GROUPING SETS ((), {sets})"""
    return predicted.sparkSession.sql(q, df=predicted).where(present("value"))


def lift_by_group(predicted: DataFrame, keys: list[str], model: str, base: str, model_k: str, base_k: str, least: int = MIN_SUPPORT) -> DataFrame:
    """Model against baseline for each present group with at least ``least`` rows: counts, accuracies and their differences."""
    n = F.count("*")
    for k in keys:
        predicted = predicted.where(present(k))
    s = lambda c: F.sum(F.col(c).cast("long"))
    rows = predicted.groupBy(*keys).agg(n.alias("n_samples"), s(model).alias("model_top1_correct"), s(base).alias("base_top1_correct"), s(model_k).alias("_mk"), s(base_k).alias("_bk")).where(F.col("n_samples") >= least)
    rate = lambda c: F.col(c) / F.col("n_samples")
    delta = rate("model_top1_correct") - rate("base_top1_correct")
    return rows.select(
        *keys,
        "n_samples",
        "model_top1_correct",
        half_even(rate("model_top1_correct"), 6).alias("model_top1_acc"),
        "base_top1_correct",
        half_even(rate("base_top1_correct"), 6).alias("base_top1_acc"),
        half_even(delta, 6).alias("delta_top1"),
        half_even(delta * 100, 2).alias("delta_top1_pp"),
        half_even(rate("_mk"), 6).alias("model_top5_acc"),
        half_even(rate("_bk"), 6).alias("base_top5_acc"),
        half_even(rate("_mk") - rate("_bk"), 6).alias("delta_top5"),
    )


def lift_summary(lift: DataFrame) -> DataFrame:
    """Groups, wins, losses, ties; mean, median and sample deviation of the difference in points."""
    d = F.col("delta_top1_pp")
    return lift.agg(F.count("*").alias("total_groups"), F.count_if(d > 0).alias("model_wins"), F.count_if(d < 0).alias("base_wins"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("mean_delta_pp"), F.percentile(d, F.lit(0.5)).alias("median_delta_pp"), F.stddev_samp(d).alias("std_delta_pp"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin_left, bin_right, bin_center, count, is_positive of equal bins; the last is closed, values outside drop, empty bins stay."""
    width = (high - low) / bins
    at = F.when(F.col(value) == high, bins - 1).otherwise(F.floor((F.col(value) - low) / width)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    left = F.col("bin") * width + low
    return spine.join(F.broadcast(counts), "bin", "left").select(left.alias("bin_left"), (left + width).alias("bin_right"), (left + width / 2).alias("bin_center"), F.coalesce("count", F.lit(0)).alias("count"), (left + width / 2 > 0).alias("is_positive"))


def top_gains(lift: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    return lift.orderBy(F.desc("delta_top1"), *keys).limit(k)


def corrections(predicted: DataFrame, model: str, base: str, confidence: str, tie: list[str], k: int = 30) -> DataFrame:
    """The k rows of highest confidence that the model has right and the baseline wrong."""
    return predicted.where(F.col(model) & ~F.col(base)).orderBy(F.desc(confidence), *tie).limit(k)


def case_cards(predicted: DataFrame, n: int, right: str, right_k: str, confidence: str, tie: list[str]) -> DataFrame:
    """n // 3 rows each of success, partial (right among the first k) and failure; successes by confidence, the others as they come."""
    status = F.when(F.col(right), "success").when(F.col(right_k), "partial").otherwise("failure")
    order = [F.when(F.col("status") == "success", -F.col(confidence)).otherwise(F.lit(0.0)), *map(F.col, tie)]
    ranked = predicted.withColumn("status", status).withColumn("card", F.row_number().over(Window.partitionBy("status").orderBy(*order)))
    return ranked.where(F.col("card") <= n // 3)


def coverage_curve(predicted: DataFrame, confidence: str, right: str, thresholds: list[float]) -> DataFrame:
    """threshold, n_samples, n_correct, coverage, accuracy at confidence >= threshold.

    Rows are counted between neighbouring thresholds in one aggregation, and the counts summed from
    above: as many rows as thresholds are left, however many rows came in. A repeated threshold is
    one row.
    """
    cuts = sorted(set(thresholds))
    bucket = F.lit(0)
    for i, t in enumerate(cuts, 1):
        bucket = F.when(F.col(confidence) >= t, i).otherwise(bucket)
    counts = predicted.where(F.col(confidence).isNotNull()).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.sum(F.col(right).cast("long")).alias("c"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    spine = predicted.sparkSession.createDataFrame([(0, None), *enumerate(cuts, 1)], "b int, threshold double")
    rows = spine.join(F.broadcast(counts), "b", "left")
    rows = rows.select("b", "threshold", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_samples"), F.coalesce(F.sum("c").over(above), F.lit(0)).alias("n_correct"))
    total = F.max("n_samples").over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumn("coverage", F.col("n_samples") / F.nullif(total, F.lit(0))).where("threshold IS NOT NULL")
    return rows.select("threshold", "n_samples", "n_correct", "coverage", (F.col("n_correct") / F.nullif("n_samples", F.lit(0))).alias("accuracy"))


def nearest(df: DataFrame, value: str, target: float, ties: Sequence[str] = ()) -> DataFrame:
    """The row whose value is nearest to target; ties go to the smaller value, then by ``ties`` in turn. Rows without a value come last."""
    return df.orderBy(F.abs(F.col(value) - target).asc_nulls_last(), F.col(value).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]).limit(1)


def label_lift(predicted: DataFrame, label: str, model: str, base: str, candidates: int, least: int = MIN_SUPPORT) -> DataFrame:
    """Accuracy by true label against the baseline, and against a random choice among ``candidates``."""
    acc = lambda c: F.avg(F.col(c).cast("double"))
    return predicted.groupBy(label).agg(F.count("*").alias("n_samples"), acc(model).alias("model_top1_acc"), acc(base).alias("base_top1_acc"), (acc(model) - acc(base)).alias("delta_top1"), (acc(model) * candidates).alias("x_random")).where(F.col("n_samples") >= least)


def by_size_and_overall(predicted: DataFrame, size: str, right: str, right_k: str, least: int = MIN_SUPPORT) -> DataFrame:
    """Counts and accuracies by size, of sizes with at least ``least`` rows, and overall: a rollup."""
    acc = lambda c: F.avg(F.col(c).cast("double"))
    rows = predicted.where(F.col(size).isNotNull()).rollup(size).agg(F.count("*").alias("n_samples"), F.sum(F.col(right).cast("long")).alias("top1_correct"), acc(right).alias("top1_acc"), F.sum(F.col(right_k).cast("long")).alias("top5_correct"), acc(right_k).alias("top5_acc"))
    return rows.where((F.col("n_samples") >= least) | F.col(size).isNull()).withColumn(size, F.coalesce(F.col(size).cast("string"), F.lit("overall")))


def shares(df: DataFrame, group: str) -> DataFrame:
    """group, n, share of all."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def pivot_mean(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    """row and one column for each of the given values, named by a prefix and the value."""
    wide = df.groupBy(row).pivot(column, values).agg(F.avg(measure))
    return wide.select(row, *[F.col(f"`{v}`").alias(f"{column}_{v}") for v in values])


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """step, name, remaining, pct after each filter in turn; one pass, however many filters."""
    passed, counts = F.lit(True), [F.count("*").alias("n0")]
    for i, c in enumerate(steps.values(), 1):
        passed = passed & F.coalesce(c, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n{i}"))
    names = ["start", *steps]
    rows = ", ".join(f"named_struct('step', {i}, 'name', '{n}', 'remaining', n{i})" for i, n in enumerate(names))
    return df.agg(*counts).select("n0", F.expr(f"inline(array({rows}))")).select("step", "name", "remaining", (F.col("remaining") * 100.0 / F.nullif("n0", F.lit(0))).alias("pct"))


def stratified_split(df: DataFrame, strata: list[str], id_col: str, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """df with split: each stratum is dealt by the order of a digest of seed and id."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    ranked = digest_rank(df, strata, key, F.col(id_col))
    at = F.when(F.col("_n") > 1, F.col("_rank") / (F.col("_n") - 1)).otherwise(0.0)  # the percent rank
    out, bound, names = None, 0.0, list(parts)
    for name in names[:-1]:
        bound += parts[name]
        out = F.when(at < bound, name) if out is None else out.when(at < bound, name)
    return ranked.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1])).drop("_rank", "_n")


def success_summary(df: DataFrame, valid: Column) -> DataFrame:
    """total, valid and their ratio; null of an empty table."""
    return df.agg(F.count("*").alias("total"), F.count_if(valid).alias("n_valid")).withColumn("ratio", F.col("n_valid") / F.nullif("total", F.lit(0)))
