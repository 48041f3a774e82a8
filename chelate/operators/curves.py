"""Running sums over any number of rows, and curves that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chelate.checkpoints import written


def prefix_sums(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df with ``<name>_sum`` for each of ``sums``: the sum over the rows up to and with each, in the given order.

    Rows are dealt by ranges of the order and summed within each; what stands in earlier ranges, one
    row for each range, is added. So no task holds all rows. The order has to be total, or rows equal
    in it must not matter. Nulls count as 0.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums])
    # a row for each range: n at most
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_part").alias("_of"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"{c}_sum": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).join(F.broadcast(totals), F.col("_part") == F.col("_of"))
    return out.withColumns({f"{c}_sum": F.col(f"{c}_sum") + F.col(f"_{c}") for c in sums}).drop("_part", "_of", *[f"_{c}" for c in sums])


def coverage(predicted: DataFrame, confidence: str, right: str, thresholds: DataFrame | None = None) -> DataFrame:
    """threshold, n_samples, n_correct, coverage, accuracy of the rows whose confidence is at least the threshold.

    At every confidence that occurs, or at each of ``thresholds`` (one column, any number of rows,
    repeated ones once). Rows without a confidence don't count. accuracy is null where no row is left.
    """
    value = F.col(confidence).cast("double")
    rows = predicted.where(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(right).cast("long"), F.lit(0))).alias("c"))
    if thresholds is None:
        asked = rows.withColumn("asked", F.lit(True))
    else:
        # a threshold is a row without samples, after those of the same confidence
        cuts = thresholds.select(F.col(thresholds.columns[0]).cast("double").alias("threshold")).where("threshold IS NOT NULL AND NOT isnan(threshold)").distinct()
        asked = rows.withColumn("asked", F.lit(False)).unionByName(cuts.select("threshold", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), F.lit(True).alias("asked")))
    out = prefix_sums(asked, [F.desc("threshold"), F.col("asked")], ["n", "c"])
    total = F.broadcast(rows.agg(F.sum("n").alias("_total")))
    out = out.where("asked").join(total).select("threshold", F.col("n_sum").alias("n_samples"), F.col("c_sum").alias("n_correct"), "_total")
    return out.select("threshold", "n_samples", "n_correct", (F.col("n_samples") / F.col("_total")).alias("coverage"), (F.col("n_correct") / F.nullif("n_samples", F.lit(0))).alias("accuracy"))
