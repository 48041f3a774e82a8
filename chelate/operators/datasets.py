"""Data sets for training and evaluation: limits, mixes, batches, splits, masking kinds, evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chelate.operators.tokens import chance, mask_blocks, mask_random, mask_spans

#: Parts of a digest's range; each is ordered by itself, so no task orders a whole table or stratum.
PARTS = 4_096
#: Characters to a token at most, for the length filter.
CHARS = 2


def first_rows(df: DataFrame, order: str | list[str | Column], limit: int | None = None) -> DataFrame:
    """df in ascending order; without a limit, or with 0, all rows. A filter before it makes the limit count what passed."""
    ordered = df.orderBy(*([order] if isinstance(order, str) else order))
    return ordered.limit(limit) if limit else ordered


def key_summary(df: DataFrame, key: str) -> DataFrame:
    """n rows and n_keys distinct keys."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"))


def only_task(df: DataFrame, task: str, column: str = "task") -> DataFrame:
    return df.where(F.col(column) == task)


def short_texts(df: DataFrame, text: str, max_length: int) -> DataFrame:
    """Rows whose text has fewer characters than CHARS a token of ``max_length``."""
    return df.where(F.length(text) < CHARS * max_length)


def digest_rank(df: DataFrame, keys: list[str], digest: Column, *order: Column) -> DataFrame:
    """Add _rank (from 0, equal for ties) and _n: places within keys in the order of the digest (hex), then ``order``.

    Parts of the digest's range are ranked apart and their counts, PARTS rows to a key, added up.
    """
    part = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * PARTS).cast("int")
    rows = df.withColumns({"_digest": digest, "_part": part})
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, "_n": F.sum("_c").over(whole)}).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_before", "_n")
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rank = F.rank().over(Window.partitionBy(*keys, "_part").orderBy("_digest", *order)) - 1
    rows = rows.withColumn("_inside", rank).join(counts, on)
    return rows.withColumn("_rank", F.col("_before") + F.col("_inside")).drop("_digest", "_part", "_inside", "_before", "_p", *[f"_k_{k}" for k in keys])


def batches(df: DataFrame, id_col: str, size: int, seed: int = 0) -> DataFrame:
    """df with batch: rows shuffled by a digest of seed and id, ``size`` to a batch."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    return digest_rank(df, [], key, F.col(id_col)).withColumn("batch", F.floor(F.col("_rank") / size)).drop("_rank", "_n")


def mixed(first: DataFrame, second: DataFrame, order: str, share: float = 0.8, caps: tuple[int, int] = (10_000, 5_000)) -> DataFrame:
    """The first ``share`` of one table and 1 - ``share`` of the other, in order, each up to its cap, with their origin (0 or 1)."""
    parts = [(df, min(cap, int(df.count() * s + 1e-9))) for df, cap, s in zip((first, second), caps, (share, 1 - share), strict=True)]
    one, two = (df.orderBy(order).limit(n).withColumn("origin", F.lit(i)) for i, (df, n) in enumerate(parts))
    return one.unionByName(two)


def mask_kind(id_col: str, epoch: int) -> Column:
    """block for 30 rows of 100; of the rest, span for 20 of 100, else token."""
    u = lambda tag: chance(F.lit(epoch), F.col(id_col), F.lit(tag))
    return F.when(u("block") < 0.3, "block").when(u("span") < 0.2, "span").otherwise("token")


def mask_inputs(df: DataFrame, id_col: str, epoch: int) -> DataFrame:
    """df with kind, masked and labels: each row masked by blocks, spans or tokens; needs tokens and ids of the same length."""
    df = df.withColumn("kind", mask_kind(id_col, epoch))
    one = lambda kind: df.where(F.col("kind") == kind)
    return mask_blocks(one("block")).unionByName(mask_spans(one("span"), id_col, epoch)).unionByName(mask_random(one("token"), id_col, epoch))


def evaluation_set(df: DataFrame, task: str, target: str, order: str, n: int = 5_000) -> DataFrame:
    """id, masked_text, mask_positions, target: the first n samples of a task, in order; rows without an id are named by their place.

    df has id, task, masked_tokens, mask_pos (null: 0) and ``target``. Only n rows are numbered.
    """
    rows = only_task(df, task).orderBy(order).limit(n)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1
    name = {"mask_donor": "donor", "mask_structure": "struct"}[task]
    rows = rows.withColumn("_place", place)
    return rows.select(
        F.coalesce(F.col("id").cast("string"), F.concat(F.lit(f"{name}_"), F.col("_place").cast("string"))).alias("id"),
        F.array_join(F.coalesce("masked_tokens", F.array().cast("array<string>")), "").alias("masked_text"),
        F.array(F.coalesce("mask_pos", F.lit(0))).alias("mask_positions"),
        target,
    )


def pooled_mean(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors (array of arrays) at which the mask is 1; null without any."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda p: p.m == 1)
    total = F.aggregate(kept, F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0)), lambda s, p: F.zip_with(s, p.v, lambda a, b: a + b.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))
