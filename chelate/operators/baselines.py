"""Frequency baselines for label prediction, and their accuracy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 5
#: Rows of a block when all pairs of two tables are met.
BLOCK = 4_096


def ranked_labels(df: DataFrame, keys: list[str], label: str, seq: str) -> DataFrame:
    """keys, label, n, share, rank: labels by count within keys; ties go to the label seen first by ``seq``, then by name.

    Counts are combined map-side, so only one row for each key and label is shuffled and ranked.
    """
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    within = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.withColumns({"share": F.col("n") / F.sum("n").over(within), "rank": F.row_number().over(within.orderBy(F.desc("n"), "first_seq", label))}).drop("first_seq")


def top_lists(ranked: DataFrame, keys: list[str], label: str, k: int = TOP) -> DataFrame:
    """keys, topk: the first k labels in rank order."""
    return ranked.where(F.col("rank") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", label))).alias("l")).select(*keys, F.col(f"l.{label}").alias("topk"))


def global_frequency(train: DataFrame, label: str, seq: str, k: int = TOP) -> DataFrame:
    """One row: the k most frequent labels."""
    return top_lists(ranked_labels(train, [], label, seq), [], label, k)


def conditional_frequency(train: DataFrame, test: DataFrame, keys: list[str], label: str, seq: str, k: int = TOP) -> DataFrame:
    """test with topk: its key's most frequent labels in train, else the most frequent of all.

    Both tables of lists have a row for each key at most and are left to Catalyst to broadcast by size.
    """
    lists = top_lists(ranked_labels(train, keys, label, seq), keys, label, k).withColumnRenamed("topk", "_own")
    whole = global_frequency(train, label, seq, k).withColumnRenamed("topk", "_all")
    return test.join(lists, keys, "left").join(F.broadcast(whole), how="left").withColumn("topk", F.coalesce("_own", "_all")).drop("_own", "_all")


def random_ranking(df: DataFrame, id_col: str, candidates: list[str], seed: int = 42) -> DataFrame:
    """df with topk: all candidates in an order that a hash of seed, id and candidate fixes."""
    keyed = F.array(*[F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.lit(c)).cast("binary")).alias("h"), F.lit(c).alias("c")) for c in candidates])
    return df.withColumn("topk", F.array_sort(keyed)["c"])


def random_accuracy(candidates: int, k: int) -> float:
    return min(k, candidates) / candidates


def knn_votes(train: DataFrame, test: DataFrame, features: list[Column] | Column, id_col: str, label: str, k: int = 10) -> DataFrame:
    """id, label, votes, rank: votes of the k nearest training rows by squared Euclidean distance.

    features: numbers, or one array of them. Both tables are dealt in blocks of about BLOCK rows,
    each pair of blocks is met by one task that keeps k rows a query, and these are merged, so no
    table is broadcast. Ties in distance go to the smaller id, ties in votes to the label's name;
    null or missing components stand last. A row isn't its own neighbour, null ids have none.
    """
    vector = features if isinstance(features, Column) else F.array(*features)
    vector = F.transform(F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(float("nan"))))
    left = test.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_q"), vector.alias("_v"))
    right = train.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_t"), F.col(label).alias("_label"), vector.alias("_v"))
    n_left, n_right = (max(1, -(-df.count() // BLOCK)) for df in (left, right))
    deal = lambda c, n: F.pmod(F.xxhash64(c, "_v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("_a", deal("_q", n_left)).withColumn("_b", each(n_right))
    right = right.withColumn("_b", deal("_t", n_right)).withColumn("_a", each(n_left))

    def meet(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("_t")
        ids, own = known.column("_t").combine_chunks(), asked.column("_q").combine_chunks()
        q, t = asked.column("_v").to_pylist(), known.column("_v").to_pylist()
        width = max(map(len, q + t), default=0)
        q, t = (np.array([v + [np.nan] * (width - len(v)) for v in rows], np.float64).reshape(len(rows), width) for rows in (q, t))
        same = np.array([-1 if x is None else x for x in pc.index_in(own, pc.unique(ids)).to_pylist()], np.int64)
        number = np.array(pc.index_in(ids, pc.unique(ids)).to_pylist(), np.int64)
        rows, near, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a in range(0, len(q), 256):
            d = np.zeros((len(q[a : a + 256]), len(t)))
            for i in range(width):
                d += (q[a : a + 256, None, i] - t[None, :, i]) ** 2
            other = same[a : a + 256, None] != number[None, :]
            for r in range(len(d)):
                at = np.flatnonzero(other[r])
                best = at[d[r, at].argsort(kind="stable")[:k]]
                rows.append(np.full(len(best), a + r))
                near.append(best)
                far.append(d[r, best])
        at = pa.array(np.concatenate(near))
        return pa.table({"_q": own.take(pa.array(np.concatenate(rows))), "_t": ids.take(at), "_label": known.column("_label").combine_chunks().take(at), "_d": pa.array(np.concatenate(far))})

    kinds = {"_q": test.schema[id_col], "_t": train.schema[id_col], "_label": train.schema[label]}
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in kinds.items()) + ", _d double"
    near = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(meet, schema)
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy("_d", "_t"))).where(F.col("_r") <= k)
    votes = near.groupBy(F.col("_q").alias(id_col), F.col("_label").alias(label)).agg(F.count("*").alias("votes"))
    return votes.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("votes"), label)))


def hit(topk: str, label: str, k: int) -> Column:
    """Whether the label is among the first k; false for an empty or null list."""
    return F.coalesce(F.array_contains(F.slice(F.col(topk), 1, k), F.col(label)), F.lit(False))


def accuracy(predicted: DataFrame, label: str, topk: str = "topk", k: int = TOP) -> DataFrame:
    """n, top1 and topk accuracy; 0 of an empty table."""
    rate = lambda k: F.coalesce(F.avg(hit(topk, label, k).cast("double")), F.lit(0.0))
    return predicted.agg(F.count("*").alias("n"), rate(1).alias("top1_acc"), rate(k).alias(f"top{k}_acc"))


def leaderboard(methods: dict[str, DataFrame], label: str, k: int = TOP) -> DataFrame:
    """method, n, top1_acc, topk accuracy: one row for each method."""
    rows = [accuracy(df, label, k=k).select(F.lit(name).alias("method"), "*") for name, df in methods.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
