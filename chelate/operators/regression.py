"""Linear regression on vectors by normal equations: outer products are summed where the rows are, then in a tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums that one task adds up, and that reach the driver at most.
FAN = 64


@dataclass(frozen=True)
class Linear:
    weights: tuple[float, ...]
    bias: float
    n: int

    def column(self, vector: Column) -> Column:
        """The prediction; null for a vector of another length."""
        w = F.array(*[F.lit(x) for x in self.weights])
        products = F.zip_with(vector.cast("array<double>"), w, lambda a, b: a * b)
        return F.when(F.size(vector) == len(self.weights), F.aggregate(products, F.lit(self.bias), lambda s, x: s + x))


def usable(vector: str, target: str, width: int) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return (F.size(vector) == width) & F.forall(F.col(vector).cast("array<double>"), finite) & finite(F.col(target).cast("double"))


def fit_linear(df: DataFrame, vector: str, target: str, width: int, ridge: float = 0.0) -> Linear:
    """Weights and bias of least squares over rows whose vector has ``width`` finite components and whose target is finite.

    Each partition sums its rows' outer products, of width squared numbers; sums are added up FAN at
    a time, so memory hangs on the width alone. ridge: added to the weights' diagonal. Without rows, all 0; directions that no row tells get no weight.
    """
    size = width + 2
    kind = "part int, total binary"

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            x = np.ones((b.num_rows, size))
            x[:, :width] = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x[:, width + 1] = b.column(1).to_numpy(zero_copy_only=False)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "total": [total.tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("part")["total"]
        total = sum((np.frombuffer(t) for t in ordered), np.zeros(size * size))
        return pd.DataFrame({"part": [rows["part"].min() // FAN], "total": [total.tobytes()]}).astype({"part": "int32"})

    rows = df.where(usable(vector, target, width)).select(F.col(vector).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y"))
    parts, sums = rows.rdd.getNumPartitions(), rows.mapInArrow(outer, kind)
    while parts > FAN:
        sums, parts = sums.groupBy(F.expr(f"part div {FAN}").alias("g")).applyInPandas(add, kind), -(-parts // FAN)
    total = sum((np.frombuffer(r.total).reshape(size, size) for r in sorted(sums.collect(), key=lambda r: r.part)), np.zeros((size, size)))
    a, b, n = total[:-1, :-1].copy(), total[:-1, -1], int(total[-2, -2])
    a[np.arange(width), np.arange(width)] += ridge
    w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    return Linear(tuple(w[:-1].tolist()), float(w[-1]), n)


def fitness(df: DataFrame, model: Linear, vector: str, target: str) -> DataFrame:
    """One row: n, rmse and r2 of the model on the rows that it can be fitted on."""
    rows = df.where(usable(vector, target, len(model.weights))).select(F.col(target).cast("double").alias("y"), model.column(F.col(vector)).alias("p"))
    out = rows.agg(F.count("*").alias("n"), F.avg((F.col("y") - F.col("p")) ** 2).alias("e"), F.var_pop("y").alias("v"))
    return out.select("n", F.sqrt("e").alias("rmse"), (1 - F.col("e") / F.nullif("v", F.lit(0.0))).alias("r2"))
