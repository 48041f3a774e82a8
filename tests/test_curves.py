"""Running sums and curves against a theta join, regression against a direct solution."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chelate.operators.curves import coverage, prefix_sums
from chelate.operators.regression import FAN, fit_linear, fitness


def theta(rows, cuts):
    known = [(c, r) for c, r in rows if c is not None and c == c]
    out = {}
    for t in cuts:
        kept = [bool(r) for c, r in known if c >= t]
        out[t] = (len(kept), sum(kept), len(kept) / len(known), sum(kept) / len(kept) if kept else None)
    return out


def samples(n=3_000, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([rng.random(), rng.randint(0, 20) / 20, None, float("nan")]), rng.choice([True, False, None])) for _ in range(n)]


def test_curve_at_every_confidence(spark):
    rows = samples()
    df = spark.createDataFrame(rows, "conf double, ok boolean").repartition(5)
    got = {r.threshold: (r.n_samples, r.n_correct, r.coverage, r.accuracy) for r in coverage(df, "conf", "ok").collect()}
    assert got == theta(rows, {c for c, _ in rows if c is not None and c == c}) and len(got) > 500


def test_curve_at_thresholds(spark):
    rows, cuts = samples(seed=2), [0.0, 0.05, 0.05, 0.5, 0.51234, 1.0, 1.5, -1.0]
    df = spark.createDataFrame(rows, "conf double, ok boolean")
    asked = spark.createDataFrame([(c,) for c in [*cuts, None]], "t double")
    got = {r.threshold: (r.n_samples, r.n_correct, r.coverage, r.accuracy) for r in coverage(df, "conf", "ok", asked).collect()}
    assert got == theta(rows, set(cuts)) and got[1.5][3] is None
    none = df.where("conf > 9")
    assert coverage(none, "conf", "ok").count() == 0
    assert [(r.n_samples, r.coverage) for r in coverage(none, "conf", "ok", asked.limit(1)).collect()] == [(0, None)]


def test_no_task_sums_all_rows(spark):
    """Sums by ranges: the plan's windows are over a range each, but for the one over the ranges' totals."""
    df = spark.range(10_000).select("id", (F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 > 0, 1).alias("y"))
    out = prefix_sums(df, [F.desc("id")], ["x", "y"])
    rows = sorted(out.collect(), key=lambda r: -r.id)
    assert [r.x_sum for r in rows] == np.cumsum([r.x for r in rows]).tolist() and [r.y_sum for r in rows] == np.cumsum([r.y or 0 for r in rows]).tolist()
    assert "_part" not in out.columns and prefix_sums(df.where("id < 0"), [F.col("id")], ["x"]).count() == 0


def vectors(spark, n, width, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * rng.uniform(0.1, 3, width)
    y = x @ rng.normal(size=width) + 4 + rng.normal(size=n)
    return x, y, spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)], "v array<double>, y double")


@pytest.mark.parametrize("parts", [1, 7, FAN + 40])
def test_regression_equals_direct_solution(spark, parts):
    x, y, df = vectors(spark, 2_000, 64)
    model = fit_linear(df.repartition(parts), "v", "y", 64)
    want = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    assert model.n == 2_000 and np.allclose([*model.weights, model.bias], want, atol=1e-9)
    row = fitness(df, model, "v", "y").first()
    rest = y - x @ want[:-1] - want[-1]
    assert row.n == 2_000 and row.rmse == pytest.approx(np.sqrt((rest**2).mean())) and row.r2 == pytest.approx(1 - (rest**2).mean() / y.var())


def test_regression_on_odd_rows(spark):
    """Rows with nulls, other lengths or infinite numbers don't count; what no row tells gets no weight."""
    x, y, df = vectors(spark, 300, 3)
    odd = spark.createDataFrame([(None, 1.0), ([1.0, 2.0], 1.0), ([1.0, None, 2.0], 1.0), ([1.0, float("nan"), 2.0], 1.0), ([1.0, 2.0, 3.0], None), ([1.0, 2.0, 3.0], float("inf"))], "v array<double>, y double")
    assert fit_linear(df.unionByName(odd).coalesce(1), "v", "y", 3) == fit_linear(df.coalesce(1), "v", "y", 3)
    none = fit_linear(odd, "v", "y", 3)
    assert none.n == 0 and none.weights == (0.0, 0.0, 0.0) and fitness(odd, none, "v", "y").first().n == 0
    flat = fit_linear(df.withColumn("v", F.array(F.col("v")[0], F.lit(0.0), F.lit(0.0))), "v", "y", 3)
    assert flat.weights[1:] == pytest.approx((0.0, 0.0)) and flat.weights[0] != 0
    assert abs(fit_linear(df, "v", "y", 3, ridge=1e9).weights[0]) < 1e-3
    assert odd.select(none.column(F.col("v")).alias("p")).where("p IS NULL").count() == 3  # null, short, and a null component
