"""Probe, curves and regression over the driver's tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.operators.curves import coverage
from chelate.operators.probe import completed, probed
from chelate.operators.regression import fit_linear
from chelate.operators.repair import context_scorer
from chelate.queries.registry import registry
from chelate.queries.samples import PREDICTIONS, predictions, table

QUERIES, ORACLES, query = registry()

PROBE = f"""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, 'L' || left(o_orderpriority, 1) AS lig, CAST(o_custkey % 4 + 1 AS VARCHAR) AS def FROM orders),
a AS (SELECT s, lig, row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, lig) - 1 AS k FROM o GROUP BY s, lig),
b AS (SELECT def, row_number() OVER (ORDER BY count(*) DESC, def) - 1 AS k FROM o GROUP BY def),
t AS (SELECT id, s, r.k, '{{trans:' || coalesce(a.lig, '[MASK]') || ':' || o.s || '}}|L' || coalesce(b.def, '[MASK]') || '=N|' AS text, a.lig, b.def, o.lig AS own
  FROM o CROSS JOIN (SELECT unnest(range(5)) AS k) r LEFT JOIN a USING (s, k) LEFT JOIN b ON b.k = r.k),
v AS (SELECT *, lig IS NULL OR substr(lig, 2) = def AS fits FROM t)
SELECT id, max(text) FILTER (k = 0) AS first, bool_or(fits) FILTER (k = 0) AS syntax1, bool_or(fits) AS syntax5, max(CASE WHEN lig = own THEN 1.0::DOUBLE ELSE 0 END) FILTER (k = 0) AS constraint_recall FROM v GROUP BY id"""


@query(PROBE)
def generation_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' strings with a reference and a definition masked, as a scorer of the whole strings fills them."""
    clean = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.array(F.lit("{trans:"), F.concat(F.lit("L"), F.substring("o_orderpriority", 1, 1)), F.concat(F.lit(":"), "o_orderstatus", F.lit("}")), F.lit("|L"), (F.col("o_custkey") % 4 + 1).cast("string"), F.lit("=N|")).alias("tokens"),
    )
    masked = clean.select("id", F.array_join("tokens", "").alias("target"), F.transform("tokens", lambda t, i: F.when(i.isin(1, 4), "[MASK]").otherwise(t)).alias("tokens"))
    out = probed(completed(masked, "id", "tokens", context_scorer(clean, "tokens")), "outputs", "target")
    return out.select("id", F.get("outputs", F.lit(0)).alias("first"), "syntax1", "syntax5", F.col("constraint").alias("constraint_recall"))


@query(f"""WITH {PREDICTIONS}, g AS (SELECT conf, count(*) AS n, count_if(top1) AS c FROM p GROUP BY conf)
SELECT conf::DOUBLE AS threshold, CAST(sum(n) OVER w AS BIGINT) AS n_samples, CAST(sum(c) OVER w AS BIGINT) AS n_correct, round(sum(n) OVER w / sum(n) OVER (), 9) AS coverage, round(sum(c) OVER w / sum(n) OVER w, 9) AS accuracy FROM g WINDOW w AS (ORDER BY conf DESC)""")
def coverage_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve at every confidence that occurs."""
    out = coverage(predictions(spark, sf_dir), "conf", "top1")
    return out.select("threshold", "n_samples", "n_correct", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


@query("""WITH x AS (SELECT l_quantity AS a, l_discount * 100 AS b, l_extendedprice / 1000 AS y FROM lineitem),
m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS cy FROM x),
w AS (SELECT *, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS wa, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
SELECT n, round(wa, 6) AS w_quantity, round(wb, 6) AS w_discount, round(my - wa * ma - wb * mb, 6) AS bias FROM w""")
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by least squares from quantity and discount."""
    rows = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_discount") * 100).alias("v"), (F.col("l_extendedprice") / 1000).alias("y"))
    m = fit_linear(rows, "v", "y", 2)
    # the sums were taken over all rows; one row of them is left
    return spark.createDataFrame([(m.n, *m.weights, m.bias)], "n long, a double, b double, c double").select("n", *[F.round(x, 6).alias(y) for x, y in (("a", "w_quantity"), ("b", "w_discount"), ("c", "bias"))])
