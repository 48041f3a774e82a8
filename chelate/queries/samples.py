"""The driver's tables read as prediction samples and as complexes.

Sample: a line of an order, with the order's priority as metal, its number of lines as cn and the
return flag as donor. Complex: an order, whose lines are donors at (quantity, 100 discount,
100 tax) about their centroid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("donor"), F.col("l_linestatus").alias("status"))
    lines = lines.withColumn("cn", F.count("*").over(Window.partitionBy("id")).cast("int"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("metal"))
    return lines.join(orders, "id")


SAMPLES = """s AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_quantity AS qty, l_extendedprice AS price,
  l_returnflag AS donor, l_linestatus AS status, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS cn, o_orderpriority AS metal
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with what a model would have said: right at quantities off a multiple of 5, in the top five off 25; confidence from the part."""
    q = F.col("qty").cast("int")
    df = samples(spark, sf_dir).withColumns({"top1": q % 5 != 0, "top5": q % 25 != 0, "conf": (F.col("part") % 1000) / 1000})
    ranked = df.groupBy("metal", "cn", "donor").agg(F.count("*").alias("n"), F.min("id").alias("f"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("metal", "cn").orderBy(F.desc("n"), "f", "donor")))
    lists = ranked.groupBy("metal", "cn").agg(F.max_by("donor", -F.col("r")).alias("mode"), F.collect_set(F.when(F.col("r") <= 5, F.col("donor"))).alias("top"))
    return df.join(lists, ["metal", "cn"]).withColumns({"base1": F.col("mode") == F.col("donor"), "base5": F.array_contains("top", F.col("donor"))}).drop("top")


PREDICTIONS = f"""{SAMPLES}, m AS (SELECT metal, cn, first(donor ORDER BY r) AS mode, list(donor) AS top FROM (
    SELECT metal, cn, donor, row_number() OVER (PARTITION BY metal, cn ORDER BY count(*) DESC, min(id), donor) AS r FROM s GROUP BY metal, cn, donor) WHERE r <= 5 GROUP BY metal, cn),
p AS (SELECT s.*, mode, CAST(qty AS INTEGER) % 5 <> 0 AS top1, CAST(qty AS INTEGER) % 25 <> 0 AS top5, (part % 1000) / 1000 AS conf, mode = donor AS base1, list_contains(top, donor) AS base5
  FROM s JOIN m USING (metal, cn))"""


def complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol, ord, donor, x, y, z about the centroid, and the order's size; repeated lines are told apart by all their values."""
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    df = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*key)))
    whole = Window.partitionBy("l_orderkey")
    xyz = {"x": F.col("l_quantity"), "y": F.rint(F.col("l_discount") * 100), "z": F.rint(F.col("l_tax") * 100)}
    df = df.select(F.col("l_orderkey").alias("mol"), "ord", F.col("l_returnflag").alias("donor"), F.col("l_partkey").alias("part"), F.count("*").over(whole).cast("int").alias("cn"), *[(v - F.avg(v).over(whole)).alias(k) for k, v in xyz.items()])
    return df


COMPLEXES = """c AS (SELECT l_orderkey AS mol, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice) AS INTEGER) AS ord,
  l_returnflag AS donor, l_partkey AS part, CAST(count(*) OVER w AS INTEGER) AS cn, l_quantity - avg(l_quantity) OVER w AS x,
  round_even(l_discount * 100, 0) - avg(round_even(l_discount * 100, 0)) OVER w AS y, round_even(l_tax * 100, 0) - avg(round_even(l_tax * 100, 0)) OVER w AS z
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))"""
