"""Mixing sources to target weights by weighted fair queueing.

Within a source, documents stand in a shuffled order that a keyed digest fixes. A document's
virtual finish time is the source's cumulative words over the source's target; all documents,
up to three passes over each source, are range-sorted by that time, and the mix ends where the
total budget is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chelate.llm.common import id_text, materialise, n_words, positions, table, unused

PASSES = 3
SEED = "mix"
#: Rows of a source for each task that sums them, at most about; a source also gets its share of the shuffle partitions.
ROWS_PER_TASK = 50_000


def targets(sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """Add ``target`` to (source, weight, source_size): shares of all words by weight, at most ``passes`` times a source.

    Water filling: sources whose share is above their limit are set to it and leave; the rest
    share what is left by weight. Each round sends three sums to the driver, whatever the number
    of sources, and ends when no source is above its limit.
    """
    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = F.lit(False)
    while True:
        full, weight, count = (int(x or 0) for x in sources.agg(F.sum(F.when(level, F.col("source_size"))), F.sum(F.when(~level, F.col("weight"))), F.count(F.when(level, 1))).first())
        left = total - passes * full
        # exact in whole numbers: passes * size < weight * left / sum of weights
        above = level | (F.col("source_size").cast("decimal(38,0)") * passes * weight < F.col("weight").cast("decimal(38,0)") * left)
        if int(sources.agg(F.count(F.when(above, 1))).first()[0]) == count:
            share = (F.col("weight").cast("decimal(38,0)") * left).cast("double") / F.lit(float(max(weight, 1)))
            return sources.withColumn("target", F.when(level, (F.col("source_size") * passes).cast("double")).otherwise(share))
        level = above


def fair_mix(docs: DataFrame, passes: int = PASSES, seed: str = SEED, weights: tuple[int, ...] = (1, 2, 3), keep_source: bool = False) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies; with ``keep_source`` also source.

    Sources in code point order, null last, take ``weights`` in turn. size: words of the text,
    null is 0. taken: words the mix takes, size times ``copies`` (0 to ``passes``). Whole
    documents are taken in the order of finish time until the next would pass the budget, which
    is the sum of all sizes. A source without words has target 0 and nothing taken; an empty
    table gives an empty result. Repeated rows count each by itself. Ties: by source, pass,
    digest, doc_id. Other columns are not read.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), id_text(F.col("doc_id"))).cast("binary"))
    rows = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = positions(per, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = materialise(targets(per.withColumn("weight", weight.cast("long")), passes))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows_of_all = int(per.agg(F.sum("n")).first()[0] or 1)
    parts = F.ceil(F.greatest(F.col("n") / ROWS_PER_TASK, F.col("n") * n / rows_of_all))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * parts)
    dims = per.select(F.col("source").alias("_source"), F.col("pos").alias("rank"), "source_size", "target", "n")
    rows = rows.join(dims, F.col("source").eqNullSafe(F.col("_source"))).withColumn("part", bucket)
    inside = Window.partitionBy("rank", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    rows = rows.withColumn("inside", F.sum("size").over(inside)).join(sums, ["rank", "part"])
    rows = rows.withColumn("cum", F.col("before") + F.col("inside"))
    rows = materialise(rows.select("doc_id", *(["source"] if keep_source else []), "key", "rank", "size", "source_size", "target", "cum").withColumn("row", F.monotonically_increasing_id()))

    copies = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    finish = (F.col("cum") + F.col("pass") * F.col("source_size")).cast("double") / F.when(F.col("target") > 0, F.col("target"))
    copies = copies.select("row", "rank", "pass", "key", "doc_id", "size", F.coalesce(finish, F.lit(0.0)).alias("finish"))
    order = [F.col(c) for c in ("finish", "rank", "pass", "key", "doc_id", "size")]
    ranged = materialise(copies.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()))
    budget = int(rows.agg(F.sum("size")).first()[0] or 0)
    used, cut = 0, -1  # the partition in which the budget ends; one sum for each partition
    for pid, words in sorted(map(tuple, ranged.groupBy("pid").agg(F.sum("size")).collect())):
        cut = pid
        if used + words > budget:
            break
        used, cut = used + words, pid + 1
    upto = F.sum("size").over(Window.partitionBy("pid").orderBy(*order, "row").rowsBetween(Window.unboundedPreceding, 0))
    edge = ranged.where(F.col("pid") == cut).withColumn("upto", upto).where(F.col("upto") + used <= budget)
    taken = ranged.where(F.col("pid") < cut).select("row").unionByName(edge.select("row"))
    taken = taken.groupBy("row").agg(F.count("*").alias("copies"))
    out = rows.join(taken, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *(["source"] if keep_source else []))


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row as often as fair_mix() takes it; columns, whatever their names, stay as they are.

    A row without words adds nothing to any source and is left out. Rows that share id, source and
    size get the copies that fair_mix() gives to these rows, one row's each. An empty table gives
    an empty result.
    """
    plan = fair_mix(docs, keep_source=True).where("taken > 0").select("doc_id", "source", "size", "copies")
    i, s, n, c, r, copy, place = unused(docs, "id", "from", "words", "times", "rank", "copy", "place")
    plan = plan.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n), F.col("copies").alias(c))
    plan = materialise(plan.withColumn(r, F.row_number().over(Window.partitionBy(i, s, n).orderBy(F.desc(c)))))
    same = [F.col("doc_id").eqNullSafe(F.col(i)), F.col("source").eqNullSafe(F.col(s)), n_words(F.col("text")) == F.col(n)]
    again = materialise(plan.where(F.col(r) > 1).select(i, s, n).distinct())

    def join(left: DataFrame, right: DataFrame, how: str, *more: Column) -> DataFrame:
        on = same[0] & same[1] & same[2]
        for m in more:
            on = on & m
        return left.join(F.broadcast(right) if right.count() <= 500_000 else right, on, how)

    repeat = F.explode(F.sequence(F.lit(1), F.col(c).cast("int")))
    columns = [F.col(f"`{x}`") for x in docs.columns]
    if again.isEmpty():
        return join(docs, plan, "inner").withColumn(copy, repeat).select(*columns)
    once = join(join(docs, again, "left_anti"), plan, "inner").withColumn(copy, repeat).select(*columns)
    order = Window.partitionBy("doc_id", "source", n_words(F.col("text"))).orderBy(F.to_json(F.struct(*columns)))
    some = join(docs, again, "left_semi").withColumn(place, F.row_number().over(order))
    return once.unionByName(join(some, plan, "inner", F.col(place) == F.col(r)).withColumn(copy, repeat).select(*columns))


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(table(spark, sf_dir, "documents")).drop("copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank) AS j FROM w),
p AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(weight) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
             sum(source_size) OVER () AS budget FROM o),
c AS (SELECT min(j) AS j FROM p WHERE CAST(source_size AS HUGEINT) * 3 * weight_left >= weight * (budget - 3 * full_before)),
l AS (SELECT (budget - 3 * full_before) AS remain, weight_left FROM p WHERE j = (SELECT j FROM c)),
t AS (SELECT p.source, rank, source_size, budget, CASE WHEN j < (SELECT j FROM c) THEN CAST(3 * source_size AS DOUBLE)
        ELSE CAST(weight * remain AS DOUBLE) / CAST(l.weight_left AS DOUBLE) END AS target FROM p, l),
q AS (SELECT doc_id, key, size, rank, source_size, target, budget,
             sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CASE WHEN target > 0 THEN CAST(cum + pass * source_size AS DOUBLE) / target ELSE 0 END AS finish FROM q, (SELECT unnest([0, 1, 2]) AS pass)),
y AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, pass, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM x)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM y GROUP BY doc_id
"""

QUERIES = {"op8_fair_mix": op8_fair_mix}
ORACLES = {"op8_fair_mix": SQL}
