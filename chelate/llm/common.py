"""Shared helpers: text rules, materialisation, distributed ordering, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the only separator between words.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key with more than one of so many parts of all rows is hot.
HOT = 1_024
#: Rows of an Arrow batch: texts are long, and both the JVM and Python hold a batch several times over.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's Arrow batches to BATCH_ROWS rows; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words; null counts as empty."""
    trimmed = F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{SPACE}", "")
    # a limit of 0 drops trailing empty parts, so text that ends in space needs no second pass
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(trimmed, rf"{SPACE}$", ""), SPACE))).cast("long")


def id_text(c: Column) -> Column:
    """An id as text; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset (tests), a local master gets a temporary folder; a cluster without the
    setting is an error, because other executors would not see a machine-local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def small_join(left: DataFrame, keys: DataFrame, on: str, how: str, limit_rows: int = 500_000) -> DataFrame:
    """Join with a key table, broadcast only while its counted rows stay within limit_rows."""
    return left.join(F.broadcast(keys) if keys.count() <= limit_rows else keys, on, how)


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``pos``, the 1-based rank in the given total order, without one task for all rows.

    Rows are range-partitioned and written; only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    before, offsets = 0, []
    for pid, count in sorted(map(tuple, ranged.groupBy("_pid").count().collect())):
        offsets.append((pid, before))
        before += count
    table = F.broadcast(spark.createDataFrame(offsets, "_pid int, _before long"))
    rank = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)).cast("long")
    return ranged.join(table, "_pid").withColumn("pos", rank + F.col("_before")).drop("_pid", "_before")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_found(docs: DataFrame, found: DataFrame, mark: Column, id_col: str = "doc_id") -> DataFrame:
    """docs with the rows that ``found`` keeps: (id, mark, kept), one row for each row of docs.

    Where an id stands on one row, its rejected ids alone are joined and texts stay where they
    are. Rows that share an id, and those without one, are settled by id and ``mark``: of rows
    equal in both, one stays if any is kept, the first in the order of all columns.
    """
    dropped = materialise(found.where("id IS NOT NULL AND NOT kept").select(F.col("id").alias(id_col)).distinct())
    odd = materialise(found.groupBy("id").count().where("count > 1 OR id IS NULL").select("id"))
    once = small_join(docs, dropped, id_col, "left_anti")
    if odd.isEmpty():
        return once
    key, marked, part, rank = unused(docs, "key", "marked", "part", "rank")
    odd = materialise(odd.withColumnRenamed("id", key))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key))
    odd = F.broadcast(odd) if odd.count() <= 500_000 else odd
    once = once.join(odd, same, "left_anti")
    kept = found.where("kept").select(F.col("id").alias(key), F.col("mark").alias(part)).distinct()
    some = docs.join(odd, same, "left_semi").withColumn(marked, mark)
    some = some.join(kept, same & (F.col(marked) == F.col(part)), "left_semi")
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    # a third of all rows may be equal: the first of each salted part, then the first of these
    for keys in ((id_col, marked, part), (id_col, marked)):
        first = Window.partitionBy(*keys).orderBy(whole)
        some = some.withColumn(part, F.pmod(F.xxhash64(whole), F.lit(64))).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return once.unionByName(some.select(*[F.col(f"`{c}`") for c in docs.columns]))


def with_least(both: DataFrame, total: int) -> DataFrame:
    """Rows (u, v) with v > u, and m, the least of u and its neighbours.

    A node with more than one of HOT parts of all rows, of which there are at most HOT, gets its
    number by a broadcast, so the centre of a large star isn't dealt to one task.
    """
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).withColumn("m", F.least("u", "m"))
    hot = F.broadcast(low.where(F.col("d") * HOT > total).select("u", "m"))
    up = both.where("v > u")
    rest = up.join(hot.select("u"), "u", "left_anti").join(low.where(F.col("d") * HOT <= total).select("u", "m"), "u")
    return up.join(hot, "u").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component) per node.

    component is the smallest node id reachable. Alternates the large-star and small-star steps,
    which keep the edge count linear, until the edges form stars. Each round is written, so
    lineage stays short; only two numbers per round reach the driver.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, last = materialise(pairs), None
    measure = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    now = tuple(cur.agg(*measure).first())
    while now != last:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        cur = materialise(small)
        last, now = now, tuple(cur.agg(*measure).first())
    stars = cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
