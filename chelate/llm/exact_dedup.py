"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries find digests that may be frequent, an exact count verifies them, and the
verified winners (at most ``counters`` rows) are broadcast: their copies are settled map-side.
All other digests take an ordinary shuffle, in which no group can hold many rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chelate.llm.common import SPACE, keep_found, materialise, table

COUNTERS = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def shrink(counts: Counter, k: int) -> Counter:
    """A mergeable Misra-Gries summary: subtract the (k+1)-th largest count, keep what is above 0."""
    if len(counts) <= k:
        return counts
    floor = sorted(counts.values(), reverse=True)[k]
    return Counter({x: n - floor for x, n in counts.items() if n > floor})


def heavy_candidates(digests: DataFrame, counters: int) -> DataFrame:
    """At most ``counters`` digests; every digest held by over 2/(counters+1) of all rows is among them."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: Counter = Counter()
        for batch in batches:
            found = batch.column(0).value_counts()
            summary.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
            summary = shrink(summary, counters)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(summary.keys(), pa.binary()), "n": pa.array(summary.values(), pa.int64())})

    partial = digests.select("digest").mapInArrow(summarise, "digest binary, n long")
    return partial.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space. A null
    text is the empty text. The row with the smallest id stays, a null id counts as the largest;
    of rows repeated with one id, exactly one stays. An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
    winners = (
        rows.join(F.broadcast(heavy_candidates(rows, counters)), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    winners = materialise(winners)  # at most `counters` rows of 60 bytes
    heavy = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = light.withColumns({"first": F.min(order).over(same), "group_size": F.count("*").over(same)})
    return heavy.unionByName(light).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates() drops; columns, whatever their names, stay as they are.

    Only ids of dropped rows are joined, so texts are not shuffled while those ids are few. Of
    equal texts one row stays, also where rows share an id or have none. A null text is the empty
    text; an empty table gives an empty result.
    """
    found = materialise(exact_duplicates(docs).select(F.col("doc_id").alias("id"), F.xxhash64("text_sha256").alias("mark"), "kept"))
    return keep_found(docs, found, F.xxhash64(F.sha2(normalised(F.col("text")), 256)))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op10_exact_dedup": SQL}
