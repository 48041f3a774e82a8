"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table; shards take turns, each
claiming its next free slot, so each holds all but the same number of slots and a change of the
shard set moves few keys. The table has a fixed size and is broadcast: a row's shard is found by
one probe, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.llm.common import id_text, table, unused

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def number(text: str) -> int:
    """60 bits of a digest; the same as key_number() has for a column."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def key_number(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def lookup(shards: tuple[str, ...] | list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index into shards. Needs distinct names, a prime size and no more shards than slots."""
    if not shards or len(set(shards)) < len(shards) or not is_prime(size) or len(shards) > size:
        raise ValueError("needs 1 to size distinct shards and a prime size")
    slots, left = [-1] * size, size
    at = [number(f"offset:{s}") % size for s in shards]
    step = [number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    while left:
        for i in range(len(shards)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            slots[at[i]] = i
            left -= 1
            if not left:
                break
    return slots


def assign_shards(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] | list[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """key, slot and shard of every row; equal keys share a shard, a null key counts as the empty text.

    The broadcast table has ``size`` rows (65,537 by default, under 2 MB), whatever the input. An
    empty table gives an empty result. Columns but the key are not read.
    """
    slots = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup(shards, size))], "slot long, shard string")
    rows = df.select(F.col(key).alias("of"), F.pmod(key_number(id_text(F.col(key))), F.lit(size)).alias("slot"))
    return rows.join(F.broadcast(slots), "slot").select(F.col("of").alias(key), "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] | list[str] = SHARDS, size: int = TABLE_SIZE, salt: int = 8, folder: str = "shard") -> None:
    """Write df as Parquet with a folder for each shard, ``salt`` tasks to a shard, so that a key repeated often does not stop at one.

    Rows with a null key go where the empty text does; repeated rows are all written; of an empty
    table nothing is. ``folder`` names the folders' column, with underscores added where df has it.
    """
    at, name = unused(df, "slot", folder)
    slots = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup(shards, size))], f"{at} long, {name} string")
    rows = df.withColumn(at, F.pmod(key_number(id_text(F.col(f"`{key}`"))), F.lit(size))).join(F.broadcast(slots), at).drop(at)
    rows.repartition(len(shards) * salt, name, F.floor(F.rand(7) * salt)).write.partitionBy(name).mode("overwrite").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def sql() -> str:
    """Placement of every key; the table's content, which SQL can't fill, is held against brute force in the tests."""
    return f"""
SELECT doc_id, slot, printf('shard-%03d', ([{','.join(map(str, lookup(SHARDS)))}])[slot + 1]) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents)
"""


QUERIES = {"op1_sharding": op1_sharding}
ORACLES = {"op1_sharding": sql}
