"""A vocabulary that grows with a stream of texts: ids in the order of arrival, kept over restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chelate.functions.tokens import SPECIAL, VOCABULARY

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Growing(StatefulProcessor):
    """Numbers tokens that no earlier batch had, up to ``size`` with the special ones."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "token string", "id int")
        self.next = handle.getValueState("next", "id int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first: dict[str, tuple] = {}
        for batch in rows:
            for token, place, pos in zip(batch["token"], batch["place"], batch["pos"], strict=True):
                if token not in first or (place, pos) < first[token]:
                    first[token] = (place, pos)
        begin = at = self.next.get()[0] if self.next.exists() else len(SPECIAL)
        new = []
        for token in sorted(first, key=first.__getitem__):
            if at >= self.size:
                break
            if not self.ids.containsKey((token,)):
                self.ids.updateValue((token,), (at,))
                new.append((token, at))
                at += 1
        if at > begin:
            self.next.update((at,))
        yield pd.DataFrame(new, columns=["token", "id"]).astype({"id": "int32"})


def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each token of an Arrow batch its first place: so much reaches the one task that numbers."""
    for b in batches:
        yield b.sort_values(["place", "pos"]).drop_duplicates("token")


def grow_stream(tokenized: DataFrame, order: str, path: str, checkpoint: str, size: int = VOCABULARY) -> StreamingQuery:
    """Append (token, id) of tokens not seen before to ``path``; a batch's tokens count by ``order``, then by place in their text.

    tokenized: a stream with tokens (array<string>) and ``order`` (a whole number). The special tokens
    have the first ids and aren't written. A restart goes on where the checkpoint, a folder that all
    executors share, left off; the state is the vocabulary alone, ``size`` tokens at most. Runs over
    what is there and ends. State is kept in RocksDB; the session's provider is set to it.
    """
    spark = tokenized.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    rows = tokenized.select(F.col(order).cast("long").alias("place"), F.posexplode("tokens").alias("pos", "token"))
    rows = rows.where(F.col("token").isNotNull() & ~F.col("token").isin(list(SPECIAL)))
    rows = rows.mapInPandas(firsts, "place long, pos int, token string").withColumn("all", F.lit(0))
    new = rows.groupBy("all").transformWithStateInPandas(Growing(size), outputStructType="token string, id int", outputMode="Append", timeMode="None")
    return new.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
