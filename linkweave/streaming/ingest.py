"""Streams of landed transfers: deduplicated inserts, first funding, and linking per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from linkweave.schemas import TABLES
from linkweave.sources.store import TRANSFER_KEY, Store


def transfer_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of transfers as a stream."""
    return spark.readStream.schema(TABLES["transfers"]).parquet(folder)


def distinct_transfers(stream: DataFrame, *, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Transfers once by key; with an event time, the state is dropped behind the watermark.

    A key with a null equals no other, so such rows pass beside the deduplication and cost no state.
    """
    if event_time:
        stream = stream.withWatermark(event_time, delay)
    whole = F.col("tx_hash").isNotNull() & F.col("asset").isNotNull() & F.col("value").isNotNull()
    keyed = stream.where(whole)
    once = keyed.dropDuplicatesWithinWatermark(list(TRANSFER_KEY)) if event_time else keyed.dropDuplicates(list(TRANSFER_KEY))
    return once.unionByName(stream.where(~whole))


def first_funding(stream: DataFrame) -> DataFrame:
    """First block of each (recipient, funder), for update mode; late rows only lower a minimum."""
    return stream.groupBy(F.col("to_addr").alias("address"), F.col("from_addr").alias("key")).agg(F.coalesce(F.min("block_num"), F.lit(0)).alias("observed_block"))


def insert_stream(stream: DataFrame, store: Store, checkpoint: str, *, after: Callable[[Store, int], None] | None = None) -> StreamingQuery:
    """Insert each batch into the store as if by insert-or-ignore, then call ``after`` (to link again, say).

    The batch's number is published with its rows and with what ``after`` stores, so a batch
    that is repeated after a failure adds nothing, rows with null keys included.
    """

    def insert(batch: DataFrame, number: int) -> None:
        with store.transaction():
            if not store.once(checkpoint, number):
                return
            store.insert_transfers(batch)
            if after is not None:
                after(store, number)

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
