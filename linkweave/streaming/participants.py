"""Running counters of participants: first block, transfers so far, and the moment a cap is crossed.

Each micro-batch is first combined inside its tasks, an Arrow batch at a time, so an address
that a third of the rows name reaches its state as one row for each ten thousand. Addresses are
dealt into buckets, and the state of a bucket is one table of its addresses with their least
blocks and counts, so that a batch is merged into it by columns and not address by address. Both
counters are independent of the order of rows, so late rows need no watermark and give what the
batch aggregation gives. A transfer without an address counts for the null address, as there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of an address: its counters now, and whether this batch took it over the cap.
EVENTS = "address string, first_block bigint, n bigint, crossed boolean"
#: Buckets of addresses; a batch rewrites those that it names, and a stream keeps the number it began with.
BUCKETS = 2048
#: Stands for no block in state, where it is above all others.
NO_BLOCK = 2**63 - 1
#: The state store that keyed state needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grouped = pa.Table.from_batches([batch]).group_by("address").aggregate([("block_num", "min"), ([], "count_all")])
        yield from grouped.select(["address", "block_num_min", "count_all"]).rename_columns(["address", "first_block", "n"]).combine_chunks().to_batches()


_HELD = pa.schema([("address", pa.string()), ("first_block", pa.int64()), ("n", pa.int64())])


def _dumped(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


class Counters(StatefulProcessor):
    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counters", "held binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pa.concat_tables(pa.Table.from_pandas(x[_HELD.names], schema=_HELD, preserve_index=False) for x in rows)
        parts, was = [new.append_column("new", new["n"])], self.state.get()
        if was is not None:
            held = pa.ipc.open_stream(bytes(was[0])).read_all()
            parts.append(held.append_column("new", pa.array([0] * held.num_rows, pa.int64())))
        sums = pa.concat_tables(parts).group_by("address").aggregate([("first_block", "min"), ("n", "sum"), ("new", "sum")])
        self.state.update((_dumped(sums.select(["address", "first_block_min", "n_sum"]).rename_columns(_HELD.names)),))
        out = sums.to_pandas()
        out = out[out["new_sum"] > 0]
        n = out["n_sum"]
        yield pd.DataFrame({"address": out["address"], "first_block": out["first_block_min"], "n": n, "crossed": (n - out["new_sum"] < self.cap) & (self.cap <= n)})

    def close(self) -> None:
        pass


def participant_counters(transfers: DataFrame, *, cap: int = 1000) -> DataFrame:
    """A stream of :data:`EVENTS`, for update mode: each address of a batch once, with its counters after it.

    ``crossed`` is true in the one batch in which the count reaches ``cap``, from which on the
    address is an extreme service. The session needs :data:`STATE_STORE`.
    """
    ends = transfers.select(F.explode(F.array("from_addr", "to_addr")).alias("address"), F.col("block_num").cast("bigint").alias("block_num"))
    partial = ends.mapInArrow(_combined, "address string, first_block bigint, n bigint")
    dealt = partial.select("address", F.coalesce("first_block", F.lit(NO_BLOCK)).alias("first_block"), "n", F.pmod(F.xxhash64("address"), F.lit(BUCKETS)).alias("bucket"))
    found = dealt.groupBy("bucket").transformWithStateInPandas(Counters(cap), EVENTS, "Update", "None")
    return found.withColumn("first_block", F.nullif("first_block", F.lit(NO_BLOCK)))
