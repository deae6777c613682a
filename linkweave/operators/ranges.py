"""Block ranges that are fetched, halved where they fail, and given up at a smallest width.

A range is called up to ``retries + 1`` times. One that never answers is halved while it is
wider than ``min_blocks``; narrower ones are failed leaves, which give no rows. The frontier of
ranges is a table: each round joins it with the outcomes of its calls, by range, and halves what
failed. Ranges of one round are disjoint, so there are at most log2(width / min_blocks) rounds
and the work of a round follows the ranges in it. Every round is written to the shared
checkpoint folder and read from there, so plans don't grow and a lost executor costs one round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.runtime import checkpoint_dir, written

#: States of a range: answered, halved, given up, or with too few landed calls to tell.
FETCHED, SPLIT, FAILED, PENDING = "fetched", "split", "failed", "pending"
_NODE = "from_block bigint, to_block bigint, depth int, status string, calls bigint, retries bigint"


def chunk_ranges(blocks: DataFrame, width: int, *, block: str = "block_num") -> DataFrame:
    """(from_block, to_block) ranges of ``width`` blocks from the least to the greatest block of a table.

    The last one ends with the greatest block; no known block, no ranges.
    """
    ends = blocks.agg(F.min(block).cast("bigint").alias("a"), F.max(block).cast("bigint").alias("z")).where("a is not null")
    starts = ends.select("z", F.explode(F.sequence("a", "z", F.lit(width).cast("bigint"))).alias("from_block"))
    return starts.select("from_block", F.least(F.col("from_block") + width - 1, F.col("z")).alias("to_block"))


def halves(ranges: DataFrame) -> DataFrame:
    """Both halves of each range; of an odd width the left one is the larger."""
    middle = F.col("from_block") + F.floor((F.col("to_block") - F.col("from_block")) / 2)
    both = F.array(F.struct(F.col("from_block").alias("from_block"), middle.alias("to_block")), F.struct((middle + 1).alias("from_block"), F.col("to_block").alias("to_block")))
    return ranges.select(F.explode(both).alias("r")).select("r.*")


def _outcomes(calls: DataFrame, retries: int) -> DataFrame:
    """Per range: its calls as landed, and the first that answered. Of calls with one number, one that answered counts."""
    counted = calls.where(F.col("attempt").between(0, retries)).groupBy("from_block", "to_block", "attempt").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("ok"))
    return counted.groupBy("from_block", "to_block").agg(F.count("*").alias("landed"), F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"))


def bisect(ranges: DataFrame, calls: DataFrame | Callable[[DataFrame], DataFrame], *, retries: int = 3, min_blocks: int = 1000) -> DataFrame:
    """(from_block, to_block, depth, status, calls, retries): every range that is asked for.

    ``calls`` is the landed table (from_block, to_block, attempt, ok) of calls, attempts from 0,
    or a function that gives it for a frontier. Calls after the first answer don't count, nor do
    repeated ranges. A range with fewer than ``retries + 1`` landed calls and no answer is
    pending: it is what to fetch next, and nothing below it is known. Files of the rounds stay
    for the result to be read, in a folder of the session's checkpoint folder.
    """
    if retries < 0 or min_blocks < 1:
        raise ValueError("retries are 0 or more and min_blocks is 1 or more")
    spark = ranges.sparkSession
    folder = f"{checkpoint_dir(spark)}/ranges-{uuid.uuid4().hex}"
    known = None if callable(calls) else written(_outcomes(calls, retries), f"{folder}/outcomes")
    frontier, depth = ranges.select(F.col("from_block").cast("bigint").alias("from_block"), F.col("to_block").cast("bigint").alias("to_block")).where("from_block <= to_block").distinct(), 0
    while True:
        asked = frontier.join(_outcomes(calls(frontier), retries) if known is None else known, ["from_block", "to_block"], "left")
        landed, won = F.coalesce("landed", F.lit(0)), F.col("won")
        wide = F.col("to_block") - F.col("from_block") + 1 > min_blocks
        status = F.when(won.isNotNull(), FETCHED).when(landed <= retries, PENDING).when(wide, SPLIT).otherwise(FAILED)
        made = F.when(won.isNotNull(), won + 1).otherwise(landed).cast("bigint")
        nodes = asked.select("from_block", "to_block", F.lit(depth).alias("depth"), status.alias("status"), made.alias("calls"), F.greatest(made - 1, F.lit(0)).cast("bigint").alias("retries"))
        done = written(nodes, f"{folder}/nodes/round={depth}")
        failed = done.where(F.col("status") == SPLIT)
        if failed.isEmpty():
            return spark.read.schema(_NODE).parquet(f"{folder}/nodes").select("from_block", "to_block", "depth", "status", "calls", "retries")
        frontier, depth = halves(failed), depth + 1


def counters(nodes: DataFrame) -> DataFrame:
    """One row: calls, retries, halved and failed ranges, and the blocks that no call gave."""
    width = F.col("to_block") - F.col("from_block") + 1
    is_ = lambda status: F.col("status") == status
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return nodes.agg(
        total("calls").alias("total_calls"),
        total("retries").alias("retries_attempted"),
        total("retries").alias("retried_chunks"),
        F.count_if(is_(SPLIT)).alias("split_chunks"),
        F.count_if(is_(FAILED)).alias("failed_chunks"),
        F.count_if(is_(FETCHED)).alias("fetched_chunks"),
        F.count_if(is_(PENDING)).alias("pending_chunks"),
        F.sum(F.when(is_(FAILED), width)).alias("failed_blocks"),
    )


def _located(ranges: DataFrame, rows: DataFrame, block: str) -> DataFrame:
    """``rows`` with the range that holds their block, for disjoint ranges of any widths.

    Ranges are keyed by their width's power of two and the two bins of that size they touch, and
    rows by their block's bin at each power that occurs (at most 63, in practice the rounds), so
    it is an equi-join and no range is compared with rows far from it.
    """
    power = F.ceil(F.log2((F.col("to_block") - F.col("from_block") + 1).cast("double"))).cast("int")
    sized = ranges.withColumn("power", power)
    powers = [r["power"] for r in sized.select("power").distinct().collect()]
    keyed = sized.select("*", F.explode(F.array_distinct(F.array(F.expr("shiftright(from_block, power)"), F.expr("shiftright(to_block, power)")))).alias("bin"))
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("power"), F.shiftright(F.col(block).cast("bigint"), p).alias("bin")) for p in powers])) if powers else F.explode(F.lit(None).cast("array<struct<power:int,bin:bigint>>"))
    spread = rows.where(F.col(block).isNotNull()).withColumn("__at", at).select("*", "__at.*").drop("__at")
    return spread.join(keyed, ["power", "bin"]).where(F.col(block).between(F.col("from_block"), F.col("to_block"))).drop("power", "bin")


def count_in_ranges(ranges: DataFrame, rows: DataFrame, *, block: str = "block_num") -> DataFrame:
    """(from_block, to_block, n): rows by block in each of disjoint ranges, counted per block first; empty ranges count 0."""
    given = ranges.select("from_block", "to_block")
    per_block = rows.groupBy(F.col(block).alias("block_num")).agg(F.count("*").alias("c"))
    found = _located(given, per_block, "block_num").groupBy("from_block", "to_block").agg(F.sum("c").alias("n"))
    return given.join(found, ["from_block", "to_block"], "left").select("from_block", "to_block", F.coalesce("n", F.lit(0)).alias("n"))


def rows_in_fetched(nodes: DataFrame, rows: DataFrame, *, block: str = "block_num") -> DataFrame:
    """The rows whose block lies in a range that was fetched; those of failed leaves are missing, as in the scan."""
    fetched = nodes.where(F.col("status") == FETCHED).select("from_block", "to_block")
    return _located(fetched, rows, block).select(*rows.columns)
