"""Bounded fetches over landed transfers: pages, legs, and the caps that end them.

A fetch asks for one seed's transfers in one direction, page by page. It ends after the page in
which it has met enough other addresses, at the row that fills its row cap, or when its pages
are used up; so a stop by addresses keeps the rest of its page. The incoming leg comes first and
the outgoing one gets the rows that are left. Legs are fetches of their own with their own set
of addresses (``legs="apart"``, a cohort run), or one fetch that remembers what its first leg
has seen (``legs="together"``).

Every count is a running sum along (seed, direction): raw rows give the page, first copies of a
transfer the rows so far, first copies of an address the addresses so far, and the first page
that reaches a cap is a minimum. No loop over pages or seeds is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A transfer within a fetch; nulls count as blanks.
IDENTITY = ("tx_hash", "from_addr", "to_addr", "asset", "value")
INCOMING, OUTGOING = 0, 1


@dataclass(frozen=True)
class Caps:
    max_rows: int = 250
    max_pages: int = 30
    max_peers: int | None = 220
    page_size: int = 1000


def _legs(transfers: DataFrame, seeds: DataFrame, legs: tuple[int, ...]) -> DataFrame:
    wanted = seeds.select(F.col("address").alias("seed")).distinct()
    ends = {INCOMING: ("to_addr", "from_addr"), OUTGOING: ("from_addr", "to_addr")}
    parts = [transfers.join(wanted, F.col(ends[leg][0]) == F.col("seed")).select("seed", F.lit(leg).alias("direction"), F.col(ends[leg][1]).alias("peer"), *IDENTITY, "block_num") for leg in legs]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _scan(transfers: DataFrame, seeds: DataFrame, caps: Caps, legs: tuple[int, ...], together: bool) -> DataFrame:
    """Each leg's raw rows up to one beyond its pages, with ``kept`` and the pages at which the caps trip.

    The bound is a literal on a row number, so tasks cut busy seeds before the shuffle; behind
    it a leg is max_pages x page_size rows at most.
    """
    leg, seed = ["seed", "direction"], ["seed"]
    order = [F.col(c).asc_nulls_first() for c in ("block_num", *IDENTITY)]
    rows = _legs(transfers, seeds, legs).withColumn("r", F.row_number().over(Window.partitionBy(*leg).orderBy(*order))).where(F.col("r") <= caps.max_pages * caps.page_size + 1)
    rows = rows.withColumn("page", F.floor((F.col("r") - 1) / caps.page_size)).withColumns({f"k_{c}": F.coalesce(c, F.lit("")) for c in IDENTITY})
    keys = [f"k_{c}" for c in IDENTITY]
    within = F.col("page") < caps.max_pages
    first = lambda over, when=None: F.min(F.col("r") if when is None else F.when(when, F.col("r"))).over(Window.partitionBy(*over)) == F.col("r")
    so_far = lambda flag: F.sum(flag.cast("bigint")).over(Window.partitionBy(*leg).orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    unlimited = F.lit(None).cast("bigint")

    def tripped(rows: DataFrame, of: Column, cap: Column, seen: Column = F.lit(0)) -> DataFrame:
        """The leg with ``of`` (its row cap) applied: rows and addresses so far, and the page each cap trips at."""
        rows = rows.withColumn("n_rows", so_far(F.col("fresh"))).withColumn("cap", of)
        rows = rows.withColumn("taken", F.col("fresh") & (F.col("n_rows") <= F.col("cap")))
        rows = rows.withColumn("met", F.col("taken") & first([*leg, "peer"], F.col("taken")) & ~F.col("known_peer"))
        rows = rows.withColumn("n_peers", so_far(F.col("met")) + seen)
        at = lambda reached: F.min(F.when(within & reached, F.col("page"))).over(Window.partitionBy(*leg))
        rows = rows.withColumn("row_page", at(F.col("taken") & (F.col("n_rows") == F.col("cap"))))
        # an address may be met in the first leg already, so every row of a page counts for its page
        rows = rows.withColumn("peer_page", unlimited if caps.max_peers is None else at((F.col("n_peers") >= cap) & (F.col("n_rows") <= F.col("cap"))))
        last = F.least(F.coalesce("row_page", F.lit(caps.max_pages)), F.coalesce("peer_page", F.lit(caps.max_pages)), F.lit(caps.max_pages - 1))
        return rows.withColumn("last", last).withColumn("kept", F.col("taken") & (F.col("page") <= F.col("last")))

    peers = F.lit(caps.max_peers).cast("bigint")
    fresh = rows.withColumn("fresh", first([*leg, *keys])).withColumn("known_peer", F.lit(False))
    one = tripped(fresh, F.lit(caps.max_rows).cast("bigint"), peers)
    if len(legs) == 1:
        return one
    own = Window.partitionBy(*seed)
    is_in = F.col("direction") == INCOMING
    two = one.withColumn("before", F.coalesce(F.sum((is_in & F.col("kept")).cast("bigint")).over(own), F.lit(0)))
    seen = F.lit(0)
    if together:
        held = is_in & F.col("kept")
        again = F.max(held).over(Window.partitionBy("seed", *keys))
        met = F.max(held).over(Window.partitionBy("seed", "peer"))
        two = two.withColumn("fresh", F.col("fresh") & (is_in | ~again)).withColumn("known_peer", ~is_in & met)
        two = two.withColumn("seen", F.when(is_in, 0).otherwise(F.coalesce(F.sum((held & F.col("met")).cast("bigint")).over(own), F.lit(0))))
        seen = F.col("seen")
    cap = F.when(is_in, F.lit(caps.max_rows).cast("bigint")).otherwise(F.lit(caps.max_rows) - F.col("before"))
    return tripped(two, cap, peers, seen).withColumn("kept", F.col("kept") & (F.col("cap") > 0))


def bounded_fetch(transfers: DataFrame, seeds: DataFrame, caps: Caps = Caps(), *, start: int | None = None, end: int | None = None, direction: int | None = None, legs: str = "apart") -> tuple[DataFrame, DataFrame]:
    """(rows, fetches) of every seed.

    Rows: seed, direction, position, page and the transfer, as kept. Fetches: one row for each
    seed and leg that is fetched at all, with n_rows, calls, pages, and whether the cap of rows,
    pages or addresses stopped it. A leg without rows is one call; pages count the one that a
    page cap refuses. An outgoing leg for which no row is left is no fetch when legs are apart,
    and ends at once by its row cap when they are together. Rows of unknown block are in no
    window; within a fetch, rows come by block, then by their other columns.
    """
    if legs not in ("apart", "together"):
        raise ValueError(f"legs are apart or together, not {legs!r}")
    known = transfers if start is None else transfers.where(F.col("block_num").between(start, end))
    sides = (INCOMING, OUTGOING) if direction is None else (direction,)
    scanned = _scan(known, seeds, caps, sides, legs == "together")
    position = F.row_number().over(Window.partitionBy("seed").orderBy("direction", "r"))
    rows = scanned.where("kept").withColumn("position", position).select("seed", "direction", "position", "page", "from_addr", "to_addr", "value", "block_num", "tx_hash", "asset")
    by_leg = scanned.groupBy("seed", "direction").agg(F.count_if("kept").alias("n_rows"), F.min("row_page").alias("row_page"), F.min("peer_page").alias("peer_page"), F.min("last").alias("last"), F.max("page").alias("pages"), F.min("cap").alias("cap"))
    every = seeds.select(F.col("address").alias("seed")).distinct().select("seed", F.explode(F.array(*map(F.lit, sides))).alias("direction"))
    all_legs = every.join(by_leg, ["seed", "direction"], "left")
    taken_in = F.sum(F.when(F.col("direction") == INCOMING, F.coalesce("n_rows", F.lit(0))).otherwise(0)).over(Window.partitionBy("seed"))
    room = F.when(F.col("direction") == INCOMING, F.lit(caps.max_rows)).otherwise(F.lit(caps.max_rows) - taken_in) if len(sides) == 2 else F.lit(caps.max_rows)
    row_cap = F.col("row_page").isNotNull() & (F.col("row_page") <= F.col("last")) | (F.col("room") <= 0)
    peer_cap = F.col("peer_page").isNotNull() & (F.col("peer_page") <= F.col("last")) & (F.col("room") > 0)
    page_cap = ~F.coalesce(row_cap, F.lit(False)) & ~F.coalesce(peer_cap, F.lit(False)) & (F.col("pages") >= caps.max_pages)
    calls = F.when(F.col("room") <= 0, 0).otherwise(F.coalesce(F.least("last", "pages"), F.lit(0)) + 1).cast("bigint")
    counted = all_legs.withColumn("room", room).withColumns({"row_cap": F.coalesce(row_cap, F.lit(False)), "peer_cap": F.coalesce(peer_cap, F.lit(False)), "page_cap": F.coalesce(page_cap, F.lit(False)), "calls": calls})
    done = counted if legs == "together" else counted.where("room > 0")
    return rows, done.select("seed", "direction", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), "calls", (F.col("calls") + F.col("page_cap").cast("bigint")).alias("pages"), "row_cap", "page_cap", "peer_cap")


def cap_hits(fetches: DataFrame, *, bias_share: float = 0.2) -> DataFrame:
    """Fetches that each cap ended, their calls, and whether the hits exceed ``bias_share`` of the seeds."""
    hits = F.count_if("row_cap") + F.count_if("page_cap") + F.count_if("peer_cap")
    share = F.coalesce(hits / F.nullif(F.countDistinct("seed"), F.lit(0)), F.lit(0.0))
    return fetches.agg(
        F.count_if("row_cap").alias("row_cap_hits"),
        F.count_if("page_cap").alias("page_cap_hits"),
        F.count_if("peer_cap").alias("peer_cap_hits"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        (share > bias_share).alias("bias_risk"),
    )
