"""Clusters kept up to date as claims arrive, batch by batch.

A batch can change only the pairs that share one of its keys. Claims are inserted and never
changed, and every condition of the merge rule is a lower bound, so such a pair can only come
to pass; a pair is withdrawn only when a key that it shares crosses its fan-out cap. So a batch

- finds the pairs of its linking keys and tests them with all the keys they share,
- contracts known components to one node each and closes the small graph of the new edges,
- and where keys crossed their cap, takes the components on those keys apart and closes them
  again from their own claims; no other component is looked at.

Only members whose component changes are written, as (address, component, batch) rows behind the
older ones; the last row of an address counts, and :meth:`IncrementalLinks.compact` makes one
row of them. All of a batch is published together with its number, so a batch that is repeated
after a failure does nothing. The stored claims are scanned for the batch's keys and addresses,
but only rows of those are shuffled: a popular key costs at most its cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from linkweave.operators.components import connected_components
from linkweave.operators.linking import is_service, merges, pair_stats
from linkweave.runtime import checkpoint
from linkweave.schemas import CONSERVATIVE, TABLES, MergePolicy
from linkweave.sources.store import Store, insert_or_ignore_evidence

CLAIMS, COMPONENTS = "link_claims", "link_components"
_KEY = ["kind", "key"]


class IncrementalLinks:
    """Clusters of all addresses that have a claim, equal to a full link of the claims so far."""

    def __init__(self, store: Store, policy: MergePolicy = CONSERVATIVE, min_evidence: int = 1, *, stream: str = "links") -> None:
        self.store, self.policy, self.min_evidence, self.stream = store, policy, min_evidence, stream

    # state

    def _table(self, name: str, schema: StructType | str) -> DataFrame:
        return self.store.read(name) if self.store.exists(name) else self.store.spark.createDataFrame([], schema)

    def claims(self) -> DataFrame:
        return self._table(CLAIMS, TABLES["evidence"])

    def _log(self) -> DataFrame:
        return self._table(COMPONENTS, "address string, component string, batch long")

    def clusters(self) -> DataFrame:
        """(cluster_id, address) as of the last batch."""
        return self._last(self._log()).select(F.col("component").alias("cluster_id"), "address")

    @staticmethod
    def _last(log: DataFrame) -> DataFrame:
        return log.groupBy("address").agg(F.max_by("component", "batch").alias("component"))

    def components_of(self, addresses: DataFrame) -> DataFrame:
        """(address, component) of those of ``addresses`` that are known; only their rows are shuffled."""
        return self._last(self._log().join(addresses.select("address").distinct(), "address", "left_semi"))

    def members_of(self, components: DataFrame) -> DataFrame:
        """(address, component) of the members of some components."""
        once = self._log().join(components, "component", "left_semi").select("address").distinct()
        return self.components_of(once).join(components, "component", "left_semi").select("address", "component")

    def compact(self) -> None:
        """One row for each address, one version for each table."""
        with self.store.transaction():
            self.store.replace(COMPONENTS, self._last(self._log()).withColumn("batch", F.lit(-1).cast("bigint")))
            self.store.compact(CLAIMS)

    # a batch

    def _linking(self, fan_out: DataFrame) -> DataFrame:
        return fan_out.where((F.col("fan_out") >= 2) & ~is_service(self.policy)).select(*_KEY)

    def _edges(self, claims: DataFrame, addresses: DataFrame, keys: DataFrame | None) -> DataFrame:
        """Passing pairs among ``addresses``; with ``keys``, only pairs that share one of them.

        Which keys link is told by all claims, what a pair shares by the claims of its two.
        """
        own = checkpoint(claims.join(addresses, "address", "left_semi"))
        fan_out = claims.join(own.select(*_KEY).distinct(), _KEY, "left_semi").groupBy(*_KEY).agg(F.count("*").alias("fan_out"))
        linking = checkpoint(self._linking(fan_out))
        shared = own.join(linking, _KEY, "left_semi")
        if keys is None:
            return self._passing(shared)
        near = shared.join(keys, _KEY, "left_semi").select(*_KEY, "address").distinct()
        pairs = checkpoint(near.withColumnRenamed("address", "address_a").join(near.withColumnRenamed("address", "address_b"), _KEY).where("address_a < address_b").select("address_a", "address_b").distinct())
        return self._passing(shared).join(pairs, ["address_a", "address_b"], "left_semi")

    def _passing(self, shared: DataFrame) -> DataFrame:
        return pair_stats(shared, self.policy, keys_link=True).where(merges(self.policy, self.min_evidence)).select("address_a", "address_b")

    def update(self, batch: DataFrame, number: int) -> int:
        """Take in one batch of claims (columns of the table evidence); the number of members whose component changed."""
        with self.store.transaction():
            if not self.store.once(self.stream, number):
                return 0
            return self._update(batch, number)

    def _update(self, batch: DataFrame, number: int) -> int:
        before = self.claims()
        new = checkpoint(insert_or_ignore_evidence(before, batch.select(*before.columns)))
        if new.isEmpty():
            return 0
        keys = new.select(*_KEY).distinct()
        self.store.append(CLAIMS, new)
        claims = self.claims()
        counts = new.groupBy(*_KEY).agg(F.count("*").alias("added")).join(claims.join(keys, _KEY, "left_semi").groupBy(*_KEY).agg(F.count("*").alias("fan_out")), _KEY)
        counts = checkpoint(counts)
        now = self._linking(counts)
        was = self._linking(counts.withColumn("fan_out", F.col("fan_out") - F.col("added")))
        withdrawn = checkpoint(was.join(now, _KEY, "left_anti"))

        on = lambda some: claims.join(some, _KEY, "left_semi").select("address").distinct()
        edges = self._edges(claims, on(now), now)
        known = self._log()
        fresh = new.select("address").distinct().join(known.select("address").distinct(), "address", "left_anti")
        apart = None
        if not withdrawn.isEmpty():
            apart = checkpoint(self.members_of(self.components_of(on(withdrawn)).select("component").distinct()))
            edges = edges.unionByName(self._edges(claims, apart.select("address"), None)).distinct()
        edges = checkpoint(edges)

        # an edge's end is its component, or the address itself where that is new or taken apart
        ends = edges.select(F.explode(F.array("address_a", "address_b")).alias("address")).distinct()
        of = self.components_of(ends)
        if apart is not None:
            of = of.join(apart.select("address"), "address", "left_anti")
        of = checkpoint(of)
        as_node = lambda side: of.select(F.col("address").alias(f"address_{side}"), F.col("component").alias(f"c_{side}"))
        contracted = edges.join(as_node("a"), "address_a", "left").join(as_node("b"), "address_b", "left").select(F.coalesce("c_a", "address_a").alias("a"), F.coalesce("c_b", "address_b").alias("b")).where("a <> b").distinct()
        closed = connected_components(contracted).withColumnRenamed("component", "into")

        moved = closed.where("node <> into").select(F.col("node").alias("component"), "into")
        whole = self.members_of(moved.select("component"))
        if apart is not None:
            whole = whole.join(apart.select("address"), "address", "left_anti")
        changed = whole.join(moved, "component").select("address", F.col("into").alias("component"))
        alone = fresh if apart is None else fresh.unionByName(apart.select("address")).distinct()
        placed = alone.join(closed.withColumnRenamed("node", "address"), "address", "left").select("address", F.coalesce("into", "address").alias("component"))
        if apart is not None:
            placed = placed.join(apart, ["address", "component"], "left_anti")
        return self.store.append(COMPONENTS, changed.unionByName(placed).withColumn("batch", F.lit(number).cast("bigint")))

    def run(self, claims: DataFrame, checkpoint_location: str) -> StreamingQuery:
        """Keep the clusters of a stream of claims, for each batch once."""

        def take(batch: DataFrame, number: int) -> None:
            self.update(batch, number)

        return claims.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()
