"""Linking: shared keys make pairs, pairs pass a merge rule, passing pairs make clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.operators.components import connected_components
from linkweave.schemas import LEGACY, MEDIUM, STRONG, WEAK, MergePolicy


def key_fanout(evidence: DataFrame) -> DataFrame:
    """(kind, key, fan_out, n_addresses): rows, and distinct addresses, of each key."""
    per_address = evidence.groupBy("kind", "key", "address").agg(F.count("*").alias("n"))
    return per_address.groupBy("kind", "key").agg(F.sum("n").alias("fan_out"), F.count("*").alias("n_addresses"))


def row_fanout(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("kind", "key").agg(F.count("*").alias("fan_out"))


def is_service(policy: MergePolicy) -> Column:
    """Whether a key of :func:`row_fanout` is suppressed."""
    over = F.col("fan_out") > policy.fan_out_cap
    if policy.conservative:
        funded = F.col("kind") == "funded_by"
        over = over | (funded & ((F.col("fan_out") > policy.funded_fan_out_cap) | F.col("key").isin(*policy.suppressed)))
    return over


def service_keys(evidence: DataFrame, policy: MergePolicy) -> DataFrame:
    """(kind, key, fan_out) of suppressed keys that would have linked something."""
    return row_fanout(evidence).where((F.col("fan_out") >= 2) & is_service(policy))


def linking_keys(evidence: DataFrame, policy: MergePolicy) -> DataFrame:
    """(kind, key, fan_out) of the keys that may link: at least two rows, not suppressed."""
    return row_fanout(evidence).where((F.col("fan_out") >= 2) & ~is_service(policy))


def shared_rows(evidence: DataFrame, policy: MergePolicy, *, keys_link: bool = False) -> DataFrame:
    """A row for each pair of claims of different addresses on a linking key, the smaller address first.

    The cap bounds each key's rows, and capped keys go before the self-join, so a key yields at
    most cap·(cap-1)/2 rows whatever its popularity was. With ``keys_link`` the claims are known
    to be on linking keys only, as where they are a part of all claims.
    """
    linking = evidence if keys_link else evidence.join(linking_keys(evidence, policy).select("kind", "key"), ["kind", "key"], "left_semi")
    kept = linking.select("kind", "key", "address", "strength", F.col("observed_block").alias("block"))
    other = kept.select("kind", "key", F.col("address").alias("address_b"), F.col("strength").alias("strength_b"), F.col("block").alias("block_b"))
    pairs = kept.withColumnRenamed("address", "address_a").join(other, ["kind", "key"]).where("address_a < address_b")
    return pairs.select("address_a", "address_b", "kind", "key", F.greatest("strength", "strength_b").alias("strength"), F.abs(F.col("block") - F.col("block_b")).alias("block_delta"))


def pair_stats(evidence: DataFrame, policy: MergePolicy, *, keys_link: bool = False) -> DataFrame:
    """Per pair: rows, strongest, the same without funding, distinct funders, bursts."""
    funded = F.col("kind") == "funded_by"
    return shared_rows(evidence, policy, keys_link=keys_link).groupBy("address_a", "address_b").agg(
        F.count("*").alias("n_edges"),
        F.max("strength").alias("max_strength"),
        F.count_if(~funded).alias("nf_edges"),
        F.coalesce(F.max(F.when(~funded, F.col("strength"))), F.lit(WEAK)).alias("nf_max"),
        F.size(F.collect_set(F.when(funded, F.col("key")))).cast("bigint").alias("funded_keys"),
        F.count_if(funded & (F.col("block_delta") <= policy.burst_blocks)).alias("burst_hits"),
    )


def merges(policy: MergePolicy, min_evidence: int) -> Column:
    """The merge rule over :func:`pair_stats`."""
    needed = max(1, min_evidence)
    if not policy.conservative:
        return (F.col("max_strength") == STRONG) | ((F.col("n_edges") >= needed) & (F.col("max_strength") >= MEDIUM))
    return (
        (F.col("nf_max") == STRONG)
        | ((F.col("nf_edges") >= 1) & (F.col("nf_max") >= MEDIUM) & (F.col("nf_edges") + F.col("funded_keys") >= needed))
        | ((F.col("funded_keys") >= policy.min_shared_keys) & (F.col("burst_hits") >= policy.min_burst_hits))
    )


def merge_edges(evidence: DataFrame, policy: MergePolicy, min_evidence: int) -> DataFrame:
    return pair_stats(evidence, policy).where(merges(policy, min_evidence)).select("address_a", "address_b")


def clusters(subjects: DataFrame, evidence: DataFrame, policy: MergePolicy = LEGACY, min_evidence: int = 1) -> DataFrame:
    """(cluster_id, address) for every subject; a cluster's id is its smallest address.

    Evidence of other addresses links nothing; an address without a merge is its own cluster.
    """
    own = evidence.join(subjects.select("address"), "address", "left_semi")
    found = connected_components(merge_edges(own, policy, min_evidence), "address_a", "address_b")
    return subjects.select("address").distinct().join(found.withColumnRenamed("node", "address"), "address", "left").select(F.coalesce("component", "address").alias("cluster_id"), "address")


def cluster_shared_keys(evidence: DataFrame, members: DataFrame, policy: MergePolicy) -> DataFrame:
    """(cluster_id, kind, key): keys that two members share, whether or not the pair passed the rule.

    Counting members per (cluster, key) finds them without the pairs.
    """
    own = evidence.join(linking_keys(evidence, policy).select("kind", "key"), ["kind", "key"], "left_semi").select("kind", "key", "address").distinct()
    return own.join(members, "address").groupBy("cluster_id", "kind", "key").agg(F.count("*").alias("n_members")).where("n_members >= 2").select("cluster_id", "kind", "key", "n_members")
