"""Pairwise linkage: candidate pairs by shared keys, features, additive score, probability, tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.scalar import logistic, min_overlap, share_of_union
from linkweave.schemas import FAN_OUT_CAP, LinkageParams


def usable_keys(evidence: DataFrame, cap: int = FAN_OUT_CAP) -> DataFrame:
    """(address, kind, key, fan_out), distinct, keys in lower case and without service keys."""
    rows = evidence.select("address", "kind", F.lower("key").alias("key"))
    fan = rows.groupBy("kind", "key").agg(F.count("*").alias("fan_out")).where(F.col("fan_out") <= cap)
    return rows.distinct().join(fan, ["kind", "key"]).select("address", "kind", "key", "fan_out")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(address_a, address_b, kind, key, fan_out) for each two addresses that share a key."""
    several = keys.where("fan_out >= 2")
    other = several.select(F.col("address").alias("address_b"), "kind", "key")
    return several.withColumnRenamed("address", "address_a").join(other, ["kind", "key"]).where("address_a < address_b").select("address_a", "address_b", "kind", "key", "fan_out")


def candidate_pairs(evidence: DataFrame, cap: int = FAN_OUT_CAP, limit: int | None = None) -> DataFrame:
    """Distinct pairs that share a usable key; a limit takes the first in address order."""
    pairs = shared_keys(usable_keys(evidence, cap)).select("address_a", "address_b").distinct()
    return pairs if limit is None else pairs.orderBy("address_a", "address_b").limit(limit)


def pairwise_features(evidence: DataFrame, params: LinkageParams = LinkageParams(), *, cap: int = FAN_OUT_CAP, pairs: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Shared counts per kind, owner overlaps and the funders' weight, for candidates or the given ``pairs``.

    ``pairs`` may hold pairs that share nothing; they get zeros. ``among``, a table of distinct
    addresses, keeps candidates to pairs of those before any pair is built; a key's fan-out
    stays that of all the evidence.
    """
    keys = usable_keys(evidence, cap)
    if among is not None:
        keys = keys.join(among.select("address"), "address", "left_semi")
    of = lambda kind: F.count_if(F.col("kind") == kind)
    weight = params.w_shared_funder / F.greatest(F.lit(1e-6), F.log(F.lit(max(params.funder_fanout_ln_offset, 1e-6)) + F.col("fan_out")))
    shared = shared_keys(keys).groupBy("address_a", "address_b").agg(
        of("did_controller").alias("shared_did"),
        of("safe_owner").alias("shared_owners"),
        of("ens_handle").alias("shared_ens"),
        of("funded_by").alias("shared_funders"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "funded_by", F.col("key")))), ",").alias("funder_list"),
        F.coalesce(F.sum(F.when(F.col("kind") == "funded_by", weight)), F.lit(0.0)).alias("funder_weight"),
    )
    if pairs is not None:
        wanted = pairs.select(F.least("address_a", "address_b").alias("address_a"), F.greatest("address_a", "address_b").alias("address_b")).distinct()
        shared = wanted.join(shared, ["address_a", "address_b"], "left").fillna(0).fillna("")
    owners = keys.where("kind = 'safe_owner'").groupBy("address").agg(F.count("*").alias("n"))
    side = lambda s: owners.select(F.col("address").alias(f"address_{s}"), F.col("n").alias(f"owners_{s}"))
    both = shared.join(side("a"), "address_a", "left").join(side("b"), "address_b", "left").fillna(0, ["owners_a", "owners_b"])
    common, a, b = F.col("shared_owners"), F.col("owners_a"), F.col("owners_b")
    return both.withColumn("owner_jaccard", share_of_union(common, a, b)).withColumn("owner_min_overlap", min_overlap(common, a, b))


def score_pairs(features: DataFrame, params: LinkageParams = LinkageParams()) -> DataFrame:
    """Contributions, score, probability and tier of each pair."""
    c = F.col
    overlap = F.when((F.lit(params.w_safe_owner_min_overlap) > 0) & (c("owner_min_overlap") > 0), params.w_safe_owner_min_overlap * c("owner_min_overlap"))
    jaccard = F.when(overlap.isNull() & (F.lit(params.w_safe_owner_jaccard) > 0) & (c("owner_jaccard") > 0), params.w_safe_owner_jaccard * c("owner_jaccard"))
    channels = {
        "did_controller_shared": F.when(c("shared_did") > 0, params.w_did_controller * c("shared_did")),
        "safe_owner_min_overlap": overlap,
        "safe_owner_jaccard": jaccard,
        "shared_safe_owner_count": F.when((F.lit(params.w_shared_safe_owner_count) > 0) & (c("shared_owners") > 0), params.w_shared_safe_owner_count * c("shared_owners")),
        "ens_handle_shared": F.when(c("shared_ens") > 0, F.lit(params.w_shared_ens_handle)),
        "funded_by_shared_downweighted": F.when(c("shared_funders") > 0, c("funder_weight")),
    }
    total = F.lit(0.0)
    for value in channels.values():
        total = total + F.coalesce(value, F.lit(0.0))
    entries = F.map_filter(F.create_map(*[x for name, value in channels.items() for x in (F.lit(name), value.cast("double"))]), lambda _, v: v.isNotNull())
    scored = features.withColumn("contributions", entries).withColumn("score", total)
    scored = scored.withColumn("anchor", c("shared_did") > 0).withColumn("structural", c("shared_did") + c("shared_owners") + c("shared_ens") + c("shared_funders") > 0)
    tier = F.when(c("anchor") | ((c("score") >= params.t_high) & c("structural")), "accepted").when(c("score") > params.t_low, "uncertain").otherwise("rejected")
    probability = logistic((c("score") - params.link_probability_mid) / max(params.link_probability_scale, 1e-6))
    return scored.withColumn("probability", probability).withColumn("tier", tier)


def score_evidence(evidence: DataFrame, params: LinkageParams = LinkageParams(), *, cap: int = FAN_OUT_CAP, pairs: DataFrame | None = None, limit: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """Candidate (or given) pairs, scored; with a limit, those first in address order."""
    chosen = candidate_pairs(evidence, cap, limit) if limit is not None and pairs is None else pairs
    return score_pairs(pairwise_features(evidence, params, cap=cap, pairs=chosen, among=among), params)


def contributions(scored: DataFrame) -> DataFrame:
    """Long form: a row per pair and channel that fired."""
    return scored.select("address_a", "address_b", F.explode("contributions").alias("channel", "weight"))
