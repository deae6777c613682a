"""Cohorts: participants decoded from event logs, sampling, tiers and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.schemas import ZERO_ADDRESS


def merge_governance(voters: DataFrame, proposers: DataFrame) -> DataFrame:
    """(address, first_seen_block, seed_type): least block of both; a voter stays a voter."""
    rows = voters.select("address", "first_seen_block", F.lit(True).alias("voter")).unionByName(proposers.select("address", "first_seen_block", F.lit(False).alias("voter")))
    return rows.groupBy(F.lower(F.trim("address")).alias("address")).agg(F.min("first_seen_block").alias("first_seen_block"), F.when(F.bool_or("voter"), "voter").otherwise("proposer").alias("seed_type"))


def participants(transfers: DataFrame) -> DataFrame:
    """(address, first_block, n) over both ends; partial sums before the shuffle tame busy addresses."""
    ends = transfers.select(F.explode(F.array("from_addr", "to_addr")).alias("address"), "block_num")
    return ends.groupBy("address").agg(F.min("block_num").alias("first_block"), F.count("*").alias("n"))


def control_pool(seen: DataFrame, governance: DataFrame, *, service_fan_out: int = 1000, services: DataFrame | None = None) -> DataFrame:
    """Participants that may be controls: no zero address, governance seed, service or extreme fan-out."""
    pool = seen.where((F.col("address") != ZERO_ADDRESS) & (F.col("n") < service_fan_out)).join(governance.select("address"), "address", "left_anti")
    return pool if services is None else pool.join(services.select("address"), "address", "left_anti")


def capped_cohort(rows: DataFrame, most: int = 800, first: int = 500) -> DataFrame:
    """All rows, or, beyond ``most``, the first by (block, address)."""
    n = rows.limit(most + 1).count()
    return rows if n <= most else rows.orderBy("first_seen_block", "address").limit(first)


def size_bucket(n: Column) -> Column:
    return F.when(n < 300, "<300").when(n <= 800, "300-800").otherwise(">800")


def stratum(block: Column, start: int, end: int, strata: int) -> Column:
    """Equal-width stratum of a block, clamped into the window."""
    inside = F.greatest(F.lit(start), F.least(F.lit(end), block)) - start
    return F.least(F.lit(strata - 1).cast("bigint"), F.floor(inside * strata / F.lit(end - start + 1)).cast("bigint"))


def stratum_counts(rows: DataFrame, start: int, end: int, strata: int) -> DataFrame:
    """(stratum, n) with zeros for empty strata."""
    counted = rows.groupBy(stratum(F.col("first_seen_block"), start, end, strata).alias("stratum")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(strata).select(F.col("id").alias("stratum"))
    return every.join(F.broadcast(counted), "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("n"))


def stratified_sample(rows: DataFrame, start: int, end: int, strata: int, n: int) -> DataFrame:
    """``n`` rows: an equal quota per stratum by (block, address), the rest from all that is left, in that order.

    Every stratum's first ``n`` rows contain whatever can be chosen from it, and that bound is
    a literal, so tasks cut their strata before the shuffle; at most strata·n rows meet for the fill.
    """
    if n % strata:
        raise ValueError("n must be a multiple of strata")
    quota = n // strata
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("first_seen_block", "address"))
    placed = rows.withColumn("stratum", stratum(F.col("first_seen_block"), start, end, strata)).withColumn("place", place).where(F.col("place") <= n)
    first = placed.where(F.col("place") <= quota)
    spare = placed.where(F.col("place") > quota).orderBy("first_seen_block", "address").limit(n)
    fill = spare.withColumn("nth", F.row_number().over(Window.orderBy("first_seen_block", "address")))
    short = first.agg((F.lit(n) - F.count("*")).alias("short"))
    picked = fill.crossJoin(short).where("nth <= short").drop("nth", "short").withColumn("pass", F.lit("reserve"))
    return first.withColumn("pass", F.lit("quota")).unionByName(picked).drop("place")


def pool_hash(rows: DataFrame) -> DataFrame:
    """SHA-256 of the pool's lines in order. The pool is a cohort of bounded size, as it is one string."""
    line = F.concat_ws(",", "address", "first_seen_block")
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("pool_sha256"))


def cohort_sizes(members: DataFrame, cohort: DataFrame) -> DataFrame:
    """(cluster_id, size, n_governance, n_control)."""
    roles = cohort.groupBy("address").agg(F.bool_or(F.col("role") == "governance").alias("g"), F.bool_or(F.col("role") == "control").alias("c"))
    return members.join(roles, "address", "left").groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_if("g").alias("n_governance"), F.count_if("c").alias("n_control"))


def coordination_tiers(members: DataFrame, cohort: DataFrame) -> DataFrame:
    """Each cluster's tier by which cohorts it holds; control is looked at first."""
    size, g, c = F.col("size"), F.col("n_governance"), F.col("n_control")
    single = F.when(c == 1, "singleton_negative_control_reference").when(g == 1, "singleton_governance_seed").otherwise("singleton")
    several = (
        F.when(c == size, "multi_identifier_coordination_control_only")
        .when(g == size, "multi_identifier_coordination_governance_only")
        .when((g > 0) & (c > 0), "multi_identifier_coordination_mixed_governance_and_control")
        .otherwise("multi_identifier_coordination_candidate")
    )
    return cohort_sizes(members, cohort).withColumn("tier", F.when(size == 1, single).otherwise(several))


def service_dominated(members: DataFrame, shared: DataFrame, services: DataFrame, *, min_size: int = 950) -> DataFrame:
    """(cluster_id, dominated): a large cluster all of whose shared keys are suppressed. The pipeline halts on one."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    marked = shared.join(services.select("kind", "key", F.lit(True).alias("skipped")), ["kind", "key"], "left")
    keys = marked.groupBy("cluster_id").agg(F.count("*").alias("n_keys"), F.count_if(F.col("skipped").isNull()).alias("n_kept"))
    dominated = (F.col("size") >= min_size) & (F.coalesce("n_keys", F.lit(0)) > 0) & (F.coalesce("n_kept", F.lit(0)) == 0)
    return sizes.join(keys, "cluster_id", "left").select("cluster_id", "size", F.coalesce("n_keys", F.lit(0)).alias("n_keys"), F.coalesce("n_kept", F.lit(0)).alias("n_kept_keys"), dominated.alias("dominated"))


def cohort_comparison(members: DataFrame, cohort: DataFrame, features: DataFrame, *, burst_blocks: int = 5000) -> DataFrame:
    """Per role: share of addresses in clusters of several, median cluster size, and counts over pure clusters.

    ``features`` has cluster_id, funding_block_span, top_funder_share and top_sink_share.
    """
    sizes = cohort_sizes(members, cohort)
    own = cohort.select("address", "role").distinct().join(members, "address").join(sizes, "cluster_id")
    addresses = own.groupBy("role").agg(F.count("*").alias("n_addresses"), (F.count_if(F.col("size") > 1) / F.count("*")).alias("multi_rate"), F.median("size").cast("double").alias("median_cluster_size"))
    pure = sizes.where("size > 1 and (n_governance = size or n_control = size)").withColumn("role", F.when(F.col("n_control") == F.col("size"), "control").otherwise("governance"))
    f = pure.join(features, "cluster_id", "left")
    burst, funder, sink = (F.coalesce(c, F.lit(False)) for c in (F.col("funding_block_span") <= burst_blocks, F.col("top_funder_share") > 0.8, F.col("top_sink_share") > 0.8))
    counts = f.groupBy("role").agg(
        F.count("*").alias("pure_clusters"), F.count_if(burst).alias("short_burst"), F.count_if(funder).alias("top_funder"), F.count_if(sink).alias("common_sink"),
        F.count_if(burst | funder).alias("candidate_medium"), F.count_if((F.col("size") >= 3) & burst & funder).alias("candidate_high"),
    )
    return addresses.join(counts, "role", "left").fillna(0)
