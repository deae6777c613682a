"""Sizes and concentration of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count("*").alias("size"))


def concentration(sizes: DataFrame, threshold: float = 0.5, column: str = "size") -> DataFrame:
    """One row: clusters, addresses, ratio, Nakamoto coefficient and Gini index.

    Both measures only need how often each size occurs, so sizes are counted first and the
    running sums go over distinct sizes (at most about sqrt(2·total) of them) instead of
    over all clusters in one task.
    """
    x = F.col(column)
    histogram = sizes.where(x.isNotNull()).groupBy(x.cast("double").alias("x")).agg(F.count("*").alias("n"))
    # an array of at most sqrt(2·total) entries; folded in order
    whole = histogram.agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("up"))
    up = F.col("up")
    total = F.aggregate(up, F.lit(0.0), lambda s, e: s + e["x"] * e["n"])
    count = F.aggregate(up, F.lit(0).cast("bigint"), lambda s, e: s + e["n"])
    base = whole.select("up", total.alias("total"), count.alias("n"))
    limit = F.col("total") * threshold

    def take(s, e):
        missing = F.floor((limit - s["sum"]) / F.when(e["x"] > 0, e["x"])) + 1
        here = F.coalesce(missing <= e["n"], F.lit(False)) & s["k"].isNull()
        return F.struct((s["sum"] + e["x"] * e["n"]).alias("sum"), (s["seen"] + e["n"]).alias("seen"), F.when(here, s["seen"] + F.greatest(missing, F.lit(1).cast("bigint"))).otherwise(s["k"]).cast("bigint").alias("k"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("k"))
    nakamoto = F.aggregate(F.reverse("up"), start, take, lambda s: s["k"])
    # ranks of a run of n equal values after `seen` others sum to n·seen + n(n+1)/2
    ranked = F.aggregate("up", F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("seen")), lambda s, e: F.struct((s["sum"] + e["x"] * (e["n"] * s["seen"] + e["n"] * (e["n"] + 1) / 2)).alias("sum"), (s["seen"] + e["n"]).alias("seen")), lambda s: s["sum"])
    positive = (F.col("n") > 0) & (F.col("total") > 0)
    return base.select(
        F.col("n").alias("n_clusters"),
        F.col("total").cast("bigint").alias("n_addresses"),
        F.when(positive, F.col("total") / F.col("n")).alias("addresses_per_cluster"),
        F.when(positive, F.coalesce(nakamoto, F.col("n"))).alias("nakamoto"),
        F.when(positive, 2 * ranked / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).alias("gini"),
    )


def run_metrics(run_id: str, *, subjects: DataFrame, transfers: DataFrame, evidence: DataFrame, members: DataFrame, services: DataFrame) -> DataFrame:
    """The counters of one run as a single row."""
    sizes = cluster_sizes(members).agg(F.count("*").alias("cluster_count"), F.count_if(F.col("size") > 1).alias("multi_cluster_count"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_cluster"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    # each side is one row
    return sizes.crossJoin(count(subjects, "address_count")).crossJoin(count(transfers, "transfer_count")).crossJoin(count(evidence, "evidence_count")).crossJoin(count(services, "skipped_key_count")).select(F.lit(run_id).alias("run_id"), "address_count", "transfer_count", "evidence_count", "cluster_count", "multi_cluster_count", "skipped_key_count", "largest_cluster")
