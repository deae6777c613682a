"""Evaluation against gold pairs: confusion, precision at k, ablations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.operators.evidence import ABLATIONS, ablate
from linkweave.operators.linking import clusters, service_keys
from linkweave.operators.pairwise import score_evidence
from linkweave.schemas import LEGACY, PRECISION_AT, LinkageParams, MergePolicy


def gold_addresses(gold: DataFrame) -> DataFrame:
    return gold.select(F.explode(F.array("address_a", "address_b")).alias("address")).distinct()


def judge_pairs(gold: DataFrame, members: DataFrame, scored: DataFrame) -> DataFrame:
    """Gold pairs with ``merged`` (same cluster; unknown addresses are not) and the score's verdict.

    Clusters are looked up for gold endpoints only.
    """
    ends = members.join(gold_addresses(gold), "address", "left_semi")
    side = lambda s: ends.select(F.col("address").alias(f"address_{s}"), F.col("cluster_id").alias(f"cluster_{s}"))
    pairs = gold.join(side("a"), "address_a", "left").join(side("b"), "address_b", "left")
    verdict = scored.select("address_a", "address_b", "score", (F.col("anchor") | (F.col("tier") == "accepted")).alias("positive"))
    both = pairs.join(verdict, ["address_a", "address_b"], "left")
    return both.select("address_a", "address_b", "label", F.coalesce(F.col("cluster_a") == F.col("cluster_b"), F.lit(False)).alias("merged"), F.coalesce("positive", F.lit(False)).alias("positive"), F.coalesce("score", F.lit(0.0)).alias("score"))


def confusion(judged: DataFrame, *by: str) -> DataFrame:
    """tp, fp, tn and fn of both predictors, and the pairs that are ambiguous, in one aggregation."""
    same, different = F.col("label") == "same_control", F.col("label") == "different_control"
    cells: list[Column] = []
    for name, hit in (("rule", F.col("merged")), ("score", F.col("positive"))):
        cells += [F.count_if(same & hit).alias(f"{name}_tp"), F.count_if(different & hit).alias(f"{name}_fp"), F.count_if(different & ~hit).alias(f"{name}_tn"), F.count_if(same & ~hit).alias(f"{name}_fn")]
    return judged.groupBy(*by).agg(*cells, F.count_if(F.col("label") == "uncertain").alias("ambiguous"))


def precision_at_k(judged: DataFrame, *by: str) -> DataFrame:
    """(k, precision) for each k up to the number of pairs that are not uncertain.

    Only the largest k of PRECISION_AT pairs can matter, so the rest is cut off before the shuffle.
    """
    sure = judged.where("label <> 'uncertain'")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "address_a", "address_b")
    ranked = sure.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(PRECISION_AT))
    running = F.sum((F.col("label") == "same_control").cast("bigint")).over(Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("hits", running).where(F.col("k").isin(*PRECISION_AT)).select(*by, F.col("k").cast("bigint").alias("k"), (F.col("hits") / F.col("k")).alias("precision"))


def run_ablation(mode: str, gold: DataFrame, evidence: DataFrame, *, policy: MergePolicy = LEGACY, min_evidence: int = 2, params: LinkageParams = LinkageParams()) -> dict[str, DataFrame]:
    """One mode: clusters of the gold endpoints by the kept evidence, judged pairs, and counts."""
    subjects = gold_addresses(gold)
    kept = ablate(evidence, mode).join(subjects, "address", "left_semi")
    members = clusters(subjects, kept, policy, min_evidence)
    judged = judge_pairs(gold, members, score_evidence(kept, params, pairs=gold)).withColumn("mode", F.lit(mode))
    n_clusters = members.agg(F.countDistinct("cluster_id").alias("cluster_count"))
    counts = n_clusters.crossJoin(service_keys(kept, policy).agg(F.count("*").alias("skipped_keys"))).select(F.lit(mode).alias("mode"), "cluster_count", "skipped_keys")
    return {"judged": judged, "counts": counts}


def evaluate(gold: DataFrame, evidence: DataFrame, modes: list[str] | None = None, **options: object) -> dict[str, DataFrame]:
    """Confusion, precision at k and counts of several modes, each as one table."""
    runs = [run_ablation(m, gold, evidence, **options) for m in modes or list(ABLATIONS)]
    union = lambda name: reduce(DataFrame.unionByName, [r[name] for r in runs])
    judged = union("judged")
    return {"confusion": confusion(judged, "mode"), "precision": precision_at_k(judged, "mode"), "counts": union("counts")}
