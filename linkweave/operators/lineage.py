"""Lineage: how the clusters of one run follow from those of another."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.scalar import share_of_union
from linkweave.operators.components import connected_components
from linkweave.runtime import checkpoint, checkpoint_dir, is_empty, remove, written
from linkweave.schemas import RELATED, STABLE


@dataclass(frozen=True)
class RunWindow:
    run_id: str
    chain: str
    profile: str
    start_block: int
    end_block: int


#: Why lineage is skipped.
WINDOW_NOT_SET = "Lineage skipped because monitoring window is not set."
NO_PREVIOUS = "Lineage skipped because no previous comparable run exists."
PREVIOUS_WINDOW_NOT_SET = "Lineage skipped because the previous run's monitoring window is not set."
NOT_COMPARABLE = "Lineage skipped because chain or policy profile differ."


def skip_reason(current: RunWindow, previous: RunWindow | None) -> str | None:
    """Why the two runs cannot be compared, or None."""
    if current.start_block == 0 and current.end_block == 0:
        return WINDOW_NOT_SET
    if previous is None:
        return NO_PREVIOUS
    if previous.start_block == 0 and previous.end_block == 0:
        return PREVIOUS_WINDOW_NOT_SET
    if (current.chain, current.profile) != (previous.chain, previous.profile):
        return NOT_COMPARABLE
    return None


def overlaps(current: DataFrame, previous: DataFrame, related: float = RELATED) -> DataFrame:
    """(current_cluster_id, previous_cluster_id, overlap_count, jaccard) of clusters at least ``related``.

    An equi-join on the address: work in the number of addresses, not of cluster pairs. That
    needs a positive threshold, as clusters without a common address are never seen.
    """
    if related <= 0:
        raise ValueError("related must be positive")
    cur = current.select("address", F.col("cluster_id").alias("current_cluster_id"))
    prev = previous.select("address", F.col("cluster_id").alias("previous_cluster_id"))
    sizes = lambda df, c: df.groupBy(c).agg(F.count("*").alias(f"{c}_size"))
    common = cur.join(prev, "address").groupBy("current_cluster_id", "previous_cluster_id").agg(F.count("*").alias("overlap_count"))
    sized = common.join(sizes(cur, "current_cluster_id"), "current_cluster_id").join(sizes(prev, "previous_cluster_id"), "previous_cluster_id")
    jaccard = share_of_union(F.col("overlap_count"), F.col("current_cluster_id_size"), F.col("previous_cluster_id_size"))
    return sized.withColumn("jaccard", jaccard).where(F.col("jaccard") >= related).select("current_cluster_id", "previous_cluster_id", "overlap_count", "jaccard")


#: Rounds of mutual bests before components are looked for, and the candidates of a component that one task takes.
ROUNDS, FOLD = 2, 50_000
_SIDES = ["current_cluster_id", "previous_cluster_id"]


def _mutual(left: DataFrame) -> DataFrame:
    """The candidates that are first on both of their sides."""
    order = F.struct((-F.col("jaccard")).alias("j"), (-F.col("overlap_count")).alias("o"), F.col("current_cluster_id").alias("c"), F.col("previous_cluster_id").alias("p"))
    best = lambda side: left.groupBy(side).agg(F.min(order).alias("best")).select(F.col("best.c").alias("current_cluster_id"), F.col("best.p").alias("previous_cluster_id"))
    return left.join(best("current_cluster_id"), _SIDES, "left_semi").join(best("previous_cluster_id"), _SIDES, "left_semi")


def _without(left: DataFrame, won: DataFrame) -> DataFrame:
    for side in _SIDES:
        left = left.join(won.select(side), side, "left_anti")
    return left


def _fold(table: pa.Table) -> pa.Table:
    """The sequential greedy over the candidates of one component."""
    table = table.sort_by([("jaccard", "descending"), ("overlap_count", "descending"), ("current_cluster_id", "ascending"), ("previous_cluster_id", "ascending")])
    current, previous, kept = set(), set(), []
    for i, (c, p) in enumerate(zip(table["current_cluster_id"].to_pylist(), table["previous_cluster_id"].to_pylist(), strict=True)):
        if c not in current and p not in previous:
            current.add(c)
            previous.add(p)
            kept.append(i)
    return table.take(pa.array(kept, pa.int64())).drop_columns("component")


def greedy_matching(candidates: DataFrame, *, rounds: int = ROUNDS, fold: int = FOLD) -> DataFrame:
    """The one-to-one matching that takes candidates by (jaccard, overlap) descending, then ids.

    The order is total, so a candidate that is first on both of its sides is taken by the
    sequential greedy too, and a round takes all of those at once; that ends most matchings. A
    chain of falling overlaps would take a round a link, so what is left after ``rounds`` is cut
    into the components of the overlap graph, as no candidate acts on another component: those
    of up to ``fold`` candidates are finished by the sequential rule, each in one task, and only
    larger ones go through further rounds, which break them up. What a round takes is written
    and read at the end, so plans don't grow.
    """
    spark = candidates.sparkSession
    folder = f"{checkpoint_dir(spark)}/matching-{uuid.uuid4().hex}"
    left, turn = written(candidates, f"{folder}/left/0"), 0

    def taken(won: DataFrame) -> DataFrame:
        return written(won.select(*candidates.columns), f"{folder}/taken/round={turn}")

    def follow(rest: DataFrame) -> DataFrame:
        kept = written(rest.select(*candidates.columns), f"{folder}/left/{turn}")
        remove(spark, f"{folder}/left/{turn - 1}")
        return kept

    while not turn or not is_empty(left):
        for _ in range(rounds):
            won = taken(_mutual(left))
            turn += 1
            left = follow(_without(left, won))
        if is_empty(left):
            break
        edges = left.select(F.concat(F.lit("c"), "current_cluster_id").alias("a"), F.concat(F.lit("p"), "previous_cluster_id").alias("b"))
        of = connected_components(edges).where(F.col("node").startswith("c")).select(F.substr("node", F.lit(2)).alias("current_cluster_id"), "component")
        labelled = written(left.join(of, "current_cluster_id"), f"{folder}/labelled")
        small = labelled.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= fold).select("component")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in labelled.drop("component").schema)
        taken(labelled.join(small, "component", "left_semi").groupBy("component").applyInArrow(_fold, schema))
        turn += 1
        left = follow(labelled.join(small, "component", "left_anti"))
        remove(spark, f"{folder}/labelled")
    return spark.read.schema(candidates.schema).parquet(f"{folder}/taken").select(*candidates.columns)


def lineage(current: DataFrame, previous: DataFrame, *, current_run: str, previous_run: str, stable: float = STABLE, related: float = RELATED) -> DataFrame:
    """Rows of the table cluster_lineage: stable, related, new, disappeared.

    A cluster that had a candidate and lost it in the matching gives no row.
    """
    candidates = checkpoint(overlaps(current, previous, related))
    matched = greedy_matching(candidates).withColumn("transition_label", F.when(F.col("jaccard") >= stable, "stable").otherwise("related"))

    def without(members: DataFrame, side: str, other: str, label: str) -> DataFrame:
        ids = members.select(F.col("cluster_id").alias(side)).distinct().join(candidates.select(side), side, "left_anti")
        return ids.select(side, F.lit(None).cast("string").alias(other), F.lit(0).cast("bigint").alias("overlap_count"), F.lit(0.0).alias("jaccard"), F.lit(label).alias("transition_label"))

    rows = matched.unionByName(without(current, "current_cluster_id", "previous_cluster_id", "new")).unionByName(without(previous, "previous_cluster_id", "current_cluster_id", "disappeared"))
    return rows.select(F.lit(current_run).alias("current_run_id"), "current_cluster_id", F.lit(previous_run).alias("previous_run_id"), "previous_cluster_id", "overlap_count", "jaccard", "transition_label")


def lineage_order() -> list:
    return [F.col("transition_label"), F.col("current_cluster_id").asc_nulls_first(), F.col("previous_cluster_id").asc_nulls_first()]


def lineage_counts(rows: DataFrame) -> DataFrame:
    label = F.col("transition_label")
    return rows.agg(*[F.count_if(label == x).alias(x) for x in ("stable", "related", "new", "disappeared")], F.count("*").alias("total_rows"))


def latest_run(runs: DataFrame, *by: str) -> DataFrame:
    """The latest run, or the latest of each group; of equal times the larger run id."""
    row = F.struct(*runs.columns)
    picked = runs.groupBy(*by).agg(F.max_by(row, F.struct("created_at", "run_id")).alias("r"))
    return picked.select("r.*").where("run_id is not null")
