"""Bounded graph exports: identifiers and evidence, or identifiers and scored pairs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.scalar import short_label, strength_label
from linkweave.operators.linking import row_fanout
from linkweave.operators.metrics import cluster_sizes
from linkweave.operators.pairwise import score_evidence
from linkweave.runtime import checkpoint
from linkweave.schemas import BOUNDARY, FAN_OUT_CAP, GRAPH_EVIDENCE, GRAPH_IDENTIFIERS, KINDS, LinkageParams


def kind_ordinal(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def selected_clusters(members: DataFrame, max_identifiers: int = GRAPH_IDENTIFIERS) -> DataFrame:
    """(cluster_id, size) of the whole clusters that fit, walked by (size descending, id).

    A cluster larger than the bound never fits, and of those that can only ``max_identifiers``
    can be taken. Of the clusters of one size s only the first ``max // s`` in the walk can
    fit, so at most max·(1 + 1/2 + 1/3 + ...) candidates are folded in order, whatever the run's size.
    """
    able = cluster_sizes(members).where(F.col("size") <= max_identifiers)
    # the bound on the place is a literal, so each task keeps the first ids of each size before the shuffle
    place = F.row_number().over(Window.partitionBy("size").orderBy("cluster_id"))
    some = able.withColumn("place", place).where(F.col("place") <= max_identifiers).where(F.col("place") <= F.floor(F.lit(max_identifiers) / F.col("size")))
    walk = some.agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("loss"), "cluster_id"))).alias("walk"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<loss:bigint,cluster_id:string>>").alias("kept"))

    def take(s, c):
        fits = s["used"] - c["loss"] <= max_identifiers
        return F.struct(F.when(fits, s["used"] - c["loss"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["kept"], F.array(c))).otherwise(s["kept"]).alias("kept"))

    return walk.select(F.explode(F.aggregate("walk", start, take, lambda s: s["kept"])).alias("c")).select("c.cluster_id", (-F.col("c.loss")).alias("size"))


def identifier_nodes(members: DataFrame, max_identifiers: int = GRAPH_IDENTIFIERS) -> DataFrame:
    """(id, address, label, cluster_id); at most ``max_identifiers`` rows, so later joins broadcast them."""
    own = members.join(F.broadcast(selected_clusters(members, max_identifiers).select("cluster_id")), "cluster_id", "left_semi")
    return own.select(F.concat(F.lit("addr:"), F.col("address")).alias("id"), "address", short_label(F.col("address")).alias("label"), "cluster_id")


def evidence_nodes(evidence: DataFrame, identifiers: DataFrame, *, cap: int = FAN_OUT_CAP, max_evidence: int = GRAPH_EVIDENCE) -> DataFrame:
    """(id, kind, key, label, strength): the first keys on the identifiers by (kind order, key).

    Fan-out is that of the whole run, before anything is cut off.
    """
    services = row_fanout(evidence).where(F.col("fan_out") > cap).select("kind", "key")
    own = evidence.join(F.broadcast(identifiers.select("address")), "address", "left_semi").join(services, ["kind", "key"], "left_anti")
    nodes = own.groupBy("kind", "key").agg(F.max("strength").alias("strength"))
    first = nodes.orderBy(kind_ordinal(F.col("kind")), "key").limit(max_evidence)
    return first.select(F.concat(F.lit("ev:"), F.col("kind"), F.lit(":"), F.col("key")).alias("id"), "kind", "key", short_label(F.col("key")).alias("label"), strength_label(F.col("strength")).alias("strength"))


def _on_nodes(evidence: DataFrame, identifiers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both node tables are bounded by their limits and are broadcast."""
    ids = identifiers.select("address", F.col("id").alias("identifier_id"))
    evs = nodes.select("kind", "key", F.col("id").alias("evidence_id"))
    return evidence.join(F.broadcast(ids), "address").join(F.broadcast(evs), ["kind", "key"])


def links(evidence: DataFrame, identifiers: DataFrame, nodes: DataFrame) -> DataFrame:
    """One link per identifier and evidence node."""
    return _on_nodes(evidence, identifiers, nodes).groupBy("identifier_id", "evidence_id", "kind").agg(
        strength_label(F.max("strength")).alias("strength"), F.min("observed_block").alias("first_seen_block"), F.max("observed_block").alias("last_seen_block"), F.count("*").alias("attestation_count")
    )


def events(evidence: DataFrame, identifiers: DataFrame, nodes: DataFrame) -> DataFrame:
    """One event per evidence row; presented by (block, identifier, evidence, source)."""
    return _on_nodes(evidence, identifiers, nodes).select("identifier_id", "evidence_id", "kind", strength_label(F.col("strength")).alias("strength"), "source", "observed_block", F.col("key").alias("counterparty"), "payload_json")


def pairwise_links(evidence: DataFrame, identifiers: DataFrame, params: LinkageParams = LinkageParams(), *, cap: int = FAN_OUT_CAP, max_links: int = 2000) -> DataFrame:
    """Scored pairs among the identifiers that are not rejected; fan-out is that of the whole run.

    The identifiers are bounded by their limit; they are broadcast and restrict the keys before
    the self-join, so no pair outside them is ever built.
    """
    both = score_evidence(evidence, params, cap=cap, among=F.broadcast(identifiers.select("address").distinct()))
    kept = both.orderBy("address_a", "address_b").limit(max_links).where("tier <> 'rejected'")
    return kept.select(F.concat(F.lit("addr:"), "address_a").alias("source"), F.concat(F.lit("addr:"), "address_b").alias("target"), "tier", "score", "probability", "contributions", "anchor")


def pairwise_order() -> list:
    return [F.desc("tier"), F.desc("score"), F.col("source"), F.col("target")]


def cluster_context(identifiers: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per shown cluster: identifiers, visible links and evidence nodes, kinds that touch it."""
    sides = identifiers.select(F.col("id").alias("identifier_id"), "cluster_id").join(drawn, "identifier_id", "left")
    return sides.groupBy("cluster_id").agg(F.countDistinct("identifier_id").alias("n_identifiers"), F.count("evidence_id").alias("n_links"), F.countDistinct("evidence_id").alias("n_evidence_nodes"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def neighbourhood(drawn: DataFrame, node_id: str) -> DataFrame:
    """Links at a node and at the nodes next to it."""
    near = drawn.where((F.col("identifier_id") == node_id) | (F.col("evidence_id") == node_id)).select("evidence_id").distinct()
    return drawn.join(near, "evidence_id", "left_semi")


def same_run(summary: dict, document: dict) -> bool:
    """Whether a summary and a graph document are of one run."""
    return summary.get("run_id") is not None and summary["run_id"] == document.get("run", {}).get("run_id")


def evidence_graph(run: dict, evidence: DataFrame, members: DataFrame, *, cap: int = FAN_OUT_CAP, max_identifiers: int = GRAPH_IDENTIFIERS, max_evidence: int = GRAPH_EVIDENCE) -> dict:
    """The bounded document: every collected table is limited by the two bounds, but for the events of those nodes."""
    ids = checkpoint(identifier_nodes(members, max_identifiers))
    more = checkpoint(evidence_nodes(evidence, ids, cap=cap, max_evidence=max_evidence + 1))
    nodes = checkpoint(more.orderBy(kind_ordinal(F.col("kind")), "key").limit(max_evidence))
    rows = lambda df: [{k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()]
    oversized = [r["cluster_id"] for r in cluster_sizes(members).where(F.col("size") > max_identifiers).orderBy(F.desc("size"), "cluster_id").limit(20).collect()]
    n_services = row_fanout(evidence).where(F.col("fan_out") > cap).count()
    cut_ids, cut_evidence = ids.count() < members.count(), more.count() > max_evidence
    filters = [f"keys with more than {cap} rows in the run left out: {n_services}", "exchange wallets left out at extraction", "depth 1"]
    filters += [f"clusters above {max_identifiers} identifiers left out: {', '.join(oversized)}"] * bool(oversized) + [f"first {max_evidence} evidence nodes"] * cut_evidence
    identifiers = [{"id": r["id"], "kind": "identifier", "type": "address", "label": r["label"], "value": r["address"], "cluster_id": r["cluster_id"]} for r in rows(ids.orderBy("cluster_id", "address"))]
    evidences = [{"id": r["id"], "kind": "evidence", "type": r["kind"], "label": r["label"], "value": r["key"], "strength": r["strength"]} for r in rows(nodes.orderBy(kind_ordinal(F.col("kind")), "key"))]
    drawn = [{"source": r["identifier_id"], "target": r["evidence_id"], "type": r["kind"], **{k: r[k] for k in ("strength", "first_seen_block", "last_seen_block", "attestation_count")}} for r in rows(links(evidence, ids, nodes).orderBy("identifier_id", "evidence_id"))]
    told = [{"type": r.pop("kind"), **({"payload": json.loads(r.pop("payload_json"))} if "payload_json" in r else {}), **r} for r in rows(events(evidence, ids, nodes).orderBy("observed_block", "identifier_id", "evidence_id", "source"))]
    limits = {"max_identifier_nodes": max_identifiers, "max_evidence_nodes": max_evidence, "depth": 1, "fan_out_cap": cap, "truncated_identifiers": cut_ids, "truncated_evidence": cut_evidence, "applied_filters": filters}
    return {"graph_mode": "evidence", "run": run, "nodes": identifiers + evidences, "links": drawn, "evidence_events": told, "limits": limits, "boundary": BOUNDARY}


def pairwise_graph(run: dict, evidence: DataFrame, members: DataFrame, params: LinkageParams = LinkageParams(), *, cap: int = FAN_OUT_CAP, max_identifiers: int = GRAPH_IDENTIFIERS, max_links: int = 2000) -> dict:
    ids = checkpoint(identifier_nodes(members, max_identifiers))
    drawn = pairwise_links(evidence, ids, params, cap=cap, max_links=max_links).orderBy(*pairwise_order()).collect()
    nodes = [{"id": r["id"], "kind": "identifier", "type": "address", "label": r["label"], "value": r["address"], "cluster_id": r["cluster_id"]} for r in ids.orderBy("cluster_id", "address").collect()]
    found = [{"source": r["source"], "target": r["target"], "type": "pairwise", "tier": r["tier"], "score": r["score"], "link_probability": r["probability"], "contributions": r["contributions"], "deterministic_anchor": r["anchor"]} for r in drawn]
    limits = {"max_identifier_nodes": max_identifiers, "max_evidence_nodes": 0, "depth": 1, "fan_out_cap": cap, "max_pairwise_links": max_links, "truncated_identifiers": len(nodes) < members.count(), "truncated_evidence": False, "applied_filters": [f"keys with more than {cap} rows in the run left out", "rejected pairs left out"]}
    return {"graph_mode": "pairwise", "run": run, "nodes": nodes, "links": found, "limits": limits, "boundary": BOUNDARY}
