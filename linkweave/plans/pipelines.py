"""End-to-end plans over a store: ingest, link, metrics, report, graph, scoring, evaluation, cohort run."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators import audit, baseline, cohort, evaluation, features, graph, lineage, linking, metrics, pairwise, ranges, report
from linkweave.operators.evidence import extract_all, normalize_subjects, parse_ablations
from linkweave.runtime import checkpoint
from linkweave.schemas import BOUNDARY, CONSERVATIVE, KINDS, LEGACY, RELATED, STABLE, LinkageParams, MergePolicy
from linkweave.sources import landed, pages
from linkweave.sources.store import Store, upsert_addresses


def new_run_id() -> str:
    return f"run-{time.time_ns() // 1000}"


def ingest(store: Store, *, transfers: DataFrame | None = None, ens: DataFrame | None = None, owners: DataFrame | None = None, documents: DataFrame | None = None, subjects: DataFrame | None = None) -> dict[str, int]:
    """Store facts, all or none; owners, controllers and funders never become subjects. Returns rows inserted."""
    with store.transaction():
        return _ingest(store, transfers, ens, owners, documents, subjects)


def _ingest(store: Store, transfers: DataFrame | None, ens: DataFrame | None, owners: DataFrame | None, documents: DataFrame | None, subjects: DataFrame | None) -> dict[str, int]:
    counts = {}
    if subjects is not None:
        rows = subjects.select(F.lower("address").alias("address"), *[F.col(c) if c in subjects.columns else F.lit(None).cast(t).alias(c) for c, t in (("first_seen_block", "bigint"), ("label", "string"))])
        if transfers is not None:
            seen = transfers.join(rows.select("address"), F.col("to_addr") == F.col("address"), "left_semi").select(F.col("to_addr").alias("address"), F.col("block_num").alias("first_seen_block"), F.lit(None).cast("string").alias("label"))
            rows = rows.unionByName(seen)
        store.replace("addresses", upsert_addresses(store.read("addresses"), rows))
        counts["addresses"] = store.read("addresses").count()
    if transfers is not None:
        counts["transfers"] = store.insert_transfers(transfers)
    for table, rows, keys in (("ens_records", ens, ["address"]), ("safe_owners", owners, ["safe_address", "owner_address"]), ("did_documents", documents, ["did"])):
        if rows is not None:
            store.upsert(table, rows, keys)
            counts[table] = store.read(table).count()
    return counts


def link(store: Store, *, addresses: DataFrame | None = None, min_evidence: int = 1, policy: MergePolicy = LEGACY, deny: DataFrame | None = None, chain: str = "mainnet", window: tuple[int, int] = (0, 0), run_id: str | None = None, stable: float = STABLE, related: float = RELATED) -> dict:
    """Extract evidence of the addresses, replace it in the store, cluster, and record run, service keys and lineage.

    Everything is staged under the run's id and published in one step at the end, so a run that
    fails leaves the store as it was.
    """
    with store.transaction():
        return _link(store, addresses, min_evidence, policy, deny, chain, window, run_id or new_run_id(), stable, related)


def _link(store: Store, addresses: DataFrame | None, min_evidence: int, policy: MergePolicy, deny: DataFrame | None, chain: str, window: tuple[int, int], run_id: str, stable: float, related: float) -> dict:
    spark = store.spark
    subjects = checkpoint(normalize_subjects(store.read("addresses") if addresses is None else addresses))
    fresh = checkpoint(extract_all(subjects, transfers=store.read("transfers"), ens=store.read("ens_records"), owners=store.read("safe_owners"), documents=store.read("did_documents"), deny=deny))
    store.replace_evidence(fresh, subjects, KINDS)
    own = checkpoint(store.read("evidence").join(subjects, "address", "left_semi"))
    members = checkpoint(linking.clusters(subjects, own, policy, min_evidence))
    params = json.dumps({"min_evidence": min_evidence, "policy": asdict(policy)}, sort_keys=True)
    now = F.current_timestamp()
    one = spark.range(1)
    store.append("clustering_runs", one.select(F.lit(run_id).alias("run_id"), F.lit(params).alias("params_json"), now.alias("started_at"), F.lit(None).cast("string").alias("notes")))
    shared = linking.cluster_shared_keys(own, members, policy).groupBy("cluster_id").agg(F.to_json(F.struct(F.array_sort(F.collect_set("key")).alias("shared_evidence_keys"))).alias("evidence_json"))
    store.append("entity_clusters", members.join(shared, "cluster_id", "left").select(F.lit(run_id).alias("cluster_run_id"), "cluster_id", "address", "evidence_json"))
    services = checkpoint(linking.service_keys(own, policy))
    store.append("suspected_service_keys", services.select(F.lit(run_id).alias("cluster_run_id"), "kind", "key", "fan_out", now.alias("detected_at")))
    # the previous run is looked up before this one is recorded
    current = lineage.RunWindow(run_id, chain, policy.profile, *window)
    found = lineage.latest_run(store.read("dataset_runs").where((F.col("chain") == chain) & (F.col("policy_profile_id") == policy.profile))).collect()
    previous = lineage.RunWindow(found[0]["run_id"], chain, policy.profile, found[0]["window_start_block"], found[0]["window_end_block"]) if found else None
    reason, rows = lineage.skip_reason(current, previous), None
    if reason is None:
        before = store.read("entity_clusters").where(F.col("cluster_run_id") == previous.run_id).select("cluster_id", "address")
        rows = checkpoint(lineage.lineage(members, before, current_run=run_id, previous_run=previous.run_id, stable=stable, related=related))
        store.append("cluster_lineage", rows)
    blank = F.lit("{}")
    store.append("dataset_runs", one.select(
        F.lit(run_id).alias("run_id"), F.lit(chain).alias("chain"), F.lit("link").alias("run_type"), F.lit(previous.run_id if previous else None).cast("string").alias("parent_run_id"), F.lit(window[0]).cast("bigint").alias("window_start_block"), F.lit(window[1]).cast("bigint").alias("window_end_block"),
        F.lit(None).cast("string").alias("window_start_ts"), F.lit(None).cast("string").alias("window_end_ts"), F.lit("manual").alias("cadence"), blank.alias("seed_spec_json"), F.lit(params).alias("params_json"), F.lit("").alias("input_snapshot_hash"), F.lit("").alias("code_commit"), now.alias("created_at"), F.lit(None).cast("string").alias("notes"),
        F.lit(policy.profile).alias("policy_profile_id"), F.lit(stable).alias("stable_threshold"), F.lit(related).alias("related_threshold"),
    ))
    store.append("run_inputs", one.select(F.lit(run_id).alias("run_id"), F.lit("store").alias("input_type"), F.lit(store.folder).alias("input_ref"), F.lit("parquet").alias("source"), F.lit(None).cast("string").alias("metadata_json")))
    counters = metrics.run_metrics(run_id, subjects=subjects, transfers=store.read("transfers"), evidence=own, members=members, services=services)
    store.append("run_metrics", counters.withColumn("lineage_row_count", F.lit(rows.count() if rows is not None else 0).cast("bigint")).withColumn("metadata_json", F.lit(None).cast("string")))
    counts = lineage.lineage_counts(rows).first().asDict() if rows is not None else None
    return {"run_id": run_id, "params_json": params, "lineage": counts, "lineage_skipped": reason, **{k: v for k, v in counters.first().asDict().items() if k != "run_id"}}


class Run:
    """A stored run, by id or the latest."""

    def __init__(self, store: Store, run_id: str | None = None) -> None:
        runs = store.read("clustering_runs").withColumnRenamed("started_at", "created_at")
        if run_id is not None:
            runs = runs.where(F.col("run_id") == run_id)
        found = lineage.latest_run(runs).collect()
        if not found:
            raise LookupError(f"no run {run_id}" if run_id else "no runs")
        row = found[0]
        self.store, self.run_id, params = store, row["run_id"], json.loads(row["params_json"])
        self.summary = {"run_id": row["run_id"], "started_at": str(row["created_at"]), "params_json": row["params_json"]}
        self.min_evidence = params.get("min_evidence", 1)
        policy = params.get("policy", {})
        self.policy = MergePolicy(**{**policy, "suppressed": tuple(policy.get("suppressed", ()))}) if policy else LEGACY
        self.members = checkpoint(store.read("entity_clusters").where(F.col("cluster_run_id") == self.run_id).select("cluster_id", "address"))
        self.evidence = checkpoint(store.read("evidence").join(self.members.select("address"), "address", "left_semi"))
        self.services = store.read("suspected_service_keys").where(F.col("cluster_run_id") == self.run_id).select("kind", "key", "fan_out")


def run_metrics(store: Store, run_id: str | None = None, threshold: float = 0.5) -> dict:
    return metrics.concentration(metrics.cluster_sizes(Run(store, run_id).members), threshold).first().asDict()


def report_lines(store: Store, fmt: str = "markdown", run_id: str | None = None, threshold: float = 0.5) -> DataFrame:
    """The report as ordered lines: markdown (md), json or dot. Markdown and DOT apply the rule without funding policy, as edges are shown by it."""
    run = Run(store, run_id)
    if fmt in ("markdown", "md"):
        return report.markdown_lines(run.summary, run.evidence, run.members, run.services, min_evidence=run.min_evidence, policy=LEGACY, threshold=threshold)
    if fmt == "dot":
        return report.dot_lines(run.summary, run.evidence, run.members, run.services, min_evidence=run.min_evidence, policy=LEGACY)
    if fmt == "json":
        return report.json_lines(run.summary, run.members, run.services, threshold)
    raise ValueError(f"unknown format {fmt!r}")


def render_report(store: Store, fmt: str = "markdown", run_id: str | None = None, threshold: float = 0.5) -> str:
    """A report that fits the driver, as one text."""
    return report.text_of(report_lines(store, fmt, run_id, threshold))


def export_graph(store: Store, mode: str = "evidence", *, run_id: str | None = None, params: LinkageParams = LinkageParams(), **bounds: int) -> dict:
    run = Run(store, run_id)
    if mode == "evidence":
        return graph.evidence_graph(run.summary, run.evidence, run.members, **bounds)
    if mode == "pairwise":
        return graph.pairwise_graph(run.summary, run.evidence, run.members, params, **bounds)
    raise ValueError(f"unknown graph mode {mode!r}")


def record_export(store: Store, run_id: str, path: str, text: str) -> None:
    digest = hashlib.sha256(text.encode()).hexdigest()
    row = [F.lit(run_id).alias("run_id"), F.lit("graph").alias("artifact_type"), F.lit(path).alias("path"), F.lit(digest).alias("sha256"), F.lit(None).cast("string").alias("metadata_json")]
    store.append("graph_exports", store.spark.range(1).select(*row))


def score_pairs(store: Store, *, params: LinkageParams = LinkageParams(), limit: int | None = 5000) -> DataFrame:
    return pairwise.score_evidence(store.read("evidence"), params, limit=limit).orderBy(F.desc("score"), "address_a", "address_b")


def evaluate(store: Store, gold: DataFrame, modes: str = "all", *, min_evidence: int = 2, params: LinkageParams = LinkageParams()) -> dict[str, DataFrame]:
    return evaluation.evaluate(checkpoint(gold), store.read("evidence"), parse_ablations(modes), min_evidence=min_evidence, params=params)


def pair_baseline(store: Store, addresses: DataFrame | None = None, gold: DataFrame | None = None) -> dict[str, DataFrame]:
    """All C(n,2) pairs of ``addresses``, by default those of the store, and found pairs of others."""
    addresses = store.read("addresses") if addresses is None else addresses
    rows = checkpoint(baseline.pair_baseline(store.read("evidence"), addresses))
    out = {"pairs": rows, "diagnostics": baseline.diagnostics(rows), "hub_quantiles": baseline.hub_quantiles(rows), "rankings": baseline.rankings(rows)}
    return out if gold is None else out | {"gold": baseline.gold_matrix(rows, gold)}


def cluster_features(store: Store, run_id: str | None = None) -> DataFrame:
    """Features of each cluster of a run, also kept in the table cluster_metrics."""
    run = Run(store, run_id)
    rows = checkpoint(features.cluster_features(run.evidence, run.members, store.read("transfers")))
    store.append("cluster_metrics", rows.withColumn("run_id", F.lit(run.run_id)))
    return rows.orderBy(*features.tier_order())


def evidence_audit(store: Store) -> dict[str, DataFrame]:
    e = store.read("evidence")
    tables = {t: store.read(t) for t in ("addresses", "transfers", "ens_records", "safe_owners", "evidence", "clustering_runs", "entity_clusters")}
    return {"tables": audit.table_rows(tables), "kinds": audit.kind_counts(e), "sources": audit.source_counts(e), "duplication": audit.duplication(e), "temporal": audit.temporal(e), "readiness": audit.readiness(e)}


def extract_seeds(logs: DataFrame, transfers: DataFrame, *, window: tuple[int, int], cap: int = 800, first: int = 500, controls: int = 150, service_fan_out: int = 1000, nodes: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Seed tables and their summary, from landed governance and transfer logs.

    ``nodes`` are the ranges of the scan: where they are given, rows of failed ranges are missing
    and the scan's counters are in the summary.
    """
    keep = (lambda rows: rows) if nodes is None else (lambda rows: ranges.rows_in_fetched(nodes, rows))
    events = checkpoint(landed.in_window(keep(landed.decode_logs(logs)), *window))
    seen = lambda kind: events.where(F.col("kind") == kind).groupBy("address").agg(F.min("block_num").alias("first_seen_block")).withColumn("seed_type", F.lit("voter" if kind == "vote" else "proposer"))
    voters, proposers = seen("vote"), seen("proposal")
    everyone = checkpoint(cohort.merge_governance(voters, proposers))
    governance = cohort.capped_cohort(everyone, cap, first)
    seen_there = checkpoint(cohort.participants(landed.in_window(keep(landed.decode_transfer_logs(transfers)), *window)))
    pool = checkpoint(cohort.control_pool(seen_there, governance, service_fan_out=service_fan_out).select("address", F.col("first_block").alias("first_seen_block"), F.lit("control").alias("seed_type")))
    tables = {"voters": voters, "proposers": proposers, "governance": governance, "pool": pool, "control": pool.orderBy("first_seen_block", "address").limit(controls)}
    n = {k: v.count() for k, v in tables.items()} | {"governance_unique": everyone.count(), "participants": seen_there.count(), "extreme_services": seen_there.where(F.col("n") >= service_fan_out).count()}
    bucket = everyone.agg(cohort.size_bucket(F.count("*"))).first()[0]
    summary = {"window": list(window), "counts": n, "governance_bucket": bucket, "cap_applied": n["governance"] < n["governance_unique"], "cap_removed": n["governance_unique"] - n["governance"], "service_fan_out": service_fan_out}
    return tables, summary | ({"scan": ranges.counters(nodes).first().asDict()} if nodes is not None else {})


def stratified_seeds(governance: DataFrame, pool: DataFrame, *, window: tuple[int, int], strata: int = 10, n: int = 500) -> tuple[dict[str, DataFrame], dict]:
    """Governance and control samples of equal size by block stratum, and their summary."""
    sides = {"governance": governance, "control": pool.join(governance.select("address"), "address", "left_anti")}
    samples = {k: checkpoint(cohort.stratified_sample(v, *window, strata, n)) for k, v in sides.items()}
    counts = {k: {"pool": {r["stratum"]: r["n"] for r in cohort.stratum_counts(sides[k], *window, strata).collect()}, "selected": {r["stratum"]: r["count"] for r in s.groupBy("stratum").count().collect()}} for k, s in samples.items()}
    overlap = samples["governance"].join(samples["control"], "address", "left_semi").count()
    return samples, {"window": list(window), "strata": strata, "sample_size": n, "selected": {k: s.count() for k, s in samples.items()}, "by_stratum": counts, "overlap": overlap, "pool_sha256": {k: cohort.pool_hash(v).first()[0] for k, v in sides.items()}}


class Halted(RuntimeError):
    """A large cluster rests on suppressed keys only."""


def cohort_run(store: Store, governance: DataFrame, control: DataFrame, transfers: DataFrame, *, window: tuple[int, int], per_cohort: int = 500, caps: pages.Caps = pages.Caps(), policy: MergePolicy = CONSERVATIVE, min_evidence: int = 1, deny: DataFrame | None = None, ens: DataFrame | None = None, owners: DataFrame | None = None, top: int = 3, snapshot_hash: str = "") -> dict:
    """A bounded two-cohort run: exact cohort sizes, bounded transfers per seed, link, halt guard, tiers, summary.

    Facts, run and clusters are published together at its end: a run that halts or fails leaves
    neither rows nor files, and the latest run is the one before.
    """
    with store.transaction():
        return _cohort_run(store, governance, control, transfers, window, per_cohort, caps, policy, min_evidence, deny, ens, owners, top, snapshot_hash)


def _cohort_run(store: Store, governance: DataFrame, control: DataFrame, transfers: DataFrame, window: tuple[int, int], per_cohort: int, caps: pages.Caps, policy: MergePolicy, min_evidence: int, deny: DataFrame | None, ens: DataFrame | None, owners: DataFrame | None, top: int, snapshot_hash: str) -> dict:
    seeds = checkpoint(governance.select("address", "first_seen_block", F.lit("governance").alias("role")).unionByName(control.select("address", "first_seen_block", F.lit("control").alias("role"))))
    sizes = {r["role"]: r["count"] for r in seeds.groupBy("role").count().collect()}
    if sizes != {"governance": per_cohort, "control": per_cohort}:
        raise ValueError(f"cohorts must have {per_cohort} seeds each, not {sizes}")
    rows, fetches = pages.bounded_fetch(transfers, seeds, caps, start=window[0], end=window[1])
    own, hits = checkpoint(rows), pages.cap_hits(fetches).first().asDict()
    moves = own.select("from_addr", "to_addr", "value", "block_num", "tx_hash", "asset")
    inserted = ingest(store, subjects=seeds.select("address", "first_seen_block"), transfers=moves, ens=ens, owners=owners)
    linked = link(store, addresses=seeds, min_evidence=min_evidence, policy=policy, deny=deny, window=window)
    run = Run(store, linked["run_id"])
    shared = linking.cluster_shared_keys(run.evidence, run.members, policy)
    halted = cohort.service_dominated(run.members, shared, run.services).where("dominated").limit(1).collect()
    if halted:
        raise Halted(f"cluster {halted[0]['cluster_id']} of {halted[0]['size']} rests on suppressed keys only")
    tiers = cohort.coordination_tiers(run.members, seeds)
    first = [r.asDict() for r in tiers.where("size > 1").orderBy(F.desc("size"), "cluster_id").limit(top).collect()]
    comparison = [r.asDict() for r in cohort.cohort_comparison(run.members, seeds, features.cluster_features(run.evidence, run.members, moves)).orderBy("role").collect()]
    return {"run": linked, "inserted": inserted, "cap_hits": hits, "top_clusters": first, "comparison": comparison, "concentration": run_metrics(store, linked["run_id"]), "window": list(window), "snapshot_hash": snapshot_hash, "boundary": BOUNDARY}


def render_cohort(summary: dict) -> str:
    """The cohort run's summary as Markdown."""
    out = ["# Cohort run", "", f"Run `{summary['run']['run_id']}`, blocks {summary['window'][0]} to {summary['window'][1]}.", "", "| Measure | Value |", "|---|---|"]
    out += [f"| {k} | {v} |" for part in ("run", "inserted", "cap_hits", "concentration") for k, v in summary[part].items()]
    out += ["", "## Largest clusters", "", *[f"- `{c['cluster_id']}`: {c['size']} identifiers, {c['tier']}" for c in summary["top_clusters"]], "", "## Cohorts", ""]
    out += [f"- {c['role']}: " + ", ".join(f"{k} {v}" for k, v in c.items() if k != "role") for c in summary["comparison"]]
    return "\n".join([*out, "", BOUNDARY, ""])
