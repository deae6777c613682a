"""Command line: ``python -m linkweave.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.scalar import normalize_address
from linkweave.operators import ranges
from linkweave.operators.report import dump, write_ordered, write_text
from linkweave.plans import pipelines
from linkweave.schemas import CONSERVATIVE, FAN_OUT_CAP, GRAPH_EVIDENCE, GRAPH_IDENTIFIERS, LEGACY, RELATED, STABLE, TABLES, MergePolicy
from linkweave.serve import server
from linkweave.sources import landed
from linkweave.sources.store import Store
from linkweave.sources.writers import markdown_table, write_csv, write_json, write_seeds


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkweave")
    top.add_argument("--storage", default=landed.Config.from_env().storage)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple, **settings: dict) -> None:
        sub = commands.add_parser(name)
        for option in options:
            sub.add_argument(*option[:-1], **option[-1])

    run, out = ("--run-id", {}), ("--out", {})
    tables = ("--tables", {"help": "folder for whole tables, written by the executors"})
    form = ("--form", {"choices": ["json", "csv", "markdown"], "default": "json", "help": "how --tables are written; Markdown shows the first rows"})
    window = [("--window-start", {"type": int, "required": True}), ("--window-end", {"type": int, "required": True})]
    policy = [("--min-evidence", {"type": int, "default": 1}), ("--fan-out-cap", {"type": int, "default": FAN_OUT_CAP}), ("--conservative", {"action": "store_true"})]
    add("ingest", ("--addresses", {}), ("--transfers", {}), ("--ens", {}), ("--safe-owners", {}), ("--did-documents", {}))
    add("link", *policy, ("--denylist", {}), ("--chain", {"default": "mainnet"}), ("--window-start", {"type": int, "default": 0}), ("--window-end", {"type": int, "default": 0}), ("--stable", {"type": float, "default": STABLE}), ("--related", {"type": float, "default": RELATED}))
    add("metrics", run, ("--threshold", {"type": float, "default": 0.5}))
    add("report", run, out, ("--folder", {"help": "folder for the text in ordered parts, written by the executors"}), ("--format", {"choices": ["markdown", "md", "json", "dot"], "default": "markdown"}))
    add("add-ens-record", ("address", {}), ("--name", {}), ("--twitter", {}), ("--github", {}), ("--telegram", {}))
    add("add-safe-owner", ("safe_address", {}), ("owner_address", {}), ("--owner-is-safe", {"action": "store_true"}), ("--threshold", {"type": int}), ("--block", {"type": int}))
    add("add-did-document", ("subject_address", {}), ("controller", {}), ("--method", {"default": "ethr"}), ("--did", {}), ("--block", {"type": int}))
    add("export-graph", run, out, ("--mode", {"choices": ["evidence", "pairwise"], "default": "evidence"}), ("--max-identifiers", {"type": int, "default": GRAPH_IDENTIFIERS}), ("--max-evidence", {"type": int, "default": GRAPH_EVIDENCE}), ("--params", {}))
    add("score-pairs", out, ("--params", {}), ("--limit", {"type": int, "default": 5000}))
    add("cohort", *policy, out, ("governance", {}), ("control", {}), ("transfers", {}), ("--window-start", {"type": int, "required": True}), ("--window-end", {"type": int, "required": True}), ("--per-cohort", {"type": int, "default": 500}), ("--denylist", {}), ("--snapshot", {}))
    add("eval", tables, form, ("gold", {}), ("--modes", {"default": "all"}), ("--min-evidence", {"type": int, "default": 2}), ("--params", {}))
    add("audit", tables, form)
    add("pair-baseline", tables, form, ("--gold", {}))
    add("cluster-features", run, tables, form)
    add("seeds", ("logs", {}), ("transfer_logs", {}), ("out", {}), *window, ("--calls", {"help": "landed calls (from_block, to_block, attempt, ok) of the scan"}), ("--chunk", {"type": int, "default": 50_000}), ("--min-blocks", {"type": int, "default": 1000}), ("--retries", {"type": int, "default": 3}), ("--controls", {"type": int, "default": 150}), ("--service-fan-out", {"type": int, "default": 1000}))
    add("strata", ("governance", {}), ("pool", {}), ("out", {}), *window, ("--strata", {"type": int, "default": 10}), ("--sample-size", {"type": int, "default": 500}))
    add("serve", ("--host", {"default": "127.0.0.1"}), ("--port", {"type": int, "default": 8080}))
    return top


def _policy(a: argparse.Namespace) -> MergePolicy:
    base = CONSERVATIVE if a.conservative else LEGACY
    return MergePolicy(conservative=base.conservative, fan_out_cap=a.fan_out_cap, funded_fan_out_cap=a.fan_out_cap)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def _tables(found: dict[str, DataFrame], folder: str | None, form: str = "json") -> dict[str, object]:
    """Every row of each table: as JSON lines or CSV in ``folder``, written by the executors, or printed; as Markdown, the first rows."""
    if not folder:
        return {k: _rows(v) for k, v in found.items()}
    if form == "markdown":
        for name, df in found.items():
            write_text(f"{folder}/{name}.md", markdown_table(df) + "\n")
        return {k: f"{folder}/{k}.md" for k in found}
    for name, df in found.items():
        (write_csv if form == "csv" else write_json)(df, f"{folder}/{name}")
    return {k: f"{folder}/{k}" for k in found}


def _seed_tables(made: tuple[dict[str, DataFrame], dict], folder: str) -> dict:
    tables, summary = made
    for name, df in tables.items():
        write_seeds(df, f"{folder}/{name}")
    return summary | {"files": {name: f"{folder}/{name}" for name in tables}}


def _one(store: Store, table: str, **values: object) -> dict:
    keys = {"ens_records": ["address"], "safe_owners": ["safe_address", "owner_address"], "did_documents": ["did"]}[table]
    schema = TABLES[table]
    row = store.spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema])
    checked = row.withColumns({c: normalize_address(F.col(c)) for c in ("address", "safe_address", "owner_address", "subject_address", "controller") if c in row.columns})
    store.upsert(table, checked, keys)
    subject = next(c for c in ("address", "safe_address", "subject_address") if c in row.columns)
    return pipelines.ingest(store, subjects=checked.select(F.col(subject).alias("address")))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Run a command and return what it prints."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("linkweave").getOrCreate()
    store = Store(spark, a.storage)
    read = lambda path, table: spark.read.schema(TABLES[table]).parquet(path) if path else None
    params = lambda: landed.read_params(spark, a.params)
    match a.command:
        case "ingest":
            said = pipelines.ingest(store, subjects=read(a.addresses, "addresses"), transfers=read(a.transfers, "transfers"), ens=read(a.ens, "ens_records"), owners=read(a.safe_owners, "safe_owners"), documents=read(a.did_documents, "did_documents"))
        case "link":
            said = pipelines.link(store, min_evidence=a.min_evidence, policy=_policy(a), deny=landed.read_denylist(spark, a.denylist), chain=a.chain, window=(a.window_start, a.window_end), stable=a.stable, related=a.related)
        case "metrics":
            said = pipelines.run_metrics(store, a.run_id, a.threshold)
        case "report":
            if a.folder:
                write_ordered(pipelines.report_lines(store, a.format, a.run_id), a.folder)
            said = a.folder or pipelines.render_report(store, a.format, a.run_id)
        case "add-ens-record":
            said = _one(store, "ens_records", address=a.address, name=a.name, twitter=a.twitter, github=a.github, telegram=a.telegram)
        case "add-safe-owner":
            said = _one(store, "safe_owners", safe_address=a.safe_address, owner_address=a.owner_address, owner_is_safe=a.owner_is_safe, threshold=a.threshold, observed_block=a.block, source="manual")
        case "add-did-document":
            said = _one(store, "did_documents", did=a.did or f"did:{a.method}:{a.subject_address.lower()}", subject_address=a.subject_address, controller=a.controller, method=a.method, observed_block=a.block, source="manual")
        case "export-graph":
            bounds = {"max_identifiers": a.max_identifiers} | ({"max_evidence": a.max_evidence} if a.mode == "evidence" else {})
            said = dump(pipelines.export_graph(store, a.mode, run_id=a.run_id, params=params(), **bounds))
            if a.out:
                pipelines.record_export(store, json.loads(said)["run"]["run_id"], a.out, said)
        case "score-pairs":
            said = _rows(pipelines.score_pairs(store, params=params(), limit=a.limit))
        case "cohort":
            seeds = [landed.read_seeds(spark, p, r) for p, r in ((a.governance, "governance"), (a.control, "control"))]
            snapshot = landed.read_snapshot_hash(spark, a.snapshot) if a.snapshot else ""
            summary = pipelines.cohort_run(store, *seeds, read(a.transfers, "transfers"), window=(a.window_start, a.window_end), per_cohort=a.per_cohort, policy=_policy(a), min_evidence=a.min_evidence, deny=landed.read_denylist(spark, a.denylist), snapshot_hash=snapshot)
            if a.out:
                write_text(f"{a.out}.md", pipelines.render_cohort(summary))
            said = dump(summary)
        case "eval":
            said = _tables(pipelines.evaluate(store, landed.read_gold(spark, a.gold), a.modes, min_evidence=a.min_evidence, params=params()), a.tables, a.form)
        case "audit":
            said = _tables(pipelines.evidence_audit(store), a.tables, a.form)
        case "pair-baseline":
            said = _tables(pipelines.pair_baseline(store, gold=landed.read_flexible_gold(spark, a.gold) if a.gold else None), a.tables, a.form)
        case "cluster-features":
            found = pipelines.cluster_features(store, a.run_id)
            said = _tables({"cluster_features": found}, a.tables, a.form) if a.tables else _rows(found)
        case "seeds":
            span, nodes = (a.window_start, a.window_end), None
            if a.calls:
                blocks = spark.createDataFrame([(b,) for b in span], "block_num long")
                nodes = ranges.bisect(ranges.chunk_ranges(blocks, a.chunk), spark.read.json(a.calls, schema="from_block long, to_block long, attempt int, ok boolean"), retries=a.retries, min_blocks=a.min_blocks)
            logs = lambda path: spark.read.json(path, schema="contract string, block_hex string, topic0 string, topic1 string, topic2 string, data string")
            said = _seed_tables(pipelines.extract_seeds(logs(a.logs), logs(a.transfer_logs), window=span, controls=a.controls, service_fan_out=a.service_fan_out, nodes=nodes), a.out)
        case "strata":
            seeds = lambda path: spark.read.csv(path, header=True, schema="address string, first_seen_block long, seed_type string")
            said = _seed_tables(pipelines.stratified_seeds(seeds(a.governance), seeds(a.pool), window=(a.window_start, a.window_end), strata=a.strata, n=a.sample_size), a.out)
        case "serve":
            server(store, a.host, a.port).serve_forever()
            said = ""
    text = said if isinstance(said, str) else dump(said)
    if getattr(a, "out", None) and a.command not in ("seeds", "strata"):
        write_text(a.out, text)
    return text


if __name__ == "__main__":
    print(main(sys.argv[1:]))
