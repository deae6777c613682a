"""Store, runs, command line, streams, and the registry against DuckDB."""

import json
import math

import pytest

import __spark_entry__
from linkweave import cli
from linkweave.plans import pipelines
from linkweave.plans import queries as registry
from linkweave.plans.oracles import ORACLES
from linkweave.plans.queries import QUERIES
from linkweave.schemas import CONSERVATIVE, TABLES
from linkweave.sources.store import Store
from linkweave.streaming import ingest as streams

A, B, C, D, O, K = ("0x" + c * 40 for c in "abcdef")
SF = "/root/testdata/sf0.001"


def _store(spark, tmp_path, **tables):
    store = Store(spark, f"file://{tmp_path}/db")
    frames = {k: spark.createDataFrame(v, TABLES[k]) for k, v in tables.items()}
    pipelines.ingest(store, subjects=frames.get("addresses"), transfers=frames.get("transfers"), ens=frames.get("ens_records"), owners=frames.get("safe_owners"), documents=frames.get("did_documents"))
    return store


def test_link_twice_with_lineage(spark, tmp_path):
    owners = [(A, O, False, 2, None, "manual"), (B, O, False, 2, None, "manual")]
    store = _store(spark, tmp_path, addresses=[(x, None, None) for x in (A, B, C)], safe_owners=owners, did_documents=[("did:1", C, K, "ethr", None, 5, "s")])
    first = pipelines.link(store, window=(1, 2), run_id="run-1")
    assert (first["cluster_count"], first["largest_cluster"], first["lineage_skipped"]) == (2, 2, "Lineage skipped because no previous comparable run exists.")
    text = pipelines.render_report(store, run_id="run-1")  # drawn from the evidence as it is now
    assert "Shared-owner governance-control cluster" in text and "no identity claim" in text
    store.upsert("safe_owners", spark.createDataFrame([(B, O, True, 2, None, "manual")], TABLES["safe_owners"]), ["safe_address", "owner_address"])
    second = pipelines.link(store, window=(3, 4), run_id="run-2")
    assert (second["cluster_count"], second["lineage"]["stable"], second["lineage"]["new"], second["lineage"]["total_rows"]) == (3, 2, 0, 2)
    assert pipelines.link(store, policy=CONSERVATIVE, window=(5, 6), run_id="run-3")["lineage"] is None
    assert store.read("run_metrics").count() == 3 and store.read("cluster_lineage").count() == 2
    assert pipelines.run_metrics(store, "run-1")["nakamoto"] == 1
    assert json.loads(pipelines.render_report(store, "json"))["run"]["run_id"] == "run-3"
    with pytest.raises(LookupError):
        pipelines.run_metrics(store, "nothing")


def test_scope_of_a_partial_link(spark, tmp_path):
    owners = [(x, O, False, 2, None, "manual") for x in (A, B)]
    store = _store(spark, tmp_path, addresses=[(x, None, None) for x in (A, B)], safe_owners=owners)
    pipelines.link(store, run_id="run-1")
    before = {tuple(r) for r in store.read("evidence").where(f"address = '{B}'").collect()}
    pipelines.link(store, addresses=spark.createDataFrame([(A,), (A,)], "address string"), run_id="run-2")
    assert {tuple(r) for r in store.read("evidence").where(f"address = '{B}'").collect()} == before
    assert pipelines.Run(store, "run-2").members.count() == 1


def test_command_line(spark, tmp_path):
    run = lambda *a: cli.main(["--storage", f"file://{tmp_path}/db", *a], spark)
    for safe in (A, B):
        run("add-safe-owner", safe.upper().replace("0X", "0x"), O, "--threshold", "2")
    run("add-ens-record", A, "--twitter", "@x")
    run("add-did-document", C, K)
    said = json.loads(run("link"))
    assert said["cluster_count"] == 2 and said["address_count"] == 3
    assert json.loads(run("metrics"))["n_clusters"] == 2
    assert run("report", "--format", "dot").startswith("graph")
    out = tmp_path / "g.json"
    assert json.loads(run("export-graph", "--out", str(out)))["graph_mode"] == "evidence" and out.exists()
    assert json.loads(run("export-graph", "--mode", "pairwise"))["links"][0]["tier"] == "accepted"
    assert json.loads(run("score-pairs"))[0]["score"] == 8.0
    gold = tmp_path / "gold.csv"
    gold.write_text(f"address_a,address_b,label,rationale\n{A},{B},same_control,x\n")
    assert json.loads(run("eval", str(gold), "--modes", "all,funded_by_only", "--min-evidence", "1"))["counts"]
    assert json.loads(run("audit"))["kinds"]
    assert json.loads(run("pair-baseline", "--gold", str(gold)))["gold"][0]["recommendation"] == "control_link_candidate"
    where = json.loads(run("pair-baseline", "--tables", f"{gold}-tables"))
    assert set(where) == {"pairs", "diagnostics", "hub_quantiles", "rankings"}
    assert {r["ranking"] for r in spark.read.json(where["rankings"]).collect()} >= {"top"}
    assert json.loads(run("cluster-features"))[0]["tier"] == "candidate_medium"
    where = json.loads(run("audit", "--tables", f"{gold}-csv", "--form", "csv"))
    assert spark.read.csv(where["kinds"], header=True).count() == 3
    where = json.loads(run("pair-baseline", "--tables", f"{gold}-md", "--form", "markdown"))
    with open(where["diagnostics"], encoding="utf-8") as file:
        assert file.read().startswith("| pair_count |")
    with pytest.raises(Exception, match="not an address"):
        run("add-ens-record", "0x12")


def test_seed_commands(spark, tmp_path):
    """Logs of a scan with a failed range, then samples by stratum of what it gave."""
    from linkweave.schemas import GOVERNORS, TOKEN, TOPIC_PROPOSAL_CREATED, TOPIC_TRANSFER, TOPIC_VOTE_CAST

    run = lambda *a: json.loads(cli.main(["--storage", f"file://{tmp_path}/db", *map(str, a)], spark))
    word = lambda n: f"{n:064x}"
    votes = [{"contract": GOVERNORS[0], "block_hex": hex(b), "topic0": TOPIC_VOTE_CAST, "topic1": "0x" + word(b % 40), "data": "0x"} for b in range(0, 200, 2)]
    votes += [{"contract": GOVERNORS[1], "block_hex": hex(7), "topic0": TOPIC_PROPOSAL_CREATED, "data": "0x" + word(1) + word(999)}]
    moves = [{"contract": TOKEN, "block_hex": hex(b), "topic0": TOPIC_TRANSFER, "topic1": "0x" + word(500 + b), "topic2": "0x" + word(700), "data": "0x"} for b in range(200)]
    calls = [{"from_block": a, "to_block": a + 99, "attempt": n, "ok": a == 0} for a in (0, 100) for n in range(2)] + [{"from_block": a, "to_block": a + 49, "attempt": n, "ok": a == 100} for a in (100, 150) for n in range(2)]
    for name, rows in (("votes", votes), ("moves", moves), ("calls", calls)):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    at = lambda name: f"{tmp_path}/{name}.json"
    got = run("seeds", at("votes"), at("moves"), f"{tmp_path}/seeds", "--window-start", 0, "--window-end", 199, "--calls", at("calls"), "--chunk", 100, "--min-blocks", 50, "--retries", 1, "--service-fan-out", 60)
    assert got["scan"]["failed_chunks"] == 1 and got["scan"]["total_calls"] == 6 and got["scan"]["failed_blocks"] == 50
    assert got["counts"]["voters"] == 20 and got["counts"]["proposers"] == 1 and got["counts"]["governance"] == 21 and got["governance_bucket"] == "<300"
    assert got["counts"]["participants"] == 151 and got["counts"]["extreme_services"] == 1 and got["counts"]["pool"] == 150 == got["counts"]["control"]
    kept = spark.read.csv(f"{tmp_path}/seeds/pool", header=True)
    assert kept.count() == 150 and kept.where("cast(first_seen_block as int) >= 150").count() == 0
    got = run("strata", f"{tmp_path}/seeds/governance", f"{tmp_path}/seeds/pool", f"{tmp_path}/strata", "--window-start", 0, "--window-end", 199, "--strata", 5, "--sample-size", 20)
    assert got["selected"] == {"governance": 20, "control": 20} and got["overlap"] == 0 and sum(got["by_stratum"]["control"]["pool"].values()) == 150
    assert spark.read.csv(f"{tmp_path}/strata/control", header=True).count() == 20


def test_http_view(spark, tmp_path):
    from linkweave.operators.graph import same_run
    from linkweave.serve import answer, server

    store = _store(spark, tmp_path, addresses=[(A, None, None)])
    assert answer(store, "/health")[0] == 200 and answer(store, "/x")[0] == 404
    assert answer(store, "/api/graph")[0] == 404
    pipelines.link(store, run_id="run-1")
    status, body = answer(store, "/api/graph?max_identifiers=5&mode=evidence")
    assert status == 200 and same_run({"run_id": "run-1"}, json.loads(body))
    assert [answer(store, f"/api/graph?{q}")[0] for q in ("mode=zz", "max_evidence=x", "max_identifiers=0", "run_id=none")] == [400, 400, 400, 404]
    server(store, port=0).server_close()


def test_writers(spark, tmp_path):
    from linkweave.sources import writers

    rows = spark.createDataFrame([(B, 2, ["x"]), (A, 1, None)], "address string, first_seen_block long, tags array<string>")
    writers.write_seeds(rows, f"{tmp_path}/seeds")
    assert [r["address"] for r in spark.read.csv(f"{tmp_path}/seeds", header=True).collect()] == [A, B]
    writers.write_csv(rows, f"{tmp_path}/csv")
    writers.write_json(rows, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2
    assert writers.markdown_table(rows.select("first_seen_block").orderBy("first_seen_block")).endswith("| 1 |\n| 2 |")


def test_cohort_run(spark, tmp_path):
    seeds = lambda *xs: spark.createDataFrame([(x, 1) for x in xs], "address string, first_seen_block long")
    moves = spark.createDataFrame([(f, x, "1", b, f"{f}{x}{b}", "E") for f in (O, K) for x, b in ((A, 10), (B, 12), (C, 9000))], TABLES["transfers"])
    store = Store(spark, f"file://{tmp_path}/db")
    got = pipelines.cohort_run(store, seeds(A, B), seeds(C, D), moves, window=(1, 10_000), per_cohort=2)
    assert got["run"]["cluster_count"] == 3 and got["top_clusters"][0]["tier"] == "multi_identifier_coordination_governance_only"
    assert "no identity claim" in pipelines.render_cohort(got) and not got["cap_hits"]["bias_risk"]
    with pytest.raises(ValueError):
        pipelines.cohort_run(store, seeds(A), seeds(C, D), moves, window=(1, 2), per_cohort=2)


def test_halted_run_leaves_nothing(spark, tmp_path, monkeypatch):
    """A cluster that rests on suppressed keys halts the run: no rows, no files, and the run before stays the latest."""
    seeds = lambda *xs: spark.createDataFrame([(x, 1) for x in xs], "address string, first_seen_block long")
    moves = spark.createDataFrame([(f, x, "1", b, f"{f}{x}{b}", "E") for f in (O, K) for x, b in ((A, 10), (B, 12))], TABLES["transfers"])
    store = Store(spark, f"file://{tmp_path}/db")
    done = pipelines.cohort_run(store, seeds(A, B), seeds(C, D), moves, window=(1, 100), per_cohort=2)["run"]["run_id"]
    files = lambda: {str(p) for p in tmp_path.rglob("*.parquet")}
    before, manifest = files(), store.manifest()
    monkeypatch.setattr(pipelines.cohort, "service_dominated", lambda members, *_: members.selectExpr("cluster_id", "99 as size", "true as dominated"))
    with pytest.raises(pipelines.Halted):
        pipelines.cohort_run(store, seeds(A, B), seeds(C, D), moves.union(moves.selectExpr("from_addr", "to_addr", "'2'", "block_num", "tx_hash", "asset")), window=(1, 100), per_cohort=2)
    assert files() == before and store.manifest() == manifest
    assert pipelines.Run(store).run_id == done and store.read("transfers").count() == 4


def test_streams(spark, tmp_path):
    folder, store = f"{tmp_path}/in", Store(spark, f"file://{tmp_path}/db")
    rows = spark.createDataFrame([(A, B, "1", 5, "t", "E"), (A, B, "1", 5, "t", "E"), (A, B, "1", 3, None, "E")], TABLES["transfers"])
    for _ in range(2):
        rows.write.mode("append").parquet(folder)
        seen = []
        q = streams.insert_stream(streams.transfer_stream(spark, folder), store, f"{tmp_path}/cp", after=lambda s, n, seen=seen: seen.append(n))
        q.awaitTermination(120)
        assert len(seen) == 1
    assert store.read("transfers").count() == 3
    q = streams.first_funding(streams.distinct_transfers(streams.transfer_stream(spark, folder))).writeStream.outputMode("complete").format("memory").queryName("funding").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("funding").collect()] == [(B, A, 3)]


def _plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def inputs(spark):
    return registry.Inputs(spark, SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_duckdb(spark, inputs, monkeypatch, name):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(registry, "Inputs", lambda *_: inputs)  # evidence and clusters are made once
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda rows: sorted((tuple(_plain(v) for v in r) for r in rows), key=repr)
    assert key(got.select(*columns).collect()) == key(want)


def test_contract(spark):
    assert set(QUERIES) - set(ORACLES) == {"address_checksums"} and set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["cluster_id", "address"]
