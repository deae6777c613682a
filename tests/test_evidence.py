"""Extraction, ablation, sinks, parsers and scalar functions."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from linkweave.functions import scalar
from linkweave.operators import evidence as ev
from linkweave.schemas import TABLES, LinkageParams
from linkweave.sources import landed, store

A, B, K = ("0x" + c * 40 for c in "abc")


def _frame(spark, table, rows):
    return spark.createDataFrame(rows, TABLES[table])


def _subjects(spark, *addresses):
    return spark.createDataFrame([(a,) for a in addresses], "address string")


def test_first_funding_takes_unknown_block_as_zero(spark):
    moves = [("f1", A, "1", 42, "t1", "ETH"), ("f1", A, "1", 10, "t2", "ETH"), ("f2", A, "1", None, "t3", "ETH")]
    got = {(r["key"], r["observed_block"], r["source"]) for r in ev.extract_funded_by(_frame(spark, "transfers", moves), _subjects(spark, A)).collect()}
    assert got == {("f1", 10, "alchemy_getAssetTransfers@10"), ("f2", 0, "alchemy_getAssetTransfers@0")}


def test_handles(spark):
    rows = [(A, "a.eth", "@alice", "alice-dev", "  "), (B, None, " @@Alice", None, None)]
    got = {(r["address"], r["key"], r["payload_json"]) for r in ev.extract_ens_handles(_frame(spark, "ens_records", rows), _subjects(spark, A, B)).collect()}
    assert got == {(A, "twitter:alice", '{"ens_name":"a.eth"}'), (A, "github:alice-dev", '{"ens_name":"a.eth"}'), (B, "twitter:alice", '{"ens_name":null}')}


def test_controllers_collapse(spark):
    rows = [("did:2", A, K, "m2", None, 200, "s"), ("did:1", A, K, "m1", None, 100, "s"), ("did:3", B, K, "m", None, None, "s"), ("did:4", K, K.upper().replace("0X", "0x"), "m", None, 1, "s")]
    got = {r["address"]: r for r in ev.extract_did_controllers(_frame(spark, "did_documents", rows), _subjects(spark, A, B, K)).collect()}
    assert set(got) == {A, B}
    assert (got[A]["observed_block"], got[A]["source"], got[A]["strength"]) == (100, "did_documents:m1:s", 3)
    assert json.loads(got[A]["payload_json"]) == {"dids": ["did:1", "did:2"], "methods": ["m1", "m2"]}
    assert got[B]["observed_block"] == 0


def test_owners_that_are_safes_are_no_evidence(spark):
    rows = [(A, K, False, 2, None, "manual"), (B, K, True, 1, 5, "manual")]
    got = ev.extract_safe_owners(_frame(spark, "safe_owners", rows), _subjects(spark, A, B)).collect()
    assert [(r["address"], r["observed_block"], r["payload_json"]) for r in got] == [(A, 0, '{"owner_source":"manual","threshold":2}')]


def test_ablation_matrix(spark):
    rows = [(A, k, "x", 2, "s", 0, None) for k in ("funded_by", "safe_owner", "ens_handle", "did_controller")]
    frame = _frame(spark, "evidence", rows)
    assert {m: ev.ablate(frame, m).count() for m in ev.ABLATIONS} == {"all_evidence": 4, "safe_owner_only": 1, "did_controller_only": 1, "funded_by_only": 1, "ens_handle_only": 1, "safe_owner_and_funded_by": 2, "without_ens": 3}
    assert {r["mode"]: r["count"] for r in ev.ablated(frame).groupBy("mode").count().collect()} == {m: ev.ablate(frame, m).count() for m in ev.ABLATIONS}
    assert ev.parse_ablation(" ALL ") == "all_evidence" and ev.parse_ablations("no_ens, funded_by_only") == ["without_ens", "funded_by_only"]
    with pytest.raises(ValueError):
        ev.parse_ablation("nothing")


def test_address_rules(spark):
    good, upper = "0x" + "aB" * 20, "0X" + "ab" * 20
    rows = spark.createDataFrame([(good,), (f" {good} ",), (upper,), (None,), ("0x12",)], "a string")
    assert [r[0] for r in rows.select(scalar.normalize_address(F.col("a"), strict=False)).collect()] == [good.lower(), good.lower(), None, None, None]
    with pytest.raises(PySparkException):
        rows.select(scalar.normalize_address(F.col("a"))).collect()


def test_hex_and_words(spark):
    row = spark.createDataFrame([("0x1f", "not", "0x" + "0" * 64 + "0" * 24 + "ab" * 20)], "h string, bad string, data string").select(
        scalar.hex_to_long(F.col("h")), scalar.hex_to_long(F.col("bad")), scalar.abi_address(F.col("data"), 1), scalar.abi_address(F.col("data"), 2), scalar.long_to_hex(F.lit(31)), scalar.short_label(F.lit("0x" + "ab" * 20)), scalar.short_label(F.lit("twitter:joseph"))
    )
    assert tuple(row.first()) == (31, None, "0x" + "ab" * 20, None, "0x1f", "0xabab…abab", "twitter:joseph")


def test_transfer_responses(spark):
    body = {"transfers": [{"from": "0xAA", "to": "0xBB", "value": 1.5, "blockNum": "0x10", "hash": "0xCC", "asset": "ETH"}, {"from": "0xAA", "to": "0xBB", "value": None, "blockNum": "zz", "hash": None, "asset": None}]}
    got = landed.parse_transfers(spark.createDataFrame([(json.dumps(body),)], "value string")).collect()
    assert [tuple(r) for r in got] == [("0xaa", "0xbb", "1.5", 16, "0xcc", "ETH"), ("0xaa", "0xbb", None, None, None, None)]
    with pytest.raises(PySparkException):
        landed.parse_transfers(spark.createDataFrame([('{"transfers":[{"from":"0xaa"}]}',)], "value string")).collect()


def test_safe_responses_and_probe_failure(spark):
    owners = landed.parse_safes(spark.createDataFrame([('{"address":"0xSAFE","threshold":2,"owners":["0xO1","0xO2","0xO3"]}',)], "value string"))
    codes = spark.createDataFrame([("0xo1", "0x"), ("0xo2", "0x60")], "address string, code string")
    got = {r["owner_address"]: r["owner_is_safe"] for r in landed.classify_owners(owners, codes).collect()}
    assert got == {"0xo1": False, "0xo2": True, "0xo3": True}


def test_transfer_key_with_null_is_never_a_duplicate(spark):
    rows = [(A, B, "1", 1, "t", "ETH"), (A, B, "1", 1, "t", "ETH"), (A, B, "1", 1, None, "ETH"), (A, B, "1", 1, None, "ETH")]
    frame = _frame(spark, "transfers", rows)
    assert store.new_transfers(frame).count() == 3
    assert store.new_transfers(frame, frame).count() == 2


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    assert s.read("evidence").count() == 0
    rows = [(A, "safe_owner", K, 2, "s", 0, None), (B, "safe_owner", K, 2, "s", 0, None), (A, "funded_by", K, 2, "s", 0, None)]
    s.replace("evidence", _frame(spark, "evidence", rows))
    s.replace_evidence(_frame(spark, "evidence", []), _subjects(spark, A), ("safe_owner",))
    assert {(r["address"], r["kind"]) for r in s.read("evidence").collect()} == {(B, "safe_owner"), (A, "funded_by")}
    s.upsert("ens_records", _frame(spark, "ens_records", [(A, "a", None, None, None)]), ["address"])
    s.upsert("ens_records", _frame(spark, "ens_records", [(A, "b", None, None, None), (B, "c", None, None, None)]), ["address"])
    assert {(r["address"], r["name"]) for r in s.read("ens_records").collect()} == {(A, "b"), (B, "c")}
    moves = _frame(spark, "transfers", [(A, B, "1", 1, "t", "ETH")])
    assert (s.insert_transfers(moves), s.insert_transfers(moves)) == (1, 0)
    old = spark.createDataFrame([(A, 7, "x")], TABLES["addresses"])
    assert tuple(store.upsert_addresses(old, spark.createDataFrame([(A, None, None), (A, 5, None)], TABLES["addresses"])).first()) == (A, 5, "x")


def test_files(spark, tmp_path):
    gold = tmp_path / "gold.csv"
    gold.write_text(f"address_a,address_b,label,rationale\n {B} ,{A},SAME_control,x\n{A},{A},uncertain,y\n")
    assert [tuple(r)[:3] for r in landed.read_gold(spark, str(gold)).select("address_a", "address_b", "label").collect()] == [(A, B, "same_control")]
    flexible = tmp_path / "flex.csv"
    flexible.write_text(f"Source,Target,gold\n{A},{B},uncertain\n{B},{A},same_control\n")
    assert [tuple(r) for r in landed.read_flexible_gold(spark, str(flexible)).collect()] == [(A, B, "same_control")]
    deny = tmp_path / "deny.txt"
    deny.write_text(f"# no\n\n {A}\n{A}\n")
    assert [r["address"] for r in landed.read_denylist(spark, str(deny)).collect()] == [A]
    assert landed.read_denylist(spark, None).count() == 0
    seeds = tmp_path / "seeds.csv"
    seeds.write_text(f"address,first_seen_block,seed_type\n{A},12,voter\n")
    assert [tuple(r) for r in landed.read_seeds(spark, str(seeds), "governance").collect()] == [(A, 12, "governance")]
    snap = tmp_path / "s.json"
    snap.write_text('{"snapshot_hash": "abc"}')
    assert landed.read_snapshot_hash(spark, str(snap)) == "abc"
    params = tmp_path / "p.json"
    params.write_text(json.dumps({k: v for k, v in json.loads(LinkageParams().to_json()).items() if k != "w_safe_owner_min_overlap"}))
    assert landed.read_params(spark, str(params)).w_safe_owner_min_overlap == 0.0
    assert landed.Config.from_env({"LINKWEAVE_NETWORKS": "a, b,", "LINKWEAVE_CHAIN": " Scroll "}) == landed.Config(chain="scroll", networks=("a", "b"))


def test_text_functions(spark):
    row = spark.createDataFrame([(" A, b,,", '{"shared_evidence_keys": ["k"]}', "oops", "- Gini coefficient: **0.125**\n")], "a string, b string, c string, d string")
    c = F.col
    got = row.select(scalar.comma_list(c("a")), scalar.shared_keys_of(c("b")), scalar.shared_keys_of(c("c")), scalar.report_metric(c("d"), "Gini"), scalar.report_metric(c("d"), "Nakamoto"), F.length(scalar.row_hash(c("a"), c("b"))), scalar.dot_escape(F.lit('a"b')), scalar.html_escape(F.lit("<&>"))).first()
    assert tuple(got) == (["a", "b"], ["k"], [], 0.125, None, 64, 'a\\"b', "&lt;&amp;&gt;")


def test_logs(spark):
    from linkweave import schemas as x

    pad = lambda c: "0x" + "0" * 24 + c * 40
    rows = [
        ("0x10", x.TOPIC_VOTE_CAST, pad("A"), None, "0x", x.GOVERNORS[0]),
        ("0x11", x.TOPIC_PROPOSAL_CREATED, None, None, "0x" + "0" * 64 + pad("b")[2:], x.GOVERNORS[1].upper().replace("0X", "0x")),
        ("0x12", x.TOPIC_VOTE_CAST, pad("c"), None, "0x", x.TOKEN),
        ("0x13", x.TOPIC_PROPOSAL_CREATED, None, None, "0x", x.GOVERNORS[0]),
        ("0x14", x.TOPIC_TRANSFER, pad("d"), pad("e"), "0x", x.TOKEN),
        ("zz", x.TOPIC_TRANSFER, pad("d"), None, "0x", x.TOKEN),
    ]
    logs = spark.createDataFrame(rows, "block_hex string, topic0 string, topic1 string, topic2 string, data string, contract string")
    assert {tuple(r) for r in landed.decode_logs(logs).collect()} == {("vote", "0x" + "a" * 40, 16), ("proposal", "0x" + "b" * 40, 17)}
    assert landed.decode_logs(logs.drop("contract")).count() == 3
    assert [tuple(r) for r in landed.decode_transfer_logs(logs).collect()] == [("0x" + "d" * 40, "0x" + "e" * 40, 20)]
