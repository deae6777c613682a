"""Pair scores, lineage, evaluation, graph bounds, cohorts, baseline and cluster features."""

import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators import audit, baseline, cohort, evaluation, features, graph, hubs, lineage, linking, pairwise
from linkweave.runtime import checkpoint
from linkweave.schemas import LEGACY, TABLES, LinkageParams

A, B, C, D = ("0x" + c * 40 for c in "abcd")


def _evidence(spark, rows):
    return spark.createDataFrame([(a, k, key, s, "test", b, p) for a, k, key, s, b, p in rows], TABLES["evidence"])


def _members(spark, clusters):
    return spark.createDataFrame([(c, a) for c, members in clusters.items() for a in members], "cluster_id string, address string")


def test_owner_overlap_scores(spark):
    rows = [(A, "safe_owner", f"o{n}", 2, 0, None) for n in range(5)] + [(B, "safe_owner", f"o{n}", 2, 0, None) for n in range(3)]
    got = pairwise.score_evidence(_evidence(spark, rows)).first()
    assert (got["owner_jaccard"], got["owner_min_overlap"], got["score"], got["tier"]) == (0.6, 1.0, 8.0, "accepted")
    assert got["probability"] == pytest.approx(0.8807970779778823)
    assert got["contributions"] == {"safe_owner_min_overlap": 8.0}
    jaccard = pairwise.score_evidence(_evidence(spark, rows), LinkageParams(w_safe_owner_min_overlap=0.0, w_safe_owner_jaccard=10.0, w_shared_safe_owner_count=0.5)).first()
    assert jaccard["contributions"] == {"safe_owner_jaccard": 6.0, "shared_safe_owner_count": 1.5}


def test_one_funder_is_uncertain_and_anchor_is_accepted(spark):
    import math

    funded = pairwise.score_evidence(_evidence(spark, [(x, "funded_by", "F", 2, 1, None) for x in (A, B)])).first()
    assert funded["score"] == pytest.approx(3 / math.log(4)) and funded["tier"] == "uncertain"
    strict = LinkageParams(t_high=99, t_low=98)
    anchored = pairwise.score_evidence(_evidence(spark, [(x, "did_controller", "K", 3, 1, None) for x in (A, B)]), strict).first()
    assert anchored["tier"] == "accepted" and anchored["anchor"]
    none = pairwise.score_evidence(_evidence(spark, []), pairs=spark.createDataFrame([(B, A)], "address_a string, address_b string")).first()
    assert (none["address_a"], none["score"], none["tier"], none["structural"]) == (A, 0.0, "rejected", False)


def _labels(spark, current, previous, **options):
    rows = lineage.lineage(_members(spark, current), _members(spark, previous), current_run="r2", previous_run="r1", **options).collect()
    return sorted((r["transition_label"], r["current_cluster_id"], r["previous_cluster_id"]) for r in rows) if all(r["current_cluster_id"] and r["previous_cluster_id"] for r in rows) else sorted((r["transition_label"], r["current_cluster_id"] or "", r["previous_cluster_id"] or "") for r in rows)


def test_lineage_cases(spark):
    assert _labels(spark, {"c": "abcd"}, {"p": "ab"}) == [("stable", "c", "p")]
    assert _labels(spark, {"c": "axyzw"}, {"p": "abcde"}) == [("related", "c", "p")]
    assert _labels(spark, {"c1": "ab", "c2": "mn"}, {"p1": "ab", "p2": "xy"}, related=0.2) == [("disappeared", "", "p2"), ("new", "c2", ""), ("stable", "c1", "p1")]
    assert _labels(spark, {"c1": "ab", "c2": "cd"}, {"p1": "abcd"}) == [("stable", "c1", "p1")]
    assert _labels(spark, {"c1": "abcd"}, {"p1": "ab", "p2": "cd"}) == [("stable", "c1", "p1")]
    assert _labels(spark, {}, {}) == []
    with pytest.raises(ValueError):
        lineage.overlaps(_members(spark, {}), _members(spark, {}), 0)


def test_greedy_matching_is_the_sequential_one(spark):
    dice = random.Random(4)
    rows = list({(f"c{dice.randrange(12)}", f"p{dice.randrange(12)}"): None for _ in range(60)})
    frame = [(c, p, dice.randrange(1, 4), dice.choice((0.2, 0.4, 0.6))) for c, p in rows]
    taken, cs, ps = set(), set(), set()
    for c, p, n, j in sorted(frame, key=lambda r: (-r[3], -r[2], r[0], r[1])):
        if c not in cs and p not in ps:
            taken.add((c, p))
            cs.add(c)
            ps.add(p)
    schema = "current_cluster_id string, previous_cluster_id string, overlap_count long, jaccard double"
    assert {(r[0], r[1]) for r in lineage.greedy_matching(spark.createDataFrame(frame, schema)).select("current_cluster_id", "previous_cluster_id").collect()} == taken


@pytest.mark.parametrize("fold", [5000, 300])
def test_a_chain_of_falling_overlaps_takes_few_rounds(spark, monkeypatch, fold):
    """1,000 candidates, each in the way of the next; with a small bound the chain is first broken up by rounds."""
    frame = [(f"c{n // 2 + n % 2:04d}", f"p{n // 2:04d}", 2000 - n, 0.9 - n / 10_000) for n in range(1000 if fold == 5000 else 310)]
    seen = []
    mutual = lineage._mutual
    monkeypatch.setattr(lineage, "_mutual", lambda left: seen.append(1) or mutual(left))
    got = lineage.greedy_matching(spark.createDataFrame(frame, "current_cluster_id string, previous_cluster_id string, overlap_count long, jaccard double"), fold=fold)
    assert sorted((r[0], r[1]) for r in got.collect()) == [(c, p) for c, p, _, _ in frame[::2]]
    assert len(seen) <= (2 if fold == 5000 else 8)
    assert lineage.greedy_matching(got.where("false")).count() == 0


def test_lineage_guards_and_latest_run(spark):
    now, before = lineage.RunWindow("r2", "x", "p", 1, 2), lineage.RunWindow("r1", "x", "p", 1, 2)
    assert lineage.skip_reason(now, before) is None
    assert lineage.skip_reason(lineage.RunWindow("r2", "x", "p", 0, 0), before) == lineage.WINDOW_NOT_SET
    assert lineage.skip_reason(now, None) == lineage.NO_PREVIOUS
    assert lineage.skip_reason(now, lineage.RunWindow("r1", "x", "p", 0, 0)) == lineage.PREVIOUS_WINDOW_NOT_SET
    assert lineage.skip_reason(now, lineage.RunWindow("r1", "x", "q", 1, 2)) == lineage.NOT_COMPARABLE
    runs = spark.createDataFrame([("a", "x", 1), ("c", "x", 2), ("b", "x", 2), ("d", "y", 0)], "run_id string, chain string, created_at long")
    assert {r["run_id"] for r in lineage.latest_run(runs, "chain").collect()} == {"c", "d"}
    assert lineage.latest_run(runs).first()["run_id"] == "c" and lineage.latest_run(runs.limit(0)).count() == 0


def test_confusion_and_precision(spark):
    gold = spark.createDataFrame([(A, B, "same_control"), (A, C, "different_control"), (C, D, "uncertain")], "address_a string, address_b string, label string")
    evidence = _evidence(spark, [(x, "safe_owner", "o", 2, 0, None) for x in (A, B)])
    found = evaluation.evaluate(gold, evidence, ["all_evidence", "funded_by_only"], min_evidence=1)
    rows = {r["mode"]: r for r in found["confusion"].collect()}
    assert [rows["all_evidence"][f"{p}_{c}"] for p in ("rule", "score") for c in ("tp", "fp", "tn", "fn")] == [1, 0, 1, 0] * 2 and rows["all_evidence"]["ambiguous"] == 1
    assert rows["funded_by_only"]["rule_fn"] == 1
    assert {(r["k"], r["precision"]) for r in found["precision"].where("mode = 'all_evidence'").collect()} == {(1, 1.0), (2, 0.5)}
    assert {(r["mode"], r["cluster_count"]) for r in found["counts"].collect()} == {("all_evidence", 3), ("funded_by_only", 4)}


def test_graph_bounds(spark):
    safes = [f"0x{n:040x}" for n in range(11)]
    shared = _evidence(spark, [(s, "safe_owner", "owner", 2, 0, '{"a": 1}') for s in safes])
    members = _members(spark, {s: [s] for s in safes})
    ids = graph.identifier_nodes(members, 10)
    assert ids.count() == 10 and graph.evidence_nodes(shared, ids, cap=10).count() == 0
    doc = graph.evidence_graph({"run_id": "r"}, shared, members, cap=11, max_identifiers=10, max_evidence=1)
    assert len(doc["nodes"]) == 11 and len(doc["links"]) == 10 and doc["evidence_events"][0]["payload"] == {"a": 1}
    assert doc["limits"]["truncated_identifiers"] and not doc["limits"]["truncated_evidence"]
    whole = _members(spark, {A: [A, B, C], D: [D], "0xe": ["0xe"]})
    assert {r["address"] for r in graph.identifier_nodes(whole, 2).collect()} == {D, "0xe"}
    pairs = graph.pairwise_graph({"run_id": "r"}, _evidence(spark, [(x, "did_controller", "k", 3, 0, None) for x in (A, B)]), whole, max_identifiers=10)
    assert [x["tier"] for x in pairs["links"]] == ["accepted"] and pairs["limits"]["max_evidence_nodes"] == 0


def test_cluster_selection_is_the_walk(spark):
    dice = random.Random(8)
    for bound in (7, 20):
        clusters = {f"c{n:02}": [f"{n}-{k}" for k in range(dice.choice((1, 1, 2, 3, 5, 9)))] for n in range(25)}
        used, want = 0, set()
        for c in sorted(clusters, key=lambda c: (-len(clusters[c]), c)):
            if used + len(clusters[c]) <= bound:
                used, want = used + len(clusters[c]), want | {c}
        assert {r["cluster_id"] for r in graph.selected_clusters(_members(spark, clusters), bound).collect()} == want


def test_stratified_sample(spark):
    dice = random.Random(2)
    rows = [(f"a{n:03}", dice.randrange(0, 40)) for n in range(60)]
    by = {i: sorted(((b, a) for a, b in rows if min(4, b * 5 // 100) == i)) for i in range(5)}
    first = [x for i in range(5) for x in by[i][:6]]
    spare = sorted(x for i in range(5) for x in by[i][6:])
    want = {a for _, a in first + spare[: 30 - len(first)]}
    frame = spark.createDataFrame(rows, "address string, first_seen_block long")
    got = cohort.stratified_sample(frame, 0, 99, 5, 30)
    assert {r["address"] for r in got.collect()} == want
    assert [r["n"] for r in cohort.stratum_counts(frame, 0, 99, 5).orderBy("stratum").collect()] == [len(by[i]) for i in range(5)]
    with pytest.raises(ValueError):
        cohort.stratified_sample(frame, 0, 99, 5, 31)


def test_cohort_rules(spark):
    members = _members(spark, {A: [A, B], C: [C], D: [D]})
    roles = spark.createDataFrame([(A, "governance"), (B, "control"), (C, "control"), (C, "governance")], "address string, role string")
    assert {r["cluster_id"]: r["tier"] for r in cohort.coordination_tiers(members, roles).collect()} == {A: "multi_identifier_coordination_mixed_governance_and_control", C: "singleton_negative_control_reference", D: "singleton"}
    merged = cohort.merge_governance(spark.createDataFrame([(A, 9)], "address string, first_seen_block long"), spark.createDataFrame([(A, 3), (B, 4)], "address string, first_seen_block long"))
    assert {tuple(r) for r in merged.collect()} == {(A, 3, "voter"), (B, 4, "proposer")}
    shared = spark.createDataFrame([(A, "funded_by", "F")], "cluster_id string, kind string, key string")
    services = spark.createDataFrame([("funded_by", "F", 9)], "kind string, key string, fan_out long")
    assert {r["cluster_id"]: r["dominated"] for r in cohort.service_dominated(members, shared, services, min_size=2).collect()} == {A: True, C: False, D: False}


def test_baseline_rows(spark):
    rows = [(x, k, "k1", 2, b, None) for x, k, b in ((A, "safe_owner", 5), (B, "safe_owner", 9), (A, "ens_handle", 0), (B, "ens_handle", 0))]
    got = baseline.pair_baseline(_evidence(spark, rows), spark.createDataFrame([(x,) for x in (A, B, C)], "address string")).orderBy("address_a", "address_b").collect()
    assert [(r["recommendation"], r["confidence"], r["secondary_signals"], r["temporal_pattern"]) for r in got] == [("identity_claim_candidate", "medium", "control_link_candidate", "short_burst"), *[("insufficient_evidence", "none", "", "unknown")] * 2]
    h = got[0]["hub_penalty"]
    assert got[0]["related_score"] == round((0.12 + 0.1) * h, 4) and got[0]["control_score"] == round(0.22 * h, 4) and got[0]["did_score"] == 0.0
    frame = spark.createDataFrame([(x / 10,) for x in (1, 2, 2, 3, 9)], "hub_penalty double")
    assert tuple(baseline.hub_quantiles(frame).first()) == (5, 0.1, 0.2, 0.2, 0.3, 0.9)


def test_a_hub_of_equal_addresses_is_a_few_rows(spark):
    """5,000 addresses on one key, some with a claim of their own and one other key among ten of them."""
    rows = [(f"x{n:05d}", "funded_by", "hub", 2, 5, None) for n in range(5000)] + [(f"x{n:05d}", "ens_handle", f"own{n}", 2, 0, None) for n in range(0, 5000, 2)]
    rows += [(f"x{n:05d}", "safe_owner", "ten", 2, 9 + n % 2, None) for n in range(10)]
    e, addresses = _evidence(spark, rows), spark.createDataFrame([(f"x{n:05d}",) for n in range(4999)] + [("y",)], "address string")
    found = baseline.class_baseline(e, addresses)
    got = found.collect()
    assert len(got) == 6 and sum(r["n_pairs"] for r in got) == 5000 * 4999 // 2 and sum(r["n_known"] for r in got) == 4999 * 4998 // 2
    assert baseline.diagnostics(found, 7).first()["pair_count"] == 5000 * 4999 // 2 + 7
    assert baseline.diagnostics(found).first()["pairs_with_safe_owner"] == 45
    assert baseline.zero_pair_count(found, addresses) == 4999
    assert baseline.hub_quantiles(found).first()["n"] == 5000 * 4999 // 2


def test_each_two_rows_of_a_key_meet_once(spark):
    rows = spark.createDataFrame([(k, n, 10 * n) for k, size in ((1, 40), (2, 3), (3, 1)) for n in range(size)], "k int, n int, v int")
    for split in (1, 7, 1000):
        got = [(r["k"], *sorted((r["n"], r["n_b"]))) for r in hubs.meetings(rows, ["k"], "n", split=split).collect()]
        assert sorted(got) == [(k, a, b) for k, size in ((1, 40), (2, 3), (3, 1)) for a in range(size) for b in range(a, size)]


def test_classes_give_the_pairs_counters(spark, monkeypatch):
    """Few keys and sources, so that classes, self-pairs and blocks of a hub all occur."""
    monkeypatch.setattr(hubs, "SPLIT", 3)
    dice = random.Random(8)
    rows = [(f"x{dice.randrange(40)}", dice.choice(["safe_owner", "ens_handle"]), f"k{dice.randrange(4)}", 2, dice.choice([0, 3, 9]), None) for _ in range(90)] + [(f"x{n}", "funded_by", "hub", 2, n % 3, None) for n in range(40)]
    e, addresses = _evidence(spark, rows), spark.createDataFrame([(f"x{n}",) for n in range(0, 50, 3)], "address string")
    pairs, classes = checkpoint(baseline.pair_baseline(e)), checkpoint(baseline.class_baseline(e, addresses))
    assert pairs.count() == 780 == pairs.select("address_a", "address_b").distinct().where("address_a < address_b").count()
    assert classes.count() < 780
    assert baseline.diagnostics(classes).first() == baseline.diagnostics(pairs).first()
    assert baseline.hub_quantiles(classes).first() == baseline.hub_quantiles(pairs).first()
    assert baseline.zero_pair_count(classes, addresses) == baseline.zero_pair_count(pairs, addresses)
    assert baseline.class_baseline(e.where("false")).count() == 0


def test_counted_zero_pairs_equal_made_ones(spark):
    e = _evidence(spark, [(x, "safe_owner", "k1", 2, 5, None) for x in (A, B, "0xelse")])
    addresses = spark.createDataFrame([(x,) for x in (A, B, C, D)], "address string")
    found, whole = baseline.pair_baseline(e), baseline.pair_baseline(e, addresses)
    zero = baseline.zero_pair_count(found, addresses)
    assert zero == 5 and whole.count() == 8
    assert baseline.diagnostics(found, zero).first() == baseline.diagnostics(whole).first()
    assert baseline.diagnostics(found, zero).first()["pairs_with_no_evidence"] == 5
    assert baseline.hub_quantiles(found, zero).first() == baseline.hub_quantiles(whole).first()
    gold = spark.createDataFrame([(A, B, "same"), (C, D, "different"), (C, "0xnone", "same")], "address_a string, address_b string, label string")
    got = {tuple(r) for r in baseline.gold_matrix(found, gold, addresses).collect()}
    assert got == {("same", "control_link_candidate", 1), ("different", "insufficient_evidence", 1), ("same", "missing", 1)}


def test_zero_pairs_of_a_long_list(spark):
    """All pairs of 2,001 addresses but the found ones, over several blocks."""
    n = 2001
    addresses = spark.range(n).select(F.concat(F.lit("0X"), F.lpad(F.col("id").cast("string"), 40, "0")).alias("address"))
    rows = _evidence(spark, [(f"0x{x:040}", "safe_owner", "k", 2, 5, None) for x in (3, 700, 1900)])
    zero = baseline.zero_pairs(addresses, baseline.pair_features(rows))
    pair = zero.select(F.struct("address_a", "address_b").alias("p"), "address_a", "address_b")
    assert pair.agg(F.count("*"), F.countDistinct("p"), F.count_if(F.col("address_a") >= F.col("address_b"))).first() == (n * (n - 1) // 2 - 3, n * (n - 1) // 2 - 3, 0)


def test_zero_pairs_query_takes_all_addresses(spark):
    from linkweave.plans.queries import Inputs, QUERIES

    sf = "/root/testdata/sf0.01"
    i = Inputs(spark, sf)
    n = i.subjects.count()
    known = [r["address"] for r in i.subjects.collect()]
    found = baseline.pair_features(i.evidence).where(F.col("address_a").isin(known) & F.col("address_b").isin(known)).count()
    assert n > 200 and QUERIES["baseline_zero_pairs"](spark, sf).count() == n * (n - 1) // 2 - found


def test_cluster_features(spark):
    moves = spark.createDataFrame([("f", A, "1", 10, "1", "E"), ("f", B, "1", 12, "2", "E"), ("g", C, "1", 5, "3", "E"), (A, "s", "1", 20, "4", "E"), (B, "s", "1", 21, "5", "E"), (A, B, "1", 22, "6", "E")], TABLES["transfers"])
    rows = [(A, "funded_by", "f", 2, 10, None), (B, "funded_by", "f", 2, 12, None), (C, "funded_by", "f", 2, 0, None), (C, "safe_owner", A, 2, 0, '{"contract": "X", "method": ["m", " M "]}'), (D, "safe_owner", A, 2, 0, '{"contract": "x"}')]
    members = _members(spark, {A: [A, B, C], D: [D]})
    got = {r["cluster_id"]: r for r in features.cluster_features(_evidence(spark, rows), members, moves).collect()}
    a = got[A]
    assert (a["num_unique_funders"], a["top_funder"], a["top_funder_share"], a["funding_block_span"], a["funding_burst_label"]) == (1, "f", 1.0, 2, "short_burst")
    assert (a["num_unique_sinks"], a["top_sink"], a["top_sink_count"], a["top_sink_share"], a["possible_consolidation"]) == (1, "s", 2, 1.0, True)
    assert (a["first_funder_shared_count"], a["num_evidence_rows"], a["num_identifiers"]) == (2, 5, 3)
    assert (a["safe_owner_count"], a["shared_safe_owner_count"], a["control_link_density"]) == (2, 1, 0.0)
    assert (a["tier"], a["reasons"]) == ("candidate_high", "high_funding,high_sink") and got[D]["tier"] == "low"
    assert (a["contract_addresses"], a["contract_overlap"], a["method_addresses"]) == (1, None, 1)


def test_features_of_a_hub(spark):
    """5,000 members on one owner and one token are few classes; the figures are those of all pairs."""
    n = 5000
    addresses = [f"0x{k:040x}" for k in range(n)]
    members = _members(spark, {"c": addresses})
    rows = []
    for k, a in enumerate(addresses):
        rows.append(("c", a, "safe_owner", "hub", '{"contract": ["t"' + (f', "u{k % 3}"' if k % 2 else "") + "]}"))
        rows += [("c", a, "safe_owner", "other", None)] * (k < 10)
    rows = spark.createDataFrame(rows + [("d", "0xd", "safe_owner", "hub", None)], "cluster_id string, address string, kind string, key string, payload_json string")
    members = members.unionByName(_members(spark, {"d": ["0xd"]}))
    got = {r["cluster_id"]: r["control_link_density"] for r in features.control(rows, members).collect()}
    assert got == {"c": 1.0, "d": None}
    sets = [frozenset(["t"] + [f"u{k % 3}"] * (k % 2)) for k in range(n)]
    kinds = {s: sets.count(s) for s in set(sets)}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    total = sum(m * kinds[b] * jaccard(a, b) for a, m in kinds.items() for b in kinds) - n
    row = features.token_overlap(rows, members).where("cluster_id = 'c'").first()
    assert row["contract_addresses"] == n and row["contract_overlap"] == pytest.approx(total / (n * (n - 1)))


def test_pairs_among_some_addresses(spark):
    dice = random.Random(6)
    evidence = _evidence(spark, [(dice.choice((A, B, C, D)), dice.choice(("safe_owner", "funded_by", "did_controller")), dice.choice("kmn"), 2, 0, None) for _ in range(30)])
    some = spark.createDataFrame([(A,), (C,), (D,)], "address string")
    everything = {(r["address_a"], r["address_b"]): r for r in pairwise.score_evidence(evidence).collect()}
    got = {(r["address_a"], r["address_b"]): r for r in pairwise.score_evidence(evidence, among=some).collect()}
    assert got == {pair: r for pair, r in everything.items() if B not in pair} and len(got) < len(everything)


def test_audit(spark):
    rows = _evidence(spark, [(A, "funded_by", "f", 2, 3, '{"tx_hash": "t", "timestamp": "2020"}'), (A, "funded_by", "f", 2, 0, None), (B, "funded_by", "f", 2, 0, "not json")])
    assert tuple(audit.duplication(rows).first()) == (3, 2, 2, 1, 1, 1.5, 1.5)
    assert tuple(audit.temporal(rows).first()) == (True, 3, 3, True, "2020", "2020")
    assert tuple(audit.readiness(rows).first()) == (True, False, False, False, True)
    assert tuple(audit.readiness(rows.limit(0)).first()) == (False,) * 5
    assert audit.duplication(rows.limit(0)).first()["rows_per_pair"] is None


def test_plans_keep_the_cap_before_the_join(spark):
    """The popular key is removed on both sides before rows meet."""
    rows = _evidence(spark, [(f"0x{n:040x}", "funded_by", "hub", 2, 0, None) for n in range(200)])
    assert linking.shared_rows(rows, LEGACY).count() == 0
    assert linking.pair_stats(rows, LEGACY).where(F.col("n_edges") > 0).count() == 0
