"""Merge rules, components and metrics on hand-made evidence."""

import itertools
import pathlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from linkweave import runtime
from linkweave.operators import components, linking, metrics
from linkweave.operators import evidence as ev
from linkweave.operators.components import connected_components
from linkweave.schemas import CONSERVATIVE, EXCHANGES, LEGACY, TABLES, ZERO_ADDRESS, MergePolicy

A, B, C, D, E = ("0x" + c * 40 for c in "abcde")
F1, F2, F3, F4 = ("0xf" + c * 39 for c in "1234")


def _evidence(spark, rows):
    """rows: (address, kind, key, strength, block)"""
    return spark.createDataFrame([(a, k, key, s, "test", b, None) for a, k, key, s, b in rows], TABLES["evidence"])


def _transfers(spark, rows):
    return spark.createDataFrame([(f, t, "1", b, f"0x{n}", "ETH") for n, (f, t, b) in enumerate(rows)], TABLES["transfers"])


def _addresses(spark, addresses):
    return spark.createDataFrame([(a,) for a in addresses], "address string")


def _clusters(spark, addresses, evidence, policy=LEGACY, me=1):
    found = {}
    for r in linking.clusters(_addresses(spark, addresses), evidence, policy, me).collect():
        found.setdefault(r["cluster_id"], set()).add(r["address"])
    assert all(min(v) == k for k, v in found.items())
    return sorted(sorted(v) for v in found.values())


def _funded(spark, transfers, addresses, policy=CONSERVATIVE, me=1):
    subjects = _addresses(spark, addresses)
    return _clusters(spark, addresses, ev.extract_funded_by(_transfers(spark, transfers), subjects), policy, me)


def test_golden_slice(spark):
    cex = EXCHANGES[0]
    moves = [(F1, A, 100), (F1, B, 101), (F2, A, 102), (F2, B, 103), (F3, C, 104), (F3, D, 105), (F4, E, 106), (cex, B, 107), (cex, C, 108)]
    assert _funded(spark, moves, [A, B, C, D, E], LEGACY) == [[A, B], [C, D], [E]]


@pytest.mark.parametrize(
    ("moves", "policy", "n"),
    [
        ([(F1, A, 100), (F1, B, 120)], CONSERVATIVE, 2),
        ([(F1, A, 100), (F1, B, 200100), (F2, A, 300), (F2, B, 300300)], CONSERVATIVE, 2),
        ([(F1, A, 100), (F1, B, 120), (F2, A, 300), (F2, B, 320)], CONSERVATIVE, 1),
        ([(ZERO_ADDRESS, A, 100), (ZERO_ADDRESS, B, 120), (F2, A, 300), (F2, B, 320)], CONSERVATIVE, 2),
        ([(F1, A, 100), (F1, B, 120), (F2, A, 300), (F2, B, 320)], LEGACY, 1),
    ],
)
def test_funding_policy(spark, moves, policy, n):
    assert len(_funded(spark, moves, [A, B], policy)) == n


def test_funded_service_cap(spark):
    policy = MergePolicy(funded_fan_out_cap=2)
    moves = [(F1, A, 100), (F1, B, 120), (F2, A, 300), (F2, B, 320), (F1, C, 130)]
    assert len(_funded(spark, moves, [A, B, C], policy)) == 3


def test_strong_alone_and_weak_never(spark):
    strong = _evidence(spark, [(x, "did_controller", F1, 3, 0) for x in (A, B)])
    for policy, me in ((LEGACY, 2), (CONSERVATIVE, 5)):
        assert _clusters(spark, [A, B], strong, policy, me) == [[A, B]]
    weak = _evidence(spark, [(x, "ens_handle", f"k:{n}", 1, 0) for x in (A, B) for n in range(9)])
    assert len(_clusters(spark, [A, B], weak)) == 2


def test_cap_is_strict(spark):
    many = [f"0x{n:040x}" for n in range(51)]
    shared = _evidence(spark, [(a, "funded_by", F1, 2, 1) for a in many])
    assert len(_clusters(spark, many, shared)) == 51
    assert [tuple(r) for r in linking.service_keys(shared, LEGACY).collect()] == [("funded_by", F1, 51)]
    assert len(_clusters(spark, many[:50], shared)) == 1


def test_rows_multiply_and_foreign_evidence_does_not_link(spark):
    rows = [(A, "funded_by", F1, 2, 5), (A, "funded_by", F1, 2, 6), (B, "funded_by", F1, 2, 7), (C, "funded_by", F2, 2, 0), (D, "funded_by", F2, 2, 0)]
    stats = linking.pair_stats(_evidence(spark, rows), LEGACY).where(f"address_a = '{A}'").first()
    assert (stats["n_edges"], stats["funded_keys"], stats["burst_hits"]) == (2, 1, 2)
    assert _clusters(spark, [A, B, C], _evidence(spark, rows), LEGACY, 2) == [[A, B], [C]]
    assert _clusters(spark, [A, A, B], _evidence(spark, rows), LEGACY, 2) == [[A, B]]


def test_shared_keys_hold_more_than_passing_edges(spark):
    from linkweave.operators import report

    rows = [(x, "safe_owner", k, 2, 0) for x, ks in ((A, ("o1", "o2")), (B, ("o1", "o2", "o3", "o4")), (C, ("o3", "o4"))) for k in ks] + [(A, "funded_by", F1, 2, 0), (C, "funded_by", F1, 2, 0)]
    evidence = _evidence(spark, rows)
    members = linking.clusters(_addresses(spark, [A, B, C]), evidence, LEGACY, 2)
    edges = {(r["source"], r["target"]) for r in report.passing_edges(evidence, members, min_evidence=2).collect()}
    assert edges == {(A, B), (B, C)}
    assert {r["key"] for r in linking.cluster_shared_keys(evidence, members, LEGACY).collect()} == {"o1", "o2", "o3", "o4", F1}
    assert {r["key"] for r in report.passing_keys(report.passing_edges(evidence, members, min_evidence=2)).collect()} == {"o1", "o2", "o3", "o4"}
    phrase = report.cluster_descriptors(members, report.passing_edges(evidence, members, min_evidence=2)).first()["descriptor"]
    assert phrase == "Shared-owner governance-control cluster"
    run = {"run_id": "r1", "started_at": "now", "params_json": "{}"}
    dot = report.render_dot(run, evidence, members, linking.service_keys(evidence, LEGACY), min_evidence=2)
    assert f'"{A}" -- "{B}"' in dot and f'"{A}" -- "{C}"' not in dot
    text = report.render_markdown(run, evidence, members, linking.service_keys(evidence, LEGACY), min_evidence=2)
    assert "Shared-owner governance-control cluster" in text and F1 not in text


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_are_those_of_union_find(spark, pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    frame = spark.createDataFrame(pairs, "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(frame).collect()} == {x: find(x) for x in parent}


def test_components_of_edges_that_turn_with_each_evaluation(spark):
    """A list that names its edges anew at each evaluation, as one that follows a shuffle's order may."""

    def turned(batches):
        dice = random.SystemRandom()
        for frame in batches:
            swap = [dice.random() < 0.5 for _ in range(len(frame))]
            yield frame.assign(a=frame.a.where(swap, frame.b), b=frame.b.where(swap, frame.a))

    edges = spark.createDataFrame([(n, n + 1) for n in range(400)], "a long, b long").mapInPandas(turned, "a long, b long")
    assert {(r["node"], r["component"]) for r in connected_components(edges).collect()} == {(n, 0) for n in range(401)}


def test_long_chain(spark):
    frame = spark.range(300).selectExpr("id as a", "id + 1 as b")
    found = connected_components(frame)
    assert found.count() == 301 and {r["component"] for r in found.collect()} == {0}


@pytest.mark.parametrize("order", ["random", "zigzag", "rotated"])
def test_rounds_on_chains_in_any_order(spark, order, monkeypatch):
    n = 4000
    nodes = {"random": random.Random(3).sample(range(n), n), "zigzag": [x for i in range(n // 2) for x in (i, n - 1 - i)], "rotated": [*range(1, n), 0]}[order]
    folders = []
    monkeypatch.setattr(components, "written", lambda df, folder: folders.append(folder) or runtime.written(df, folder))
    found = connected_components(spark.createDataFrame(list(itertools.pairwise(nodes)), "a long, b long"))
    assert {r["component"] for r in found.collect()} == {0} and found.count() == n
    assert len(folders) - 2 <= 20
    # only the last round is left on disk
    root = pathlib.Path(folders[0].removeprefix("file:")).parent
    assert [p.name for p in root.iterdir()] == [folders[-1].rsplit("/", 1)[1]]


def test_checkpoint_folder_of_a_cluster_has_to_be_named():
    class Unset:
        master = "spark://host:7077"
        getConf = lambda self: {}

        class _jsc:
            sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError):
        runtime.checkpoint_dir(type("S", (), {"sparkContext": Unset()}))


@pytest.mark.parametrize(("sizes", "threshold", "k"), [([5, 5], 0.5, 2), ([10, 1, 1], 0.5, 1), ([1, 2, 3], 1.0, 3), ([], 0.5, None), ([0, 0], 0.5, None), ([1] * 9, 0.5, 5), ([3, 1, 1, 1, 1], 0.5, 2)])
def test_nakamoto(spark, sizes, threshold, k):
    frame = spark.createDataFrame([(x,) for x in sizes], "size long")
    assert metrics.concentration(frame, threshold).first()["nakamoto"] == k


@pytest.mark.parametrize("sizes", [[3, 3, 3, 3], [100, 0, 0, 0], [1, 2, 3, 4, 4], [7]])
def test_gini(spark, sizes):
    n, x = len(sizes), sorted(sizes)
    want = 2 * sum((i + 1) * v for i, v in enumerate(x)) / (n * sum(x)) - (n + 1) / n
    assert metrics.concentration(spark.createDataFrame([(v,) for v in sizes], "size long")).first()["gini"] == pytest.approx(want)


def test_conservative_refines_legacy(spark):
    moves = [(f, a, 1000 * n) for n, (f, a) in enumerate(itertools.product((F1, F2, F3), (A, B, C)))]
    fine, coarse = _funded(spark, moves, [A, B, C, D], CONSERVATIVE, 2), _funded(spark, moves, [A, B, C, D], LEGACY, 2)
    assert all(any(set(f) <= set(c) for c in coarse) for f in fine)


def test_mixed_strengths_give_the_strongest_edge(spark):
    from linkweave.operators import report

    for rows in ([(A, 1), (A, 3), (B, 1)], [(B, 1), (A, 3), (A, 1)]):
        evidence = _evidence(spark, [(a, "did_controller", F1, s, n) for n, (a, s) in enumerate(rows)])
        members = linking.clusters(_addresses(spark, [A, B]), evidence, LEGACY, 9)
        (edge,) = report.passing_edges(evidence, members, min_evidence=9).collect()
        assert (edge["source"], edge["target"], edge["strength"], edge["keys"]) == (A, B, 3, [F1])


def test_handles_merge_in_any_case_and_kinds_stack(spark):
    subjects = _addresses(spark, [A, B])
    ens = spark.createDataFrame([(A, None, "@joseph", None, None), (B, "b.eth", " Joseph", None, None)], TABLES["ens_records"])
    handles = ev.extract_ens_handles(ens, subjects)
    assert _clusters(spark, [A, B], handles, LEGACY, 1) == [[A, B]]
    assert _clusters(spark, [A, B], handles, LEGACY, 2) == [[A], [B]]
    both = handles.unionByName(ev.extract_funded_by(_transfers(spark, [(F1, A, 1), (F1, B, 9)]), subjects))
    assert _clusters(spark, [A, B], both, LEGACY, 2) == [[A, B]]
    assert _clusters(spark, [A, B], both, CONSERVATIVE, 2) == [[A, B]]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4), st.integers(0, 20_000)), max_size=25))
def test_clusters_partition_the_subjects_whatever_the_order(spark, moves):
    addresses = [f"0x{n:040x}" for n in range(7)]
    rows = [(f"f{f}", addresses[a], b) for a, f, b in moves]
    once, again = (_funded(spark, r, x, CONSERVATIVE, 2) for r, x in ((rows, addresses), (rows[::-1], addresses[::-1])))
    assert once == again and sorted(a for c in once for a in c) == addresses
