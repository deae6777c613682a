"""Range bisection against the recursion it stands for."""

import random

import pytest

from linkweave.operators import ranges

CALLS = "from_block long, to_block long, attempt int, ok boolean"


def _recursion(lo, hi, answers, retries, least, depth=0):
    """(nodes, counters) of one range; ``answers(lo, hi)`` is the first call that answers, or None."""
    won = answers(lo, hi)
    made = retries + 1 if won is None else won + 1
    here = [(lo, hi, depth, "fetched" if won is not None else "split" if hi - lo + 1 > least else "failed", made, made - 1)]
    if here[0][3] != "split":
        return here
    mid = (lo + hi) // 2
    return here + _recursion(lo, mid, answers, retries, least, depth + 1) + _recursion(mid + 1, hi, answers, retries, least, depth + 1)


@pytest.mark.parametrize(("least", "retries"), [(1, 0), (3, 2), (100, 1)])
def test_bisection_of_landed_calls(spark, least, retries):
    dice = random.Random(least)
    memory = {}
    answers = lambda lo, hi: memory.setdefault((lo, hi), dice.choice([None, None, *range(retries + 1)]))
    blocks = spark.createDataFrame([(7,), (66,), (30,), (None,)], "block_num long")
    given = ranges.chunk_ranges(blocks, 25)
    assert sorted(map(tuple, given.collect())) == [(7, 31), (32, 56), (57, 66)]
    want = [n for r in ((7, 31), (32, 56), (57, 66)) for n in _recursion(*r, answers, retries, least)]
    landed = []
    for (lo, hi), won in memory.items():
        landed += [(lo, hi, a, a == won) for a in range(retries + 1 if won is None else won + 1)]
    calls = spark.createDataFrame(landed + landed[:3], CALLS)
    nodes = ranges.bisect(given.union(given), calls, retries=retries, min_blocks=least)
    assert sorted(map(tuple, nodes.collect())) == sorted(want)
    got = ranges.counters(nodes).first().asDict()
    count = lambda s: sum(n[3] == s for n in want)
    failed = sum(hi - lo + 1 for lo, hi, _, s, _, _ in want if s == "failed")
    assert got == {
        "total_calls": sum(n[4] for n in want), "retries_attempted": sum(n[5] for n in want), "retried_chunks": sum(n[5] for n in want), "split_chunks": count("split"),
        "failed_chunks": count("failed"), "fetched_chunks": count("fetched"), "pending_chunks": 0, "failed_blocks": failed or None,
    }
    fetched = {b for lo, hi, _, s, _, _ in want if s == "fetched" for b in range(lo, hi + 1)}
    rows = spark.createDataFrame([(b, f"x{b}") for b in [*range(0, 80), None, 30, 30]], "block_num long, name string")
    assert sorted(r["block_num"] for r in ranges.rows_in_fetched(nodes, rows).collect()) == sorted([*(b for b in range(80) if b in fetched), *([30, 30] if 30 in fetched else [])])


def test_ranges_without_landed_calls_are_pending(spark):
    given = spark.createDataFrame([(0, 99), (100, 199), (200, 299)], "from_block long, to_block long")
    calls = spark.createDataFrame([(0, 99, 0, False), (0, 99, 1, False), (100, 199, 0, False), (0, 49, 0, True), (0, 49, 5, False)], CALLS)
    nodes = ranges.bisect(given, calls, retries=1, min_blocks=10)
    assert sorted(map(tuple, nodes.collect())) == [(0, 49, 1, "fetched", 1, 0), (0, 99, 0, "split", 2, 1), (50, 99, 1, "pending", 0, 0), (100, 199, 0, "pending", 1, 0), (200, 299, 0, "pending", 0, 0)]
    assert ranges.counters(nodes).first()["pending_chunks"] == 3


def test_counts_follow_the_frontier(spark):
    """The calls may be a function of the frontier; one busy block is counted before the join."""
    rows = spark.createDataFrame([(500,)] * 1000 + [(b,) for b in range(0, 1000, 10)], "block_num long")
    given = ranges.chunk_ranges(rows, 1000)
    seen = []

    def calls(frontier):
        counted = ranges.count_in_ranges(frontier, rows)
        seen.append(sorted(map(tuple, counted.collect())))
        return counted.selectExpr("from_block", "to_block", "0 as attempt", "n < 20 as ok")

    nodes = ranges.bisect(given, calls, retries=0, min_blocks=8)
    assert seen[0] == [(0, 990, 1100)] and all(sum(n for _, _, n in s) <= 1100 for s in seen)
    leaves = [tuple(r) for r in nodes.where("status = 'failed'").collect()]
    assert len(leaves) == 1 and leaves[0][0] <= 500 <= leaves[0][1] and leaves[0][1] - leaves[0][0] < 8
    assert ranges.rows_in_fetched(nodes, rows).where("block_num = 500").count() == 0


def test_empty_ranges(spark):
    none = spark.createDataFrame([], "block_num long")
    nodes = ranges.bisect(ranges.chunk_ranges(none, 10), spark.createDataFrame([], CALLS))
    assert nodes.count() == 0 and ranges.counters(nodes).first()["total_calls"] == 0
    assert ranges.rows_in_fetched(nodes, spark.createDataFrame([(1,)], "block_num long")).count() == 0
    with pytest.raises(ValueError):
        ranges.bisect(nodes, nodes, min_blocks=0)
