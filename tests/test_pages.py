"""Bounded fetches against a page-by-page loop."""

import random

import pytest

from linkweave.schemas import TABLES
from linkweave.sources import pages

WINDOW = (10, 90)


def _fetch(rows, seed, leg, caps, room, seen, peers):
    """One leg as a client would fetch it: (kept, calls, pages, row, page, peer), by pages."""
    mine = sorted((r for r in rows if r[1 if leg == 0 else 0] == seed), key=lambda r: tuple((v is not None, v if v is not None else "") for v in (r[3], r[4], r[0], r[1], r[5], r[2])))
    out, at, calls, asked, flags = [], 0, 0, 0, [False] * 3
    while True:
        if len(out) >= room:
            flags[0] = True
            break
        asked += 1
        if asked > caps.max_pages:
            flags[1] = True
            break
        calls += 1
        for r in mine[at : at + caps.page_size]:
            key = tuple(r[i] or "" for i in (4, 0, 1, 5, 2))
            if key not in seen:
                seen.add(key)
                peers.add(r[0 if leg == 0 else 1])
                out.append(r)
            if len(out) >= room:
                flags[0] = True
                break
        if caps.max_peers is not None and len(peers) >= caps.max_peers:
            flags[2] = True
            break
        at += caps.page_size
        if at >= len(mine):
            break
    return out, calls, asked, *flags


def _run(rows, seeds, caps, legs, direction=None):
    kept, fetches = [], []
    for seed in seeds:
        room, seen, peers, place = caps.max_rows, set(), set(), 0
        for leg in (0, 1) if direction is None else (direction,):
            if legs == "apart":
                seen, peers = set(), set()
                if room == 0:
                    continue
            out, *stats = _fetch(rows, seed, leg, caps, room, seen, peers)
            room -= len(out)
            fetches.append((seed, leg, len(out), *stats))
            for r in out:
                place += 1
                kept.append((seed, leg, place, *r))
    return kept, fetches


@pytest.mark.parametrize("legs", ["apart", "together"])
@pytest.mark.parametrize("caps", [pages.Caps(7, 3, 4, 3), pages.Caps(12, 2, 3, 4), pages.Caps(5, 9, None, 2), pages.Caps(1000, 30, 220, 1000), pages.Caps(6, 2, 9, 3), pages.Caps(9, 1, 2, 5)])
def test_fetches_as_a_client_pages(spark, legs, caps):
    dice = random.Random(7)
    names = [f"n{i}" for i in range(8)]
    rows = [(dice.choice(names), dice.choice(names), dice.choice(["1", None]), dice.choice([None, *range(100)]), dice.choice([None, f"t{dice.randrange(40)}"]), dice.choice(["ETH", None])) for _ in range(250)]
    rows += rows[:40]
    seeds = [*names[:5], "quiet"]
    table = spark.createDataFrame(rows, TABLES["transfers"])
    given = spark.createDataFrame([(s,) for s in seeds + seeds[:2]], "address string")
    both = [(None, {}), (None, {"start": WINDOW[0], "end": WINDOW[1]})]
    for direction, window in both[:1] if caps.max_peers != 4 else [*both[1:], (0, {}), (1, {})]:
        seen = [r for r in rows if not window or (r[3] is not None and WINDOW[0] <= r[3] <= WINDOW[1])]
        got, fetches = pages.bounded_fetch(table, given, caps, direction=direction, legs=legs, **window)
        want, stats = _run(seen, seeds, caps, legs, direction)
        assert sorted(map(repr, map(tuple, got.drop("page").collect()))) == sorted(map(repr, want))
        assert sorted(map(tuple, fetches.collect())) == sorted(stats)


def test_legs_have_their_own_addresses_and_rows(spark):
    """240 incoming rows of 240 addresses leave ten rows to the outgoing leg; the address stop falls on a page's end."""
    rows = [(f"in{n}", "me", "1", n, f"t{n}", "ETH") for n in range(240)] + [("me", f"out{n}", "1", n, f"u{n}", "ETH") for n in range(60)]
    table, seeds = spark.createDataFrame(rows, TABLES["transfers"]), spark.createDataFrame([("me",)], "address string")
    got, fetches = pages.bounded_fetch(table, seeds)
    assert {(r["direction"], r["count"]) for r in got.groupBy("direction").count().collect()} == {(0, 240), (1, 10)}
    assert [tuple(r) for r in fetches.orderBy("direction").collect()] == [("me", 0, 240, 1, 1, False, False, True), ("me", 1, 10, 1, 1, True, False, False)]
    assert tuple(pages.cap_hits(fetches).first()) == (1, 0, 1, 2, True)
    none = pages.bounded_fetch(table.where("false"), seeds)[1]
    assert tuple(pages.cap_hits(none).first()) == (0, 0, 0, 2, False)
    assert tuple(pages.cap_hits(none.where("false")).first()) == (0, 0, 0, 0, False)
    with pytest.raises(ValueError):
        pages.bounded_fetch(table, seeds, legs="both")
