"""Streams against the batch result: incremental clusters, participants."""

import random

import pytest

from linkweave.operators import cohort, linking
from linkweave.schemas import LEGACY, TABLES, MergePolicy
from linkweave.sources.store import Store
from linkweave.streaming.linking import IncrementalLinks
from linkweave.streaming.participants import STATE_STORE, participant_counters

TIGHT = MergePolicy(conservative=True, fan_out_cap=6, funded_fan_out_cap=5)


def _clusters(df):
    return {r["address"]: r["cluster_id"] for r in df.collect()}


def _full(spark, claims, policy, least):
    seen, once = set(), []
    for c in claims:
        if (key := (*c[:3], c[4])) not in seen:
            seen.add(key)
            once.append(c)
    e = spark.createDataFrame(once, TABLES["evidence"])
    return _clusters(linking.clusters(e.select("address").distinct(), e, policy, least))


@pytest.mark.parametrize(("policy", "least"), [(TIGHT, 1), (LEGACY, 2)])
def test_clusters_after_each_batch(spark, tmp_path, policy, least):
    """Five batches: new pairs, joined clusters, repeats, and in the fourth a key that crosses its cap and takes a cluster apart."""
    dice = random.Random(least)
    links = IncrementalLinks(Store(spark, f"file://{tmp_path}/db"), policy, least)
    claims, sizes = [], []
    for number in range(5):
        batch = []
        for _ in range(14):
            kind = dice.choice(["funded_by", "safe_owner", "ens_handle"])
            batch.append((f"a{dice.randrange(24):02d}", kind, f"{kind[0]}{dice.randrange(9)}", 2, f"s{dice.randrange(2)}", dice.randrange(3), None))
        hub = {0: range(2), 1: range(2, 4), 2: range(4, 5), 3: range(5, 9)}.get(number, range(0))
        batch += [(f"h{n}", "safe_owner", "hub", 2, "s", 0, None) for n in hub]
        batch += claims[:3]
        changed = links.update(spark.createDataFrame(batch, TABLES["evidence"]), number)
        claims += batch
        want = _full(spark, claims, policy, least)
        assert _clusters(links.clusters()) == want
        sizes.append((changed, len(want)))
        if policy is TIGHT:
            together = len({want[f"h{n}"] for n in range(5) if f"h{n}" in want})
            assert (together == 1) == (number < 3)
    assert all(c < n for c, n in sizes[1:3])
    assert links.update(spark.createDataFrame([("zz", "safe_owner", "q", 2, "s", 0, None)], TABLES["evidence"]), 4) == 0
    links.compact()
    assert _clusters(links.clusters()) == want and links._log().count() == len(want)


def test_clusters_of_a_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    links = IncrementalLinks(store, LEGACY, 1)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(TABLES["evidence"]).parquet(f"{tmp_path}/in")
    for rows in ([("a", "did_controller", "k", 3, "s", 0, None)], [("b", "did_controller", "k", 3, "s", 0, None)], []):
        spark.createDataFrame(rows, TABLES["evidence"]).write.mode("append").parquet(f"{tmp_path}/in")
        links.run(stream, f"{tmp_path}/cp").awaitTermination(120)
    assert _clusters(links.clusters()) == {"a": "a", "b": "a"}


def test_participants_as_the_batch_counts_them(spark, tmp_path):
    """Late blocks, null blocks, null ends, repeats, and a busy address whose cap is crossed once."""
    dice = random.Random(1)
    folder, events = f"{tmp_path}/in", []
    (tmp_path / "in").mkdir()
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    stream = participant_counters(spark.readStream.schema(TABLES["transfers"]).parquet(folder), cap=60)
    for number in range(3):
        rows = [(dice.choice(["hub", f"x{dice.randrange(9)}", None]), dice.choice([None, f"x{dice.randrange(9)}"]), "1", dice.choice([None, 900 - 300 * number + dice.randrange(50)]), None, "E") for _ in range(120)]
        rows = [(f or "0x0", t or "0x0", *r) for f, t, *r in rows[:60]] + rows[60:]
        spark.createDataFrame(rows, "from_addr string, to_addr string, value string, block_num long, tx_hash string, asset string").write.mode("append").parquet(folder)

        def take(batch, n):
            events.extend(tuple(r) for r in batch.collect())

        stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(180)
    last = {a: (first, n) for a, first, n, _ in events}
    want = {r["address"]: (r["first_block"], r["n"]) for r in cohort.participants(spark.read.parquet(folder)).collect()}
    assert last == want and None in want
    crossed = [a for a, _, _, c in events if c]
    assert sorted(map(str, crossed)) == sorted(str(a) for a, (_, n) in want.items() if n >= 60)
