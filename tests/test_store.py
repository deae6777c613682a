"""What readers see while a store changes, and which files a change writes."""

import pytest

from linkweave.schemas import TABLES
from linkweave.sources.store import Store

N = 40
ADDRESSES = [f"0x{n:040d}" for n in range(N)]


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db", buckets=8)
    rows = [(a, kind, "k", 2, "old", 0, None) for a in ADDRESSES for kind in ("safe_owner", "funded_by")]
    s.replace("evidence", spark.createDataFrame(rows, TABLES["evidence"]))
    return s


def _one(spark, address, source="new", kind="safe_owner"):
    return spark.createDataFrame([(address, kind, "k", 2, source, 0, None)], TABLES["evidence"]), spark.createDataFrame([(address,)], "address string")


def test_one_address_rewrites_one_bucket(spark, store):
    before = store.manifest()["tables"]["evidence"]
    store.replace_evidence(*_one(spark, ADDRESSES[3]), ("safe_owner",))
    after = store.manifest()["tables"]["evidence"]
    changed = {p for p in before if before[p] != after[p]}
    assert len(changed) == 1 and changed.pop().startswith("kind=safe_owner/bucket=")
    rows = {(r["address"], r["kind"]): r["source"] for r in store.read("evidence").collect()}
    assert len(rows) == 2 * N and {k for k, v in rows.items() if v == "new"} == {(ADDRESSES[3], "safe_owner")}
    assert store.read("evidence").where("kind = 'safe_owner'").count() == N


def test_a_scope_without_new_rows_is_emptied(spark, store):
    store.replace_evidence(store.read("evidence").where("false"), spark.createDataFrame([(a,) for a in ADDRESSES], "address string"), ("safe_owner", "did_controller"))
    assert {r["kind"] for r in store.read("evidence").collect()} == {"funded_by"}
    assert all(p.startswith("kind=funded_by") for p in store.manifest()["tables"]["evidence"])


def test_readers_see_the_old_table_or_the_new(spark, store):
    """A frame read before a change stays readable through it, and others see nothing until the end."""
    other = Store(spark, store.folder, buckets=8)
    held = other.read("evidence")
    with store.transaction():
        store.replace_evidence(*_one(spark, ADDRESSES[0]), ("safe_owner",))
        store.append("run_inputs", spark.createDataFrame([("r", "t", "f", "s", None)], TABLES["run_inputs"]))
        assert store.read("evidence").where("source = 'new'").count() == 1
        assert other.read("evidence").where("source = 'new'").count() == 0 and not other.exists("run_inputs")
    assert held.where("source = 'old'").count() == 2 * N
    assert other.read("evidence").where("source = 'new'").count() == 1 and other.read("run_inputs").count() == 1


def test_a_failed_transaction_leaves_no_trace(spark, store, tmp_path):
    files, manifest = {str(p) for p in tmp_path.rglob("*")}, store.manifest()
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.replace_evidence(*_one(spark, ADDRESSES[0]), ("safe_owner",))
        store.append("seeds", spark.createDataFrame([("a", 1, None)], TABLES["seeds"]))
        assert store.once("s", 0)
        raise ZeroDivisionError
    assert store.manifest() == manifest and not store.exists("seeds") and manifest["batches"] == {}
    assert {str(p) for p in tmp_path.rglob("*.parquet")} == {f for f in files if f.endswith(".parquet")}


def test_old_files_go_and_a_second_writer_fails(spark, store, tmp_path):
    for n in range(4):
        store.replace_evidence(*_one(spark, ADDRESSES[1], f"s{n}"), ("safe_owner",))
    assert len(list((tmp_path / "db" / "_manifest").glob("0*.json"))) == 2
    versions = {v for parts in store.manifest()["tables"]["evidence"].values() for v in parts}
    live = {p.parent.parent.parent.name for p in (tmp_path / "db" / "evidence").rglob("*.parquet")}
    assert versions <= live and len(live) <= len(versions) + 1
    other = Store(spark, store.folder)
    with pytest.raises(RuntimeError, match="first"), store.transaction():
        store.append("seeds", spark.createDataFrame([("a", 1, None)], TABLES["seeds"]))
        other.append("seeds", spark.createDataFrame([("b", 1, None)], TABLES["seeds"]))
    assert [r["address"] for r in store.read("seeds").collect()] == ["b"]


def test_appends_compact_and_batches_count_once(spark, store):
    for n in range(3):
        with store.transaction():
            if store.once("stream", n % 2):
                store.append("seeds", spark.createDataFrame([(f"a{n}", n, None)], TABLES["seeds"]))
    assert sorted(r["address"] for r in store.read("seeds").collect()) == ["a0", "a1"]
    store.compact("seeds")
    assert store.read("seeds").count() == 2 and len(store.manifest()["tables"]["seeds"][""]) == 1
    assert store.append("own", spark.createDataFrame([(1,)], "x int")) == 1 and store.read("own").columns == ["x"]
    with pytest.raises(KeyError):
        store.read("nothing")
