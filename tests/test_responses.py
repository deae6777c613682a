"""Landed responses as a data source, against the parser of whole files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringContains

from linkweave.sources import landed, responses


def _land(folder, name, blocks, extra=()):
    rows = [{"from": f"0xF{b}", "to": "0xT", "value": 1.5 if b % 2 else None, "blockNum": hex(b), "hash": f"0xH{b}", "asset": "ETH"} for b in blocks]
    (folder / name).write_text(json.dumps({"transfers": [*rows, *extra]}))


@pytest.fixture
def folder(spark, tmp_path):
    responses.register(spark)
    where = tmp_path / "in"
    where.mkdir()
    _land(where, "000-0-99.json", range(0, 100, 7))
    _land(where, "001-100-199.json", range(100, 200, 3), [{"from": "0xA", "to": "0xB", "blockNum": "zz", "value": "12", "hash": None}])
    _land(where, "002-200-299.json", range(200, 300))
    _land(where, "003-late.json", [5, 150, 250])
    (where / "004-300-399.json").write_text("not json")
    (where / "005-300-399.json").write_text('{"transfers": null}')
    (where / "note.txt").write_text("no response")
    return where


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_rows_are_the_parsers(spark, folder):
    got = spark.read.format(responses.FORMAT).load(str(folder))
    want = landed.parse_transfers(spark.read.text([str(f) for f in folder.glob("*.json")], wholetext=True))
    assert got.columns == want.columns and _rows(got) == _rows(want)
    assert got.rdd.getNumPartitions() == 6
    assert _rows(spark.read.format(responses.FORMAT).load(f"file://{folder}")) == _rows(got)


def test_windows_prune_partitions(spark, folder):
    read = lambda: spark.read.format(responses.FORMAT).load(str(folder))
    for where, n in (("block_num between 120 and 180", 2), ("block_num = 250", 2), ("block_num in (10, 90)", 2), ("block_num >= 400", 1), ("block_num > 199 and block_num < 300", 2), ("block_num < 100 and asset = 'ETH'", 2)):
        kept = read().where(where)
        assert kept.rdd.getNumPartitions() == n, where
        assert _rows(kept) == _rows(spark.createDataFrame(read().collect(), read().schema).where(where))
    block = ("block_num",)
    reader = responses.BatchReader(str(folder))
    given = [GreaterThan(block, 99), LessThanOrEqual(block, 500), StringContains(("asset",), "E"), EqualTo(("value",), "1")]
    assert list(reader.pushFilters(given)) == given and (reader.least, reader.most) == (100, 500)
    list(reader.pushFilters([GreaterThanOrEqual(block, 120), LessThan(block, 131), In(block, (125, 140))]))
    assert [p.path.rsplit("/", 1)[1] for p in reader.partitions()] == ["001-100-199.json", "003-late.json"]


def test_a_transfer_without_an_end_raises(spark, folder):
    _land(folder, "009-0-9.json", [], [{"from": "0xA"}])
    with pytest.raises(PySparkException, match="without to"):
        spark.read.format(responses.FORMAT).load(str(folder)).collect()


def test_a_stream_takes_each_file_once(spark, folder, tmp_path):
    stream = spark.readStream.format(responses.FORMAT).option("maxFilesPerTrigger", "2").load(str(folder))

    def run():
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()

    run()
    _land(folder, "010-300-399.json", range(300, 310))
    run()
    assert _rows(spark.read.parquet(f"{tmp_path}/out")) == _rows(spark.read.format(responses.FORMAT).load(str(folder)))
    _land(folder, "007-0-9.json", [1])
    _land(folder, "011-0-9.json", [2])
    with pytest.raises(PySparkException, match="order of landing"):
        run()


def test_empty_folder(spark, tmp_path):
    responses.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format(responses.FORMAT).load(f"{tmp_path}/none").count() == 0
