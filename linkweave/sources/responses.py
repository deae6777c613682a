"""Landed transfer responses as a data source: ``spark.read.format("landed_transfers").load(folder)``.

Each response is one JSON file ``{"transfers": [...]}`` and one partition, parsed where it is
read into Arrow batches of the table transfers. A file may carry the block window that it was
asked for in its name, as ``anything-FROM-TO.json``; filters on ``block_num`` are pushed to the
source, which then plans only the files whose window meets them. They are still applied to the
rows, so a name promises nothing but that its rows lie in its window.

As a stream, the source takes files in the order of their names, up to ``maxFilesPerTrigger`` a
batch; the offset is the last name taken. So names must sort in the order in which files land
(a counter or a time in front); one that lands behind the offset fails the stream instead of
being lost. Taken files must stay, as the offset counts them.

Files are opened through PyArrow's file systems (``file``, ``hdfs``, ``s3``, ...) by the
executors, so the folder must be one that all of them can reach.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from linkweave.schemas import TABLES

FORMAT = "landed_transfers"
#: Rows of an Arrow batch.
BATCH = 4096
_WINDOW = re.compile(r"-(\d+)-(\d+)\.json$")
_HEX = re.compile(r"0x[0-9a-fA-F]{1,15}")
_SCHEMA = pa.schema([("from_addr", pa.string()), ("to_addr", pa.string()), ("value", pa.string()), ("block_num", pa.int64()), ("tx_hash", pa.string()), ("asset", pa.string())])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedTransfers)


def _text(value: object) -> str | None:
    """A JSON value as text; numbers keep their digits."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


def transfer_rows(body: str) -> Iterator[tuple]:
    """Rows of the table transfers in one response. A body that is no such response has none; a transfer without an end raises."""
    try:
        found = json.loads(body, parse_int=str, parse_float=str)
    except ValueError:
        return
    for t in found.get("transfers") or [] if isinstance(found, dict) else []:
        if not isinstance(t, dict):
            continue
        ends = [_text(t.get(name)) for name in ("from", "to")]
        for name, end in zip(("from", "to"), ends, strict=True):
            if end is None:
                raise ValueError(f"transfer without {name}")
        block, digest = _text(t.get("blockNum")), _text(t.get("hash"))
        yield ends[0].lower(), ends[1].lower(), _text(t.get("value")), int(block, 16) if block and _HEX.fullmatch(block) else None, digest and digest.lower(), _text(t.get("asset"))


@dataclass
class Response(InputPartition):
    path: str


def _files(folder: str) -> list[str]:
    """Names of the folder's responses, in order."""
    system, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    return sorted(f.base_name for f in system.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and f.base_name.endswith(".json"))


def _read(path: str) -> Iterator[pa.RecordBatch]:
    system, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with system.open_input_stream(place) as file:
        body = file.read().decode()
    rows: list[tuple] = []
    for row in transfer_rows(body):
        rows.append(row)
        if len(rows) == BATCH:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


class LandedTransfers(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return TABLES["transfers"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options["path"].rstrip("/"))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(self.options["path"].rstrip("/"), int(self.options.get("maxFilesPerTrigger", "1000")))


class BatchReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.least, self.most = float("-inf"), float("inf")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Note the blocks that filters leave; Spark applies all of them to the rows too."""
        for f in filters:
            if getattr(f, "attribute", None) == ("block_num",) and getattr(f, "value", None) is not None:
                v = f.value
                match f:
                    case EqualTo():
                        self._within(v, v)
                    case In() if v:
                        self._within(min(v), max(v))
                    case GreaterThan():
                        self._within(v + 1, self.most)
                    case GreaterThanOrEqual():
                        self._within(v, self.most)
                    case LessThan():
                        self._within(self.least, v - 1)
                    case LessThanOrEqual():
                        self._within(self.least, v)
            yield f

    def _within(self, least: float, most: float) -> None:
        self.least, self.most = max(self.least, least), min(self.most, most)

    def partitions(self) -> list[Response]:
        kept = []
        for name in _files(self.folder):
            window = _WINDOW.search(name)
            if window is None or (int(window[1]) <= self.most and int(window[2]) >= self.least):
                kept.append(Response(f"{self.folder}/{name}"))
        return kept

    def read(self, partition: Response | None) -> Iterator[pa.RecordBatch]:
        # no partition at all is planned as one without a response
        return _read(partition.path) if partition is not None else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most = folder, most
        self.last = ""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": "", "taken": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        names = _files(self.folder)
        new = [n for n in names if n > self.last][: self.most]
        if new:
            self.last = new[-1]
        return {"after": self.last, "taken": sum(n <= self.last for n in names)}

    def partitions(self, start: dict, end: dict) -> list[Response]:
        self.last = max(self.last, end["after"])
        names = _files(self.folder)
        if sum(n <= start["after"] for n in names) > start["taken"]:
            raise ValueError(f"a response landed before {start['after']}; names must sort in the order of landing")
        return [Response(f"{self.folder}/{n}") for n in names if start["after"] < n <= end["after"]]

    def read(self, partition: Response) -> Iterator[pa.RecordBatch]:
        return _read(partition.path)

    def commit(self, end: dict) -> None:
        self.last = max(self.last, end["after"])
