"""Sinks with set semantics, and a store of Parquet tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkweave.schemas import TABLES

TRANSFER_KEY = ("tx_hash", "from_addr", "to_addr", "asset", "value")
EVIDENCE_KEY = ("address", "kind", "key", "source")


def new_transfers(incoming: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows to insert: one of each set of equal keys that is not stored yet.

    A key with a null is never equal to another, so such rows are all inserted and stay out of
    the shuffle that removes duplicates.
    """
    whole = F.col("tx_hash").isNotNull() & F.col("asset").isNotNull() & F.col("value").isNotNull()
    keyed = incoming.where(whole).groupBy(*TRANSFER_KEY).agg(F.min("block_num").alias("block_num")).select(*incoming.columns)
    if existing is not None:
        keyed = keyed.join(existing.where(whole).select(*TRANSFER_KEY), list(TRANSFER_KEY), "left_anti").select(*incoming.columns)
    return keyed.unionByName(incoming.where(~whole))


def upsert_addresses(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per address with the least known first block; a stored label stays."""
    rows = existing.withColumn("old", F.lit(0)).unionByName(incoming.withColumn("old", F.lit(1)), allowMissingColumns=True)
    return rows.groupBy("address").agg(F.min("first_seen_block").alias("first_seen_block"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("old"))).alias("label"))


def last_write_wins(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the largest sequence of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).drop(sequence)


def replace_scope(existing: DataFrame, new: DataFrame, addresses: DataFrame, kind: str) -> DataFrame:
    """``existing`` with its (address in scope, kind) rows replaced by those of ``new``."""
    scope = addresses.select(F.col("address")).distinct()
    kept = existing.where(F.col("kind") != kind).unionByName(existing.where(F.col("kind") == kind).join(scope, "address", "left_anti").select(*existing.columns))
    return kept.unionByName(new.where(F.col("kind") == kind).join(scope, "address", "left_semi").select(*existing.columns))


def insert_or_ignore_evidence(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows of ``incoming`` with a key that is neither stored nor taken by an earlier equal row.

    Of rows with one key the one with the least block, then payload, is the first.
    """
    rest = [c for c in incoming.columns if c not in EVIDENCE_KEY]
    order = F.struct("observed_block", F.coalesce("payload_json", F.lit("")), "strength")
    one = incoming.groupBy(*EVIDENCE_KEY).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*EVIDENCE_KEY, *[F.col(f"r.{c}").alias(c) for c in rest])
    return one.join(existing.select(*EVIDENCE_KEY), list(EVIDENCE_KEY), "left_anti").select(*incoming.columns)


class Store:
    """Parquet tables in one folder of any Hadoop file system, published together.

    Data files lie under ``table/version=.../`` and are never changed. What a reader sees is one
    manifest, which names the versions of each table; publishing is the rename of a complete new
    manifest, so a reader sees all of a change or nothing of it, and never a missing table.
    Evidence is further split by kind and a bucket of its address, and the manifest names the
    versions of each part: replacing the evidence of some addresses rewrites their buckets only.

    Changes inside :meth:`transaction` are published together, and leave nothing where it fails.
    There is one writer at a time; another one that publishes first makes this one fail. Files
    that neither of the last two manifests names are deleted when a manifest is published, so a
    reader may go on through one publication.
    """

    PARTITIONS = {"entity_clusters": ["cluster_run_id"], "suspected_service_keys": ["cluster_run_id"], "cluster_lineage": ["current_run_id"], "cluster_metrics": ["run_id"]}
    #: Tables whose parts are replaced one by one: the columns of a part, the last one a bucket of the address.
    SCOPED = {"evidence": ("kind", "bucket")}

    def __init__(self, spark: SparkSession, folder: str, *, buckets: int = 32) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._open: dict | None = None
        self._made: list[str] = []

    # files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # manifests

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/_manifest") if n.endswith(".json"))

    def _load(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/_manifest/{version:012d}.json", wholetext=True).first()["value"])

    def manifest(self) -> dict:
        """What is published, or staged in the open transaction: {"version", "tables": {table: {part: versions}}, "batches"}."""
        if self._open is not None:
            return self._open
        versions = self._versions()
        return self._load(versions[-1]) if versions else {"version": 0, "tables": {}, "batches": {}}

    @staticmethod
    def _folders(manifest: dict) -> set[str]:
        return {f"{table}/{version}/{part}".rstrip("/") for table, parts in manifest["tables"].items() for part, versions in parts.items() for version in versions}

    def _publish(self, manifest: dict) -> None:
        versions = self._versions()
        if (versions[-1] if versions else 0) != manifest["version"]:
            raise RuntimeError("another writer published first")
        made = manifest | {"version": manifest["version"] + 1}
        target = f"{self.folder}/_manifest/{made['version']:012d}.json"
        fs, fresh = self._fs(f"{self.folder}/_manifest/.{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(json.dumps(made, sort_keys=True).encode())
        out.close()
        if not fs.rename(fresh, self._fs(target)[1]):
            raise RuntimeError("another writer published first")
        old = versions[:-1]
        kept = self._folders(made) | (self._folders(self._load(versions[-1])) if versions else set())
        for version in old:
            for folder in self._folders(self._load(version)) - kept:
                self.remove(f"{self.folder}/{folder}")
            self.remove(f"{self.folder}/_manifest/{version:012d}.json")

    @contextmanager
    def transaction(self) -> Iterator[Store]:
        """Changes made inside are seen by this store at once, and by others when it ends; a failure leaves no trace.

        Inside an open transaction it is a part of that one.
        """
        if self._open is not None:
            yield self
            return
        self._open, self._made = self.manifest(), []
        try:
            yield self
            self._publish(self._open)
        except BaseException:
            for path in self._made:
                self.remove(path)
            raise
        finally:
            self._open, self._made = None, []

    # tables

    def exists(self, table: str) -> bool:
        return table in self.manifest()["tables"]

    def _paths(self, table: str, parts: list[str] | None = None) -> list[str]:
        entry = self.manifest()["tables"].get(table, {})
        return [f"{self.folder}/{table}/{v}/{p}".rstrip("/") for p in (entry if parts is None else parts) for v in entry.get(p, [])]

    def _read(self, table: str, paths: list[str]) -> DataFrame:
        known = TABLES.get(table)
        if not paths:
            if known is None:
                raise KeyError(table)
            return self.spark.createDataFrame([], known)
        reader = self.spark.read if known is None else self.spark.read.schema(known)
        rows = reader.option("basePath", f"{self.folder}/{table}").parquet(*paths)
        return rows.drop("version", "bucket") if known is None else rows.select(*known.names)

    def read(self, table: str) -> DataFrame:
        """The table as it is published now (or staged here), or no rows of its schema."""
        return self._read(table, self._paths(table))

    def bucket(self, address: str = "address") -> Column:
        return F.pmod(F.xxhash64(address), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame) -> tuple[str, list[str]]:
        """A new version of some rows and the parts in it; only a manifest makes it part of the table."""
        version = f"version={uuid.uuid4().hex}"
        path = f"{self.folder}/{table}/{version}"
        self._made.append(path)
        by = list(self.SCOPED.get(table, self.PARTITIONS.get(table, [])))
        if table in self.SCOPED:
            # a part's rows meet before they are written, so that a part is a few files
            rows = rows.withColumn("bucket", self.bucket()).repartition(*by)
        rows.write.partitionBy(*by).parquet(path)
        if table not in self.SCOPED:
            return version, [""]
        return version, [f"{a}/{b}" for a in self._names(path) if "=" in a for b in self._names(f"{path}/{a}")]

    def append(self, table: str, rows: DataFrame) -> int:
        """Number of rows appended, counted as they are written."""
        with self.transaction():
            seen = Observation()
            version, parts = self._write(table, rows.observe(seen, F.count(F.lit(1)).alias("n")))
            entry = self._open["tables"].setdefault(table, {})
            for part in parts:
                entry[part] = [*entry.get(part, []), version]
            return seen.get["n"]

    def replace(self, table: str, rows: DataFrame) -> None:
        """``rows`` as the whole table; they may be derived from what it was."""
        with self.transaction():
            version, parts = self._write(table, rows)
            self._open["tables"][table] = {part: [version] for part in parts}

    def compact(self, table: str) -> None:
        """The table's appended versions as one."""
        self.replace(table, self.read(table))

    def insert_transfers(self, incoming: DataFrame) -> int:
        return self.append("transfers", new_transfers(incoming, self.read("transfers") if self.exists("transfers") else None))

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        both = self.read(table).withColumn("__seq", F.lit(0)).unionByName(rows.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
        self.replace(table, last_write_wins(both, keys, "__seq"))

    def replace_evidence(self, new: DataFrame, addresses: DataFrame, kinds: tuple[str, ...]) -> None:
        """Rows of ``kinds`` and of ``addresses`` replaced by those of ``new``: only the buckets that hold such an address are rewritten.

        The buckets come to the driver; there are :attr:`buckets` of them at most.
        """
        with self.transaction():
            touched = [r["b"] for r in addresses.select(self.bucket().alias("b")).distinct().collect()]
            parts = [f"kind={kind}/bucket={b}" for kind in kinds for b in touched]
            rows = self._read("evidence", self._paths("evidence", parts))
            for kind in kinds:
                rows = replace_scope(rows, new, addresses, kind)
            version, made = self._write("evidence", rows)
            kept = {p: v for p, v in self._open["tables"].get("evidence", {}).items() if p not in parts}
            self._open["tables"]["evidence"] = kept | {part: [version] for part in made}

    # streams

    def once(self, stream: str, batch: int) -> bool:
        """Whether a stream's batch is new here; noted in the open transaction, so it is stored with what the batch writes."""
        batches = self.manifest()["batches"]
        if batch <= batches.get(stream, -1):
            return False
        batches[stream] = batch
        return True
