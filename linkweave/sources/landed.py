"""Readers and parsers of landed responses, seed files, gold files and event logs."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.scalar import abi_address, blank_to_null, hex_to_long, is_address, normalize_address, topic_address
from linkweave.schemas import GOVERNORS, TABLES, TOKEN, TOPIC_PROPOSAL_CREATED, TOPIC_TRANSFER, TOPIC_VOTE_CAST, TOPIC_VOTE_CAST_PARAMS, LinkageParams

_TRANSFER = "struct<`from`:string,`to`:string,value:string,blockNum:string,hash:string,asset:string>"


def parse_transfers(responses: DataFrame, column: str = "value") -> DataFrame:
    """Rows of the table transfers from landed JSON responses ``{"transfers": [...]}``.

    Addresses and hashes in lower case, amounts as text, a bad block number as null; a transfer
    without a sender or recipient raises.
    """
    each = responses.select(F.explode(F.from_json(column, f"struct<transfers:array<{_TRANSFER}>>")["transfers"]).alias("t"))
    need = lambda name: F.when(F.col(f"t.{name}").isNull(), F.raise_error(F.lit(f"transfer without {name}")).cast("string")).otherwise(F.lower(f"t.{name}"))
    return each.select(need("from").alias("from_addr"), need("to").alias("to_addr"), F.col("t.value").alias("value"), hex_to_long(F.col("t.blockNum")).alias("block_num"), F.lower("t.hash").alias("tx_hash"), F.col("t.asset").alias("asset"))


def in_window(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of known blocks within the window; an unknown block is outside."""
    return rows.where(F.col("block_num").between(start, end))


def is_contract(code: Column) -> Column:
    """Whether landed bytecode is more than ``0x``."""
    return F.length(code) > 2


def parse_ens(responses: DataFrame, column: str = "value") -> DataFrame:
    """Rows of ens_records from landed JSON; a missing body gives none, blanks are null."""
    body = F.from_json(column, "struct<address:string,name:string,twitter:string,github:string,telegram:string>")
    rows = responses.select(body.alias("b")).where("b.address is not null")
    return rows.select(F.lower("b.address").alias("address"), *[blank_to_null(F.col(f"b.{c}")).alias(c) for c in ("name", "twitter", "github", "telegram")])


def parse_safes(responses: DataFrame, column: str = "value") -> DataFrame:
    """(safe_address, owner_address, threshold) from landed JSON ``{"address", "threshold", "owners"}``."""
    body = F.from_json(column, "struct<address:string,threshold:bigint,owners:array<string>>")
    return responses.select(body.alias("b")).select(F.lower("b.address").alias("safe_address"), F.explode("b.owners").alias("o"), "b.threshold").select("safe_address", F.lower("o").alias("owner_address"), "threshold")


def classify_owners(owners: DataFrame, codes: DataFrame, source: str = "safe-tx-service") -> DataFrame:
    """Rows of safe_owners: an owner with code is a Safe, and so, to be careful, is one whose probe failed."""
    probed = codes.select(F.lower("address").alias("owner_address"), is_contract(F.col("code")).alias("contract"))
    joined = owners.join(probed, "owner_address", "left")
    observed = F.col("observed_block") if "observed_block" in owners.columns else F.lit(None).cast("bigint")
    return joined.select("safe_address", "owner_address", F.coalesce("contract", F.lit(True)).alias("owner_is_safe"), "threshold", observed.alias("observed_block"), F.lit(source).alias("source"))


def owner_summary(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count("*").alias("owners"), F.count_if("owner_is_safe").alias("safe_owners"), F.count_if(~F.col("owner_is_safe")).alias("eoa_owners"))


def read_seeds(spark: SparkSession, path: str, role: str) -> DataFrame:
    """(address, first_seen_block, role) of a CSV with a header; a bad block or address raises."""
    rows = spark.read.schema("address string, first_seen_block bigint, seed_type string").csv(path, header=True, mode="FAILFAST", enforceSchema=True)
    block = F.when(F.col("first_seen_block").isNull(), F.raise_error(F.lit("seed without a block")).cast("bigint")).otherwise(F.col("first_seen_block"))
    return rows.select(normalize_address(F.col("address")).alias("address"), block.alias("first_seen_block"), F.lit(role).alias("role"))


def gold_pairs(rows: DataFrame) -> DataFrame:
    """Trimmed, checked pairs in canonical order without pairs of one address."""
    a, b = normalize_address(F.col("address_a")), normalize_address(F.col("address_b"))
    label = F.lower(F.trim("label"))
    label = F.when(label.isin("same_control", "different_control", "uncertain"), label).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))).cast("string"))
    pairs = rows.select(a.alias("a"), b.alias("b"), label.alias("label"), *[c for c in rows.columns if c not in ("address_a", "address_b", "label")])
    return pairs.where("a <> b").select(F.least("a", "b").alias("address_a"), F.greatest("a", "b").alias("address_b"), *[c for c in pairs.columns if c not in ("a", "b")])


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return gold_pairs(spark.read.schema(TABLES["gold"]).csv(path, header=True, enforceSchema=True))


#: Column names that a flexible gold file may use.
_GOLD_NAMES = {"address_a": ("address_a", "addr_a", "a", "source", "left"), "address_b": ("address_b", "addr_b", "b", "target", "right"), "label": ("label", "gold_label", "gold", "expected")}


def read_flexible_gold(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_gold` for other column names; of repeated pairs the last row of the file wins."""
    rows = spark.read.csv(path, header=True)
    by_lower = {c.strip().lower(): c for c in rows.columns}
    found = {k: next((by_lower[n] for n in names if n in by_lower), None) for k, names in _GOLD_NAMES.items()}
    if missing := [k for k, v in found.items() if v is None]:
        raise ValueError(f"no column for {', '.join(missing)}")
    # a gold file is hand-made and small; its rows have one file order
    numbered = rows.select(*[F.col(f"`{v}`").alias(k) for k, v in found.items()], F.monotonically_increasing_id().alias("row"))
    pairs = numbered.where(is_address(F.col("address_a")) & is_address(F.col("address_b"))).select(F.lower(F.trim("address_a")).alias("x"), F.lower(F.trim("address_b")).alias("y"), F.trim("label").alias("label"), "row")
    return pairs.groupBy(F.least("x", "y").alias("address_a"), F.greatest("x", "y").alias("address_b")).agg(F.max_by("label", "row").alias("label"))


def read_denylist(spark: SparkSession, path: str | None) -> DataFrame:
    """Checked addresses of a text file, less blank lines and comments; no path, no rows."""
    if path is None:
        return spark.createDataFrame([], "address string")
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and line not like '#%'")
    return lines.select(normalize_address(F.col("line")).alias("address")).distinct()


def read_whole_text(spark: SparkSession, path: str) -> str:
    """A small configuration file, through Spark's file systems."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    if not rows:
        raise FileNotFoundError(path)
    return rows[0]["value"]


def read_snapshot_hash(spark: SparkSession, path: str, field_name: str = "snapshot_hash") -> str:
    value = spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.{field_name}").alias("h")).first()
    if value is None or not value["h"]:
        raise ValueError(f"no {field_name} in {path}")
    return value["h"]


def read_params(spark: SparkSession, path: str | None = None) -> LinkageParams:
    return LinkageParams() if path is None else LinkageParams.from_json(read_whole_text(spark, path))


def decode_logs(logs: DataFrame, topics: dict[str, str] | None = None) -> DataFrame:
    """(kind, address, block_num) of votes and proposals in (block_hex, topic0, topic1, data).

    A vote's address is its first topic's, a proposal's is in the second word of its data. Where
    the logs name their contract, only the governors' count.
    """
    if "contract" in logs.columns:
        logs = logs.where(F.lower("contract").isin(*GOVERNORS))
    names = topics or {TOPIC_VOTE_CAST: "vote", TOPIC_VOTE_CAST_PARAMS: "vote", TOPIC_PROPOSAL_CREATED: "proposal"}
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    kind = F.element_at(known, F.lower("topic0") if topics is None else F.col("topic0"))
    address = F.when(F.col("kind") == "vote", topic_address(F.col("topic1"))).otherwise(abi_address(F.col("data"), 1))
    decoded = logs.withColumn("kind", kind).where("kind is not null")
    return decoded.select("kind", address.alias("address"), hex_to_long(F.col("block_hex")).alias("block_num")).where("address is not null")


def decode_transfer_logs(logs: DataFrame) -> DataFrame:
    """(from_addr, to_addr, block_num) of transfer logs with three topics, of the token alone where the contract is named."""
    if "contract" in logs.columns:
        logs = logs.where(F.lower("contract") == TOKEN)
    own = logs.where((F.lower("topic0") == TOPIC_TRANSFER) & F.col("topic1").isNotNull() & F.col("topic2").isNotNull())
    return own.select(topic_address(F.col("topic1")).alias("from_addr"), topic_address(F.col("topic2")).alias("to_addr"), hex_to_long(F.col("block_hex")).alias("block_num"))


@dataclass(frozen=True)
class Config:
    """Settings of a run from the environment's LINKWEAVE_* variables."""

    storage: str = "linkweave-data"
    chain: str = "mainnet"
    networks: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        names = tuple(n.strip() for n in env.get("LINKWEAVE_NETWORKS", "").split(",") if n.strip())
        return cls(env.get("LINKWEAVE_STORAGE", cls.storage), env.get("LINKWEAVE_CHAIN", cls.chain).strip().lower(), names)
