"""Evidence: typed claims (address, kind, key) derived from raw facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.scalar import clean_handle
from linkweave.schemas import EXCHANGES, MEDIUM, STRONG

COLUMNS = ("address", "kind", "key", "strength", "source", "observed_block", "payload_json")


def normalize_subjects(addresses: DataFrame, column: str = "address") -> DataFrame:
    """Distinct lower-case addresses."""
    return addresses.select(F.lower(column).alias("address")).distinct()


def _rows(df: DataFrame, kind: str, strength: int) -> DataFrame:
    return df.withColumn("kind", F.lit(kind)).withColumn("strength", F.lit(strength)).select(*COLUMNS)


def first_funding(transfers: DataFrame) -> DataFrame:
    """(address, key, first_block): first block of each funder of each recipient, 0 if unknown."""
    return transfers.groupBy(F.col("to_addr").alias("address"), F.col("from_addr").alias("key")).agg(F.coalesce(F.min("block_num"), F.lit(0)).alias("observed_block"))


def extract_funded_by(transfers: DataFrame, subjects: DataFrame, *, deny: DataFrame | None = None) -> DataFrame:
    """One claim per (recipient, funder), without exchanges and the ``deny`` table's addresses.

    Filters and the semi-join run before the aggregation, so only subjects' transfers shuffle.
    """
    own = transfers.where(~F.col("from_addr").isin(*EXCHANGES))
    if deny is not None:
        own = own.join(deny.select(F.lower("address").alias("denied")), F.col("from_addr") == F.col("denied"), "left_anti")
    own = own.join(subjects.select(F.col("address").alias("subject")), F.col("to_addr") == F.col("subject"), "left_semi")
    first = first_funding(own)
    source = F.concat(F.lit("alchemy_getAssetTransfers@"), F.col("observed_block").cast("string"))
    return _rows(first.withColumn("source", source).withColumn("payload_json", F.lit(None).cast("string")), "funded_by", MEDIUM)


def extract_ens_handles(ens: DataFrame, subjects: DataFrame) -> DataFrame:
    """A claim per non-blank handle, as ``service:handle``; the name itself is never evidence."""
    own = ens.join(subjects, "address", "left_semi")
    services = ("twitter", "github", "telegram")
    each = own.select("address", "name", F.explode(F.array(*[F.struct(F.lit(s).alias("service"), F.col(s).alias("handle")) for s in services])).alias("h"))
    handle = clean_handle(F.col("h.handle"))
    rows = each.where(F.trim("h.handle") != "").select("address", F.concat("h.service", F.lit(":"), handle).alias("key"), F.lit("ens_records").alias("source"), F.lit(0).cast("bigint").alias("observed_block"), F.to_json(F.struct(F.col("name").alias("ens_name")), {"ignoreNullFields": "false"}).alias("payload_json"))
    return _rows(rows, "ens_handle", MEDIUM)


def extract_did_controllers(documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """One strong claim per (subject, other controller), from its first document by block (unknown first) and did."""
    named = documents.select(F.lower("subject_address").alias("address"), F.lower("controller").alias("key"), "did", "method", F.col("source").alias("doc_source"), "observed_block")
    own = named.where("address <> key").join(subjects, "address", "left_semi")
    order = F.struct(F.coalesce("observed_block", F.lit(-1)).alias("b"), "did", "method", "doc_source", "observed_block")
    grouped = own.groupBy("address", "key").agg(F.array_sort(F.collect_list(order)).alias("docs"))
    first = F.col("docs")[0]
    rows = grouped.select(
        "address",
        "key",
        F.concat(F.lit("did_documents:"), first["method"], F.lit(":"), first["doc_source"]).alias("source"),
        F.coalesce(first["observed_block"], F.lit(0)).alias("observed_block"),
        F.to_json(F.struct(F.transform("docs", lambda d: d["did"]).alias("dids"), F.transform("docs", lambda d: d["method"]).alias("methods"))).alias("payload_json"),
    )
    return _rows(rows, "did_controller", STRONG)


def extract_safe_owners(owners: DataFrame, subjects: DataFrame) -> DataFrame:
    """A claim per owner that is no Safe itself."""
    own = owners.where(~F.col("owner_is_safe")).withColumnRenamed("safe_address", "address").join(subjects, "address", "left_semi")
    payload = F.to_json(F.struct(F.col("source").alias("owner_source"), "threshold"), {"ignoreNullFields": "false"})
    rows = own.select("address", F.col("owner_address").alias("key"), F.concat(F.lit("safe_owners:"), F.col("source")).alias("source"), F.coalesce("observed_block", F.lit(0)).alias("observed_block"), payload.alias("payload_json"))
    return _rows(rows, "safe_owner", MEDIUM)


def extract_all(subjects: DataFrame, *, transfers: DataFrame, ens: DataFrame, owners: DataFrame, documents: DataFrame, deny: DataFrame | None = None) -> DataFrame:
    parts = (extract_funded_by(transfers, subjects, deny=deny), extract_ens_handles(ens, subjects), extract_did_controllers(documents, subjects), extract_safe_owners(owners, subjects))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Ablation modes and the kinds each keeps.
ABLATIONS = {
    "all_evidence": ("funded_by", "safe_owner", "ens_handle", "did_controller"),
    "safe_owner_only": ("safe_owner",),
    "did_controller_only": ("did_controller",),
    "funded_by_only": ("funded_by",),
    "ens_handle_only": ("ens_handle",),
    "safe_owner_and_funded_by": ("safe_owner", "funded_by"),
    "without_ens": ("funded_by", "safe_owner", "did_controller"),
}
#: Other names of modes.
ABLATION_ALIASES = {"all": "all_evidence", "safe_owner+funded_by": "safe_owner_and_funded_by", "no_ens": "without_ens"}


def parse_ablation(name: str) -> str:
    mode = name.strip().lower()
    mode = ABLATION_ALIASES.get(mode, mode)
    if mode not in ABLATIONS:
        raise ValueError(f"unknown ablation mode: {name.strip()}")
    return mode


def parse_ablations(names: str) -> list[str]:
    """A comma list of modes; ``all`` alone is every mode."""
    return list(ABLATIONS) if names.strip().lower() == "all" else [parse_ablation(n) for n in names.split(",")]


def ablate(evidence: DataFrame, mode: str) -> DataFrame:
    return evidence.where(F.col("kind").isin(*ABLATIONS[parse_ablation(mode)]))


def ablated(evidence: DataFrame) -> DataFrame:
    """Every mode in one plan: a ``mode`` column and the rows that the mode keeps."""
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.array(*[F.lit(k) for k in kinds]).alias("kinds")) for m, kinds in ABLATIONS.items()])
    kept = F.filter(modes, lambda m: F.array_contains(m["kinds"], F.col("kind")))
    return evidence.select(F.explode(F.transform(kept, lambda m: m["mode"])).alias("mode"), *evidence.columns)
