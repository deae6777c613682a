"""Evidence audit and diagnostic summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.baseline import directed, semantic_class
from linkweave.schemas import AUDIT_CLASSES


def kind_counts(evidence: DataFrame) -> DataFrame:
    named = F.element_at(F.create_map(*[F.lit(x) for kv in AUDIT_CLASSES.items() for x in kv]), semantic_class(F.col("kind")))
    return evidence.groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", named.alias("semantic_class"), directed(F.col("kind")).alias("directed"))


def source_counts(evidence: DataFrame, limit: int = 200) -> DataFrame:
    return evidence.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(limit)


def duplication(evidence: DataFrame) -> DataFrame:
    """Rows against distinct (address, key), (address, kind, key), sources and payload transaction hashes."""
    tx = F.nullif(F.get_json_object("payload_json", "$.tx_hash"), F.lit(""))
    # one aggregation by the finest key; the coarser distinct counts come from its rows
    fine = evidence.groupBy("address", "key", "kind").agg(F.count("*").alias("n"))
    pairs = fine.groupBy("address", "key").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    counts = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"), F.count("*").alias("unique_pairs"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("unique_pair_kinds"))
    other = evidence.agg(F.countDistinct("source").alias("unique_sources"), F.countDistinct(tx).alias("unique_tx_hashes"))
    ratio = lambda c: F.col("raw_rows") / F.nullif(F.col(c), F.lit(0))
    return counts.crossJoin(other).withColumn("rows_per_pair", ratio("unique_pairs")).withColumn("rows_per_pair_kind", ratio("unique_pair_kinds"))


def temporal(evidence: DataFrame) -> DataFrame:
    dated = F.when(F.col("observed_block") > 0, F.col("observed_block"))
    stamp = F.coalesce(F.get_json_object("payload_json", "$.timestamp"), F.get_json_object("payload_json", "$.observed_at"))
    return evidence.agg(F.count(dated).alias("dated_rows"), F.min(dated).alias("min_block"), F.max(dated).alias("max_block"), F.count(stamp).alias("stamped_rows"), F.min(stamp).alias("min_timestamp"), F.max(stamp).alias("max_timestamp")).select((F.col("dated_rows") > 0).alias("has_block_number"), "min_block", "max_block", (F.col("stamped_rows") > 0).alias("has_timestamp"), "min_timestamp", "max_timestamp")


def readiness(evidence: DataFrame) -> DataFrame:
    """What the kinds that are present can support."""
    cls = semantic_class(F.col("kind"))
    has = lambda name: F.coalesce(F.bool_or(cls == name), F.lit(False))
    found = evidence.agg(*[has(n).alias(n) for n in ("event", "control", "identity", "verified")])
    e, c, i, v = (F.col(n) for n in ("event", "control", "identity", "verified"))
    return found.select((e | c | i | v).alias("relatedness"), c.alias("control_link"), (i | v).alias("identity_claim"), v.alias("same_controller"), (e & ~(c | i | v)).alias("event_only"))


def top_keys(evidence: DataFrame, n: int = 25) -> DataFrame:
    return evidence.groupBy("kind", "key").agg(F.count("*").alias("attestations")).orderBy(F.desc("attestations"), "kind", "key").limit(n)


def top_addresses(evidence: DataFrame, n: int = 20) -> DataFrame:
    return evidence.groupBy("address").agg(F.count("*").alias("attestations")).orderBy(F.desc("attestations"), "address").limit(n)


def strength_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("strength").agg(F.count("*").alias("n"))


def fanout_histogram(evidence: DataFrame) -> DataFrame:
    """How many keys touch how many addresses."""
    per_key = evidence.select("kind", "key", "address").distinct().groupBy("kind", "key").agg(F.count("*").alias("addresses_per_key"))
    return per_key.groupBy("addresses_per_key").agg(F.count("*").alias("n_keys"))


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n)."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = each[0]
    for one in each[1:]:
        out = out.unionByName(one)
    return out


def gold_profile(gold: DataFrame) -> DataFrame:
    return gold.groupBy("label").agg(F.count("*").alias("n"))
