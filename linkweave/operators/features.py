"""Per-cluster features: funding, first funders, sinks, control density, token overlap, tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.scalar import burst_label
from linkweave.operators.hubs import meetings
from linkweave.schemas import SHORT_BURST_BLOCKS

ENS_KINDS, DID_KINDS, VERIFIED_KINDS = ("ens", "ens_handle"), ("did", "did_controller"), ("did_controller_verified", "verified_did", "signature_verified")
_IDENTITY = (*ENS_KINDS, *DID_KINDS, *VERIFIED_KINDS, "claim", "profile")
#: Payload fields that name contracts and methods.
CONTRACT_FIELDS, METHOD_FIELDS = ("contract", "contract_address", "to", "address"), ("method_id", "method", "selector", "sig", "function_selector")


def cluster_evidence(evidence: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence rows of each cluster's members, and owner rows whose key is a member; once per (address, kind, key, source)."""
    by_address = evidence.join(members, "address")
    keys = members.select(F.col("address").alias("member"), "cluster_id")
    by_key = evidence.where("kind = 'safe_owner'").join(keys, F.col("key") == F.col("member")).drop("member")
    return by_address.unionByName(by_key.select(*by_address.columns)).dropDuplicates(["cluster_id", "address", "kind", "key", "source"])


def _top(counts: DataFrame, item: str, n: str) -> list[Column]:
    """Argmax with the smallest item among equals."""
    best = F.min(F.struct((-F.col(n)).alias("loss"), F.col(item).alias("item")))
    return [best["item"].alias(f"top_{item}"), (-best["loss"]).alias(f"top_{item}_count")]


def funding(rows: DataFrame, members: DataFrame, short: int = SHORT_BURST_BLOCKS) -> DataFrame:
    funded = rows.where("kind = 'funded_by'")
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("num_addresses"))
    per = funded.groupBy("cluster_id", F.lower("key").alias("funder")).agg(F.countDistinct(F.lower("address")).alias("n"))
    top = per.groupBy("cluster_id").agg(F.count("*").alias("num_unique_funders"), *_top(per, "funder", "n"))
    dated = F.when(F.col("observed_block") > 0, F.col("observed_block"))
    blocks = funded.groupBy("cluster_id").agg(F.min(dated).alias("funding_block_min"), F.max(dated).alias("funding_block_max"))
    out = sizes.join(top, "cluster_id", "left").join(blocks, "cluster_id", "left").fillna(0, ["num_unique_funders", "top_funder_count"])
    span = F.col("funding_block_max") - F.col("funding_block_min")
    return out.withColumn("top_funder_share", F.when(F.col("num_unique_funders") > 0, F.col("top_funder_count") / F.col("num_addresses"))).withColumn("funding_block_span", span).withColumn("funding_burst_label", burst_label(F.col("funding_block_span"), short))


def first_funders(transfers: DataFrame) -> DataFrame:
    """(address, first_funder): the sender of the first incoming transfer with a block.

    ``min_by`` is combined on the map side; a window would sort each recipient's transfers.
    """
    order = [F.col("block_num")] + ([F.col("id")] if "id" in transfers.columns else [F.coalesce("tx_hash", F.lit("")), F.lower("from_addr")])
    return transfers.where("block_num is not null").groupBy(F.lower("to_addr").alias("address")).agg(F.min_by(F.lower("from_addr"), F.struct(*order)).alias("first_funder"))


def shared_first_funder(transfers: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, first_funder_shared_count): members with the commonest first funder."""
    own = transfers.join(members.select(F.col("address").alias("member")), F.lower("to_addr") == F.col("member"), "left_semi")
    per = first_funders(own).join(members, "address").groupBy("cluster_id", "first_funder").agg(F.count("*").alias("n"))
    return per.groupBy("cluster_id").agg(F.max("n").alias("first_funder_shared_count"))


def sinks(transfers: DataFrame, members: DataFrame) -> DataFrame:
    """Recipients outside the cluster of its members' transfers; few sinks with most of the mass may be a consolidation."""
    sender = members.select(F.col("address").alias("sender"), "cluster_id")
    sent = transfers.select(F.lower("from_addr").alias("sender"), F.lower("to_addr").alias("sink")).groupBy("sender", "sink").agg(F.count("*").alias("n"))
    own = sent.join(sender, "sender").groupBy("cluster_id", "sink").agg(F.sum("n").alias("n"))
    inside = members.select(F.col("address").alias("sink"), "cluster_id")
    out = own.join(inside, ["cluster_id", "sink"], "left_anti")
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("num_addresses"))
    top = out.groupBy("cluster_id").agg(F.count("*").alias("num_unique_sinks"), *_top(out, "sink", "n"), F.sum("n").alias("total"))
    joined = sizes.join(top, "cluster_id", "left").fillna(0, ["num_unique_sinks", "top_sink_count"]).withColumn("top_sink_share", F.when(F.col("total") > 0, F.col("top_sink_count") / F.col("total")))
    return joined.withColumn("possible_consolidation", F.coalesce((F.col("num_addresses") >= 2) & (F.col("top_sink_share") >= 0.55) & (F.col("num_unique_sinks") <= 4), F.lit(False))).drop("total", "num_addresses")


def _classes(rows: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """Addresses of a cluster that hold the same items, as one class.

    Takes distinct (cluster_id, address, item). Gives the classes (cluster_id, one, n, m), where
    ``one`` is the first address, ``n`` the number of items and ``m`` that of addresses, and the
    same with a row per item. Sets are told apart by their size and a 128-bit digest, so no set is gathered.
    """
    sets = rows.groupBy("cluster_id", "address").agg(F.bit_xor(F.xxhash64(item)).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), item)).alias("y"), F.count("*").alias("n"))
    classes = sets.groupBy("cluster_id", "x", "y", "n").agg(F.min("address").alias("one"), F.count("*").alias("m")).drop("x", "y")
    return classes, rows.withColumnRenamed("address", "one").join(classes, ["cluster_id", "one"])


def _class_pairs(held: DataFrame, item: str) -> DataFrame:
    """(cluster_id, one_a, one_b, n_a, n_b, m_a, m_b, c): two classes with ``c`` common items; a hub's pairs are spread."""
    met = meetings(held.select("cluster_id", item, "one", "n", "m"), ["cluster_id", item], "one").where("one <> one_b")
    first = F.col("one") < F.col("one_b")
    sides = [F.when(first if s == "a" else ~first, F.col(c)).otherwise(F.col(f"{c}_b")).alias(f"{c}_{s}") for c in ("one", "n", "m") for s in "ab"]
    return met.select("cluster_id", *sides).groupBy("cluster_id", "one_a", "one_b", "n_a", "n_b", "m_a", "m_b").agg(F.count("*").alias("c"))


def control(rows: DataFrame, members: DataFrame, cap: int | None = None) -> DataFrame:
    """Owner counts, and the share of member pairs with a common owner.

    Members with the same owners are one class, and pairs of classes are made per owner inside a
    cluster, so an owner of many members alike costs one row; owners above the linking cap never merged anyone,
    and ``cap`` leaves them out where one is given.
    """
    owners = rows.where("kind = 'safe_owner'").select("cluster_id", F.lower("key").alias("owner"), F.lower("address").alias("safe"))
    per = owners.groupBy("cluster_id", "owner").agg(F.countDistinct("safe").alias("safes"), F.count("*").alias("n"))
    counts = per.groupBy("cluster_id").agg(F.sum("n").alias("safe_owner_count"), F.count("*").alias("unique_safe_owners"), F.count_if(F.col("safes") >= 2).alias("shared_safe_owner_count"))
    inside = owners.distinct().join(members.select("cluster_id", F.col("address").alias("safe")), ["cluster_id", "safe"], "left_semi")
    inside = inside.join(per.where("safes >= 2" + (f" and safes <= {cap}" if cap else "")).select("cluster_id", "owner"), ["cluster_id", "owner"], "left_semi")
    classes, held = _classes(inside.withColumnRenamed("safe", "address"), "owner")
    within = classes.select("cluster_id", F.expr("m * (m - 1) div 2").alias("p"))
    across = _class_pairs(held, "owner").select("cluster_id", F.expr("m_a * m_b").alias("p"))
    pairs = within.unionByName(across).groupBy("cluster_id").agg(F.sum("p").alias("pairs"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("num_addresses"))
    joined = sizes.join(counts, "cluster_id", "left").join(pairs, "cluster_id", "left").fillna(0)
    n = F.col("num_addresses").cast("double")
    return joined.withColumn("control_link_density", F.when(F.col("num_addresses") >= 2, F.col("pairs") / (n * (n - 1) / 2))).drop("pairs", "num_addresses")


def identity(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence and identifier counts, and counts of identity kinds."""
    kind = F.col("kind")
    counts = rows.groupBy("cluster_id").agg(F.count("*").alias("num_evidence_rows"), F.count_if(kind.isin(*ENS_KINDS)).alias("ens_count"), F.count_if(kind.isin(*DID_KINDS)).alias("did_count"), F.count_if(kind.isin(*VERIFIED_KINDS)).alias("verified_did_count"))
    key = F.trim("key")
    keys = rows.where(kind.isin(*_IDENTITY) & (key != "")).select("cluster_id", F.when(key.startswith("0x"), F.lower(key)).otherwise(key).alias("identifier"))
    idents = keys.unionByName(members.select("cluster_id", F.col("address").alias("identifier"))).distinct().groupBy("cluster_id").agg(F.count("*").alias("num_identifiers"))
    return idents.join(counts, "cluster_id", "left").fillna(0).withColumn("did_verified_present", F.col("verified_did_count") > 0)


def _payload_tokens(fields: tuple[str, ...]) -> Column:
    """Distinct lower-case strings, or members of lists of strings, under the fields of a JSON object."""
    values = []
    for name in fields:
        raw = F.get_json_object("payload_json", f"$.{name}")
        listed = F.from_json(raw, "array<string>")
        values.append(F.when(raw.startswith("["), listed).otherwise(F.array(raw)))
    cleaned = F.transform(F.flatten(F.array(*[F.coalesce(v, F.array().cast("array<string>")) for v in values])), lambda t: F.lower(F.trim(t)))
    return F.filter(F.array_distinct(cleaned), lambda t: t.isNotNull() & (t != ""))


def token_overlap(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Mean pairwise Jaccard of members' contract and method tokens; null with fewer than two that have any.

    The mean over all pairs is a sum over pairs that share a token, divided by the number of
    pairs, so pairs without a common token are never made. Members with the same tokens are one
    class: pairs inside it count one each, and only pairs of classes are joined.
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("num_addresses"))
    out = sizes.select("cluster_id")
    for name, fields in (("contract", CONTRACT_FIELDS), ("method", METHOD_FIELDS)):
        tokens = rows.where("payload_json is not null").select("cluster_id", F.lower("address").alias("address"), F.explode(_payload_tokens(fields)).alias("token")).distinct().join(members, ["cluster_id", "address"], "left_semi")
        classes, held = _classes(tokens, "token")
        within = classes.select("cluster_id", F.expr("m * (m - 1) / 2").alias("j"))
        across = _class_pairs(held, "token").select("cluster_id", (F.col("m_a") * F.col("m_b") * F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c"))).alias("j"))
        summed = within.unionByName(across).groupBy("cluster_id").agg(F.sum("j").alias("s"))
        n = classes.groupBy("cluster_id").agg(F.sum("m").alias("n"))
        joined = n.join(summed, "cluster_id", "left").select("cluster_id", F.col("n").alias(f"{name}_addresses"), F.when(F.col("n") >= 2, F.coalesce("s", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias(f"{name}_overlap"))
        out = out.join(joined, "cluster_id", "left").fillna(0, [f"{name}_addresses"])
    return out


def tiers(features: DataFrame) -> DataFrame:
    """candidate_high, candidate_medium or low with the conditions that fired; labels of coordination diagnostics only."""
    c = F.col
    n, funder, sink = c("num_addresses"), F.coalesce("top_funder_share", F.lit(0.0)), F.coalesce("top_sink_share", F.lit(0.0))
    conditions = {
        "high_funding": (n > 2) & (funder >= 0.65) & c("funding_burst_label").isin("same_block", "short_burst"),
        "high_sink": (n > 2) & (sink >= 0.6) & c("possible_consolidation"),
        "medium_funding": (n >= 2) & (funder >= 0.35) & (funder < 0.65) & (c("funding_burst_label") != "long_span"),
        "medium_sink": (n >= 2) & (sink >= 0.35) & (sink < 0.6),
        "medium_shared_owner": (c("shared_safe_owner_count") >= 1) & (n >= 2),
        "medium_single_funder": (c("num_unique_funders") == 1) & (n >= 2),
    }
    fired = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in conditions.items()]), lambda x: x.isNotNull())
    tier = F.when(F.exists("fired", lambda x: x.startswith("high")), "candidate_high").when(F.size("fired") > 0, "candidate_medium").otherwise("low")
    shown = F.when(c("tier") == "candidate_high", F.filter("fired", lambda x: x.startswith("high"))).otherwise(F.col("fired"))
    return features.withColumn("fired", fired).withColumn("tier", tier).withColumn("reasons", F.array_join(shown, ",")).drop("fired")


def tier_order() -> list:
    rank = F.when(F.col("tier") == "candidate_high", 0).when(F.col("tier") == "candidate_medium", 1).otherwise(2)
    return [rank, F.desc("num_addresses"), F.col("cluster_id")]


def cluster_features(evidence: DataFrame, members: DataFrame, transfers: DataFrame, *, short: int = SHORT_BURST_BLOCKS) -> DataFrame:
    """The whole vector, one row per cluster. The parts are partitioned by cluster id and join without a new shuffle of members."""
    rows = cluster_evidence(evidence, members)
    out = funding(rows, members, short)
    for part in (identity(rows, members), shared_first_funder(transfers, members), control(rows, members), sinks(transfers, members), token_overlap(rows, members)):
        out = out.join(part, "cluster_id", "left")
    return tiers(out)
