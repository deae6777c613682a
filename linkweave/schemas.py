"""Table schemas, fixed values and policy parameters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    """``name type`` pairs; a trailing ``?`` marks a nullable column."""
    kinds = {"str": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "dbl": T.DoubleType(), "bool": T.BooleanType(), "ts": T.TimestampType()}
    out = T.StructType()
    for part in text.split(","):
        name, kind = part.split()
        out.add(name, kinds[kind.rstrip("?")], kind.endswith("?"))
    return out


TABLES = {
    "addresses": _schema("address str, first_seen_block long?, label str?"),
    "transfers": _schema("from_addr str, to_addr str, value str?, block_num long?, tx_hash str?, asset str?"),
    "ens_records": _schema("address str, name str?, twitter str?, github str?, telegram str?"),
    "safe_owners": _schema("safe_address str, owner_address str, owner_is_safe bool, threshold long?, observed_block long?, source str"),
    "did_documents": _schema("did str, subject_address str, controller str, method str, document_json str?, observed_block long?, source str"),
    "evidence": _schema("address str, kind str, key str, strength int, source str, observed_block long, payload_json str?"),
    "clustering_runs": _schema("run_id str, params_json str, started_at ts, notes str?"),
    "entity_clusters": _schema("cluster_run_id str, cluster_id str, address str, evidence_json str?"),
    "suspected_service_keys": _schema("cluster_run_id str, kind str, key str, fan_out long, detected_at ts"),
    "dataset_runs": _schema("run_id str, chain str, run_type str, parent_run_id str?, window_start_block long, window_end_block long, window_start_ts str?, window_end_ts str?, cadence str, seed_spec_json str, params_json str, input_snapshot_hash str, code_commit str, created_at ts, notes str?, policy_profile_id str, stable_threshold dbl, related_threshold dbl"),
    "run_inputs": _schema("run_id str, input_type str, input_ref str, source str, metadata_json str?"),
    "run_metrics": _schema("run_id str, address_count long, transfer_count long, evidence_count long, cluster_count long, multi_cluster_count long, skipped_key_count long, largest_cluster long, lineage_row_count long, metadata_json str?"),
    "cluster_lineage": _schema("current_run_id str?, current_cluster_id str?, previous_run_id str?, previous_cluster_id str?, overlap_count long, jaccard dbl, transition_label str"),
    "graph_exports": _schema("run_id str, artifact_type str, path str, sha256 str, metadata_json str?"),
    "seeds": _schema("address str, first_seen_block long, seed_type str?"),
    "gold": _schema("address_a str, address_b str, label str, rationale str?"),
}

#: Evidence kinds in their order.
KINDS = ("funded_by", "safe_owner", "ens_handle", "did_controller")
WEAK, MEDIUM, STRONG = 1, 2, 3

#: Hot wallets of exchanges, never a funder.
EXCHANGES = (
    "0x28c6c06298d514db089934071355e5743bf21d60",
    "0x21a31ee1afc51d94c2efccaa2092ad1028285549",
    "0xdfd5293d8e347dfe59e90efd55b2956a1343963d",
    "0x56eddb7aa87536c09ccc2793473599fd21a8b17f",
    "0x9696f59e4d72e237be84ffd425dcad154bf96976",
    "0x71660c4005ba85c37ccec55d0c4493e66fe775d3",
    "0x503828976d22510aad0201ac7ec88293211d23da",
    "0xa090e606e30bd747d4e6245a1517ebe430f0057e",
    "0xddfabcdc4d8ffc6d5beaf154f18b778f892a0740",
    "0x3cd751e6b0078be393132286c442345e5dc49699",
    "0x267be1c1d684f78cb4f6a176c4911b741e4ffdc0",
    "0x2910543af39aba0cd09dbb2d50200b3e800a63d2",
    "0xe853c56864a2ebe4576a807d26fdc4a0ada51919",
    "0x53d284357ec70ce289d6d64134dfac8e511c8a3d",
)
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
#: The zero address and routers, never a shared funder under the conservative policy.
SUPPRESSED_FUNDERS = (
    ZERO_ADDRESS,
    "0x111111125421ca6dc452d289314280a0f8842a65",
    "0x1231deb6f5749ef6ce6943a275a1d3e7486f4eae",
    "0x2342deb6f5749ef6ce6943a275a1d3e7486f5fbf",
)
#: Governor contracts, the token, and the log topics that are decoded.
GOVERNORS = ("0xf07ded9dc292157749b6fd268e37df6ea38395b9", "0x789fc99093b09ad01c34dc7251d0c89ce743e5a4")
TOKEN = "0x912ce59144191c1204e64559fe8253a0e49e6548"
TOPIC_VOTE_CAST = "0xb8e138887d0aa13bab447e82de9d5c1777041ecd21ca36ba824ff1e6c07ddda4"
TOPIC_VOTE_CAST_PARAMS = "0xe2babfbac5889a709b63bb7f598b324e08bc5a4fb9ec647fb3cbc9ec07eb8712"
TOPIC_PROPOSAL_CREATED = "0x7d84a6263ae0d98d3329bd7b46bb4e8d6f98cd35a7adb45c274c8b7fd5ebd5e0"
TOPIC_TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"

#: Semantic class of each evidence kind.
SEMANTIC_CLASSES = {
    "event": ("funded_by", "transfer", "interaction"),
    "control": ("safe_owner", "owner", "admin", "deployer"),
    "identity": ("ens", "ens_handle", "profile", "claim", "did", "did_controller"),
    "verified": ("did_controller_verified", "verified_did", "signature_verified"),
}
#: The audit's names of those classes.
AUDIT_CLASSES = {"event": "event_evidence", "control": "control_evidence", "identity": "identity_claim", "verified": "verified_identity_controller", "unknown": "unknown"}

FAN_OUT_CAP = 50
STABLE, RELATED = 0.5, 0.1
SHORT_BURST_BLOCKS = 100
GRAPH_IDENTIFIERS, GRAPH_EVIDENCE = 50, 200
PRECISION_AT = (1, 2, 5, 10, 20, 50, 100)

#: Said in every rendered output.
BOUNDARY = "Coordination evidence only: no attack attribution and no identity claim."


@dataclass(frozen=True)
class MergePolicy:
    """When two addresses that share evidence are merged."""

    conservative: bool = True
    fan_out_cap: int = FAN_OUT_CAP
    funded_fan_out_cap: int = FAN_OUT_CAP
    min_shared_keys: int = 2
    min_burst_hits: int = 2
    burst_blocks: int = 5000
    suppressed: tuple[str, ...] = SUPPRESSED_FUNDERS

    @property
    def profile(self) -> str:
        return "conservative" if self.conservative else "legacy"


CONSERVATIVE, LEGACY = MergePolicy(), MergePolicy(conservative=False)


@dataclass(frozen=True)
class LinkageParams:
    t_high: float = 6.0
    t_low: float = 2.0
    w_did_controller: float = 12.0
    w_safe_owner_jaccard: float = 0.0
    w_safe_owner_min_overlap: float = 8.0
    w_shared_safe_owner_count: float = 0.0
    w_shared_ens_handle: float = 5.0
    w_shared_funder: float = 3.0
    funder_fanout_ln_offset: float = 2.0
    link_probability_mid: float = 4.0
    link_probability_scale: float = 2.0

    @classmethod
    def from_json(cls, text: str) -> LinkageParams:
        """All weights are required but for the two that may be left out and are then zero."""
        given, names = json.loads(text), {f.name for f in fields(cls)}
        given = {"w_safe_owner_min_overlap": 0.0, "w_shared_safe_owner_count": 0.0} | given
        if missing := names - set(given):
            raise ValueError(f"missing parameters: {', '.join(sorted(missing))}")
        return cls(**{k: float(given[k]) for k in names})

    def to_json(self) -> str:
        return json.dumps(asdict(self))
