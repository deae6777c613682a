"""DuckDB SQL for the registry, built from named common table expressions."""

from __future__ import annotations

import re

from linkweave.operators.baseline import ALSO_CONTROL, CAVEATS, HUB_NOTE, RANKINGS
from linkweave.plans.fixture import FIXTURES
from linkweave.schemas import EXCHANGES, SUPPRESSED_FUNDERS


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_FUNDED = """SELECT to_addr AS address, 'funded_by' AS kind, from_addr AS key, 2 AS strength, 'alchemy_getAssetTransfers@' || CAST(b AS VARCHAR) AS source,
  b AS observed_block, CAST(NULL AS VARCHAR) AS payload_json
  FROM (SELECT to_addr, from_addr, coalesce(min(block_num), 0) AS b FROM fx_transfers GROUP BY ALL) WHERE from_addr NOT IN ({deny}) AND to_addr IN (SELECT address FROM subj)"""

_KEPT_LEGACY = "SELECT kind, key FROM keys WHERE fan_out BETWEEN 2 AND 50"
_KEPT_CONSERVATIVE = f"SELECT kind, key FROM keys WHERE fan_out BETWEEN 2 AND 50 AND NOT (kind = 'funded_by' AND key IN ({_quoted(SUPPRESSED_FUNDERS)}))"


def _rows(evidence: str, kept: str) -> str:
    return f"""SELECT a.address AS address_a, b.address AS address_b, a.kind, a.key, greatest(a.strength, b.strength) AS strength, abs(a.observed_block - b.observed_block) AS block_delta
  FROM {evidence} a JOIN {evidence} b ON a.kind = b.kind AND a.key = b.key AND a.address < b.address JOIN {kept} k ON k.kind = a.kind AND k.key = a.key"""


def _stats(rows: str) -> str:
    return f"""SELECT address_a, address_b, count(*) AS n_edges, max(strength) AS max_strength, count(*) FILTER (kind <> 'funded_by') AS nf_edges,
  coalesce(max(strength) FILTER (kind <> 'funded_by'), 1) AS nf_max, count(DISTINCT key) FILTER (kind = 'funded_by') AS funded_keys,
  count(*) FILTER (kind = 'funded_by' AND block_delta <= 5000) AS burst_hits FROM {rows} GROUP BY ALL"""


_LEGACY_RULE = "(max_strength = 3 OR (n_edges >= {n} AND max_strength >= 2))"
_CONSERVATIVE_RULE = "(nf_max = 3 OR (nf_edges >= 1 AND nf_max >= 2 AND nf_edges + funded_keys >= 2) OR (funded_keys >= 2 AND burst_hits >= 2))"


def _components(edges: str, nodes: str = "subj") -> dict[str, str]:
    return {
        f"{edges}_sym": f"SELECT address_a AS a, address_b AS b FROM {edges} UNION SELECT address_b, address_a FROM {edges}",
        f"{edges}_reach": f"SELECT address AS a, address AS b FROM {nodes} UNION SELECT r.a, s.b FROM {edges}_reach r JOIN {edges}_sym s ON r.b = s.a",
        f"{edges}_cl": f"SELECT min(b) AS cluster_id, a AS address FROM {edges}_reach GROUP BY a",
    }


_CLASS = "CASE WHEN {k} IN ('funded_by', 'transfer', 'interaction') THEN 'event' WHEN {k} IN ('safe_owner', 'owner', 'admin', 'deployer') THEN 'control' WHEN {k} IN ('ens', 'ens_handle', 'profile', 'claim', 'did', 'did_controller') THEN 'identity' WHEN {k} IN ('did_controller_verified', 'verified_did', 'signature_verified') THEN 'verified' ELSE 'unknown' END"
_SHORT = "CASE WHEN starts_with({c}, '0x') AND length({c}) >= 12 THEN left({c}, 6) || '…' || right({c}, 4) ELSE left({c}, 24) END"
_STRENGTH = "CASE {c} WHEN 3 THEN 'strong' WHEN 2 THEN 'medium' WHEN 1 THEN 'weak' END"
_BURST = "CASE WHEN {s} IS NULL THEN 'unknown' WHEN {s} = 0 THEN 'same_block' WHEN {s} <= 100 THEN 'short_burst' ELSE 'long_span' END"
_ORDINAL = "CASE kind WHEN 'funded_by' THEN 1 WHEN 'safe_owner' THEN 2 WHEN 'ens_handle' THEN 3 ELSE 4 END"
_STRATUM = "least(9, ((greatest(0, least(20000, first_seen_block))) * 10) // 20001)"

CTES: dict[str, str] = {f"fx_{k}": v for k, v in FIXTURES.items()}
CTES |= {
    "subj": "SELECT DISTINCT lower(address) AS address FROM fx_addresses",
    "ev_fb": _FUNDED.format(deny=_quoted(EXCHANGES)),
    "ev_ens": """SELECT address, 'ens_handle' AS kind, service || ':' || lower(regexp_replace(trim(handle), '^@+', '')) AS key, 2 AS strength, 'ens_records' AS source, CAST(0 AS BIGINT) AS observed_block,
  '{"ens_name":' || CASE WHEN name IS NULL THEN 'null' ELSE '"' || name || '"' END || '}' AS payload_json
  FROM (SELECT address, name, 'twitter' AS service, twitter AS handle FROM fx_ens_records UNION ALL SELECT address, name, 'github', github FROM fx_ens_records UNION ALL SELECT address, name, 'telegram', telegram FROM fx_ens_records)
  WHERE trim(handle) <> '' AND address IN (SELECT address FROM subj)""",
    "ev_did": """SELECT address, 'did_controller' AS kind, key, 3 AS strength, 'did_documents:' || m || ':' || s AS source, coalesce(b, 0) AS observed_block,
  '{"dids":["' || dids || '"],"methods":["' || ms || '"]}' AS payload_json
  FROM (SELECT lower(subject_address) AS address, lower(controller) AS key, first(method ORDER BY observed_block NULLS FIRST, did) AS m, first(source ORDER BY observed_block NULLS FIRST, did) AS s,
          first(observed_block ORDER BY observed_block NULLS FIRST, did) AS b, string_agg(did, '","' ORDER BY observed_block NULLS FIRST, did) AS dids, string_agg(method, '","' ORDER BY observed_block NULLS FIRST, did) AS ms
        FROM fx_did_documents WHERE lower(subject_address) <> lower(controller) GROUP BY ALL) WHERE address IN (SELECT address FROM subj)""",
    "ev_safe": """SELECT safe_address AS address, 'safe_owner' AS kind, owner_address AS key, 2 AS strength, 'safe_owners:' || source AS source, coalesce(observed_block, 0) AS observed_block,
  '{"owner_source":"' || source || '","threshold":' || CAST(threshold AS VARCHAR) || '}' AS payload_json FROM fx_safe_owners WHERE NOT owner_is_safe AND safe_address IN (SELECT address FROM subj)""",
    "ev": "SELECT * FROM ev_fb UNION ALL SELECT * FROM ev_ens UNION ALL SELECT * FROM ev_did UNION ALL SELECT * FROM ev_safe",
    "keys": "SELECT kind, key, count(*) AS fan_out, count(DISTINCT address) AS n_addresses FROM ev GROUP BY ALL",
    "kept_l": _KEPT_LEGACY,
    "kept_c": _KEPT_CONSERVATIVE,
    "rows_l": _rows("ev", "kept_l"),
    "rows_c": _rows("ev", "kept_c"),
    "st_l": _stats("rows_l"),
    "st_c": _stats("rows_c"),
    "me_l1": f"SELECT address_a, address_b FROM st_l WHERE {_LEGACY_RULE.format(n=1)}",
    "me_l2": f"SELECT address_a, address_b FROM st_l WHERE {_LEGACY_RULE.format(n=2)}",
    "me_c": f"SELECT address_a, address_b FROM st_c WHERE {_CONSERVATIVE_RULE}",
    "me_s": "SELECT DISTINCT a.address AS address_a, b.address AS address_b FROM ev a JOIN ev b ON a.kind = b.kind AND a.key = b.key AND a.address < b.address AND a.strength = 3 JOIN kept_l k ON k.kind = a.kind AND k.key = a.key",
    "known": "SELECT address FROM subj WHERE CAST(address[4:] AS BIGINT) % 7 <> 0",
    "ev_p": "SELECT * FROM ev WHERE address IN (SELECT address FROM known)",
    "kept_p": f"SELECT kind, key FROM ev_p GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50 AND NOT (kind = 'funded_by' AND key IN ({_quoted(SUPPRESSED_FUNDERS)}))",
    "rows_p": _rows("ev_p", "kept_p"),
    "st_p": _stats("rows_p"),
    "me_p": f"SELECT address_a, address_b FROM st_p WHERE {_CONSERVATIVE_RULE}",
}
for _edges, _nodes in (("me_l1", "subj"), ("me_l2", "subj"), ("me_c", "subj"), ("me_s", "subj"), ("me_p", "known")):
    CTES |= _components(_edges, _nodes)
CTES |= {
    "mb": "SELECT * FROM me_c_cl",
    "sizes": "SELECT cluster_id, count(*) AS size FROM mb GROUP BY ALL",
    "svc_c": f"SELECT kind, key, fan_out FROM keys WHERE fan_out >= 2 AND (fan_out > 50 OR (kind = 'funded_by' AND key IN ({_quoted(SUPPRESSED_FUNDERS)})))",
    "shared_c": "SELECT cluster_id, ev.kind, ev.key, count(DISTINCT ev.address) AS n_members FROM ev JOIN kept_c k ON k.kind = ev.kind AND k.key = ev.key JOIN mb USING (address) GROUP BY ALL HAVING count(DISTINCT ev.address) >= 2",
    "uk": "SELECT DISTINCT address, e.kind, lower(e.key) AS key, f.n AS fan_out FROM ev e JOIN (SELECT kind, lower(key) AS key, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) <= 50) f ON f.kind = e.kind AND f.key = lower(e.key)",
    "sk": "SELECT a.address AS address_a, b.address AS address_b, a.kind, a.key, a.fan_out FROM uk a JOIN uk b ON a.kind = b.kind AND a.key = b.key AND a.address < b.address",
    "own": "SELECT address, count(*) AS n FROM uk WHERE kind = 'safe_owner' GROUP BY ALL",
    "pf": """SELECT s.*, coalesce(a.n, 0) AS owners_a, coalesce(b.n, 0) AS owners_b FROM (SELECT address_a, address_b, count(*) FILTER (kind = 'did_controller') AS shared_did, count(*) FILTER (kind = 'safe_owner') AS shared_owners,
  count(*) FILTER (kind = 'ens_handle') AS shared_ens, count(*) FILTER (kind = 'funded_by') AS shared_funders, coalesce(string_agg(key, ',' ORDER BY key) FILTER (kind = 'funded_by'), '') AS funder_list,
  coalesce(sum(3.0 / greatest(1e-6, ln(2.0 + fan_out))) FILTER (kind = 'funded_by'), 0.0) AS funder_weight FROM sk GROUP BY ALL) s LEFT JOIN own a ON a.address = address_a LEFT JOIN own b ON b.address = address_b""",
    "pf2": "SELECT *, CASE WHEN owners_a + owners_b - shared_owners > 0 THEN shared_owners / (owners_a + owners_b - shared_owners) ELSE 0.0 END AS owner_jaccard, shared_owners / greatest(1, least(owners_a, owners_b)) AS owner_min_overlap FROM pf",
    "ps0": "SELECT *, (12.0 * shared_did + 8.0 * owner_min_overlap + CASE WHEN shared_ens > 0 THEN 5.0 ELSE 0.0 END + funder_weight)::DOUBLE AS score FROM pf2",
    "ps": "SELECT *, 1 / (1 + exp(-(score - 4.0) / 2.0)) AS probability, shared_did > 0 AS anchor, TRUE AS structural, CASE WHEN shared_did > 0 OR score >= 6 THEN 'accepted' WHEN score > 2 THEN 'uncertain' ELSE 'rejected' END AS tier FROM ps0",
    "pe": """SELECT a.cluster_id, r.address_a AS source, r.address_b AS target, r.kind, r.key, r.strength FROM rows_l r JOIN me_l2 m USING (address_a, address_b) JOIN mb a ON a.address = address_a JOIN mb b ON b.address = address_b WHERE a.cluster_id = b.cluster_id""",
    "pek": "SELECT cluster_id, source, target, kind, string_agg(DISTINCT key, ',' ORDER BY key) AS keys, max(strength) AS strength FROM pe GROUP BY ALL",
    "walk": "SELECT *, row_number() OVER (ORDER BY size DESC, cluster_id) AS n FROM sizes",
    "fold": "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, '' AS cluster_id, FALSE AS kept UNION ALL SELECT w.n, CASE WHEN f.used + w.size <= 50 THEN f.used + w.size ELSE f.used END, w.cluster_id, f.used + w.size <= 50 FROM fold f JOIN walk w ON w.n = f.n + 1",
    "idn": f"SELECT 'addr:' || address AS id, address, {_SHORT.format(c='address')} AS label, cluster_id FROM mb WHERE cluster_id IN (SELECT cluster_id FROM fold WHERE kept)",
    "evn": f"""SELECT 'ev:' || kind || ':' || key AS id, kind, key, {_SHORT.format(c='key')} AS label, {_STRENGTH.format(c='s')} AS strength FROM (SELECT kind, key, max(strength) AS s FROM ev WHERE address IN (SELECT address FROM idn)
  AND (kind, key) NOT IN (SELECT (kind, key) FROM keys WHERE fan_out > 50) GROUP BY kind, key ORDER BY {_ORDINAL}, key LIMIT 200)""",
    "onn": "SELECT i.id AS identifier_id, n.id AS evidence_id, i.cluster_id, ev.* FROM ev JOIN idn i USING (address) JOIN evn n ON n.kind = ev.kind AND n.key = ev.key",
    "prev": "SELECT * FROM me_p_cl",
    "ov": """SELECT c.cluster_id AS current_cluster_id, p.cluster_id AS previous_cluster_id, count(*) AS overlap_count FROM mb c JOIN prev p USING (address) GROUP BY ALL""",
    "ovj": """SELECT o.*, overlap_count / (a.n + b.n - overlap_count) AS jaccard FROM ov o JOIN (SELECT cluster_id, count(*) AS n FROM mb GROUP BY ALL) a ON a.cluster_id = current_cluster_id
  JOIN (SELECT cluster_id, count(*) AS n FROM prev GROUP BY ALL) b ON b.cluster_id = previous_cluster_id WHERE overlap_count / (a.n + b.n - overlap_count) >= 0.1""",
    "ovr": "SELECT *, row_number() OVER (ORDER BY jaccard DESC, overlap_count DESC, current_cluster_id, previous_cluster_id) AS n FROM ovj",
    "grd": """SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS cs, CAST([] AS VARCHAR[]) AS ps, FALSE AS took UNION ALL
  SELECT o.n, CASE WHEN ok THEN list_append(cs, c) ELSE cs END, CASE WHEN ok THEN list_append(ps, p) ELSE ps END, ok FROM (SELECT o.n, g.cs, g.ps, o.current_cluster_id AS c, o.previous_cluster_id AS p,
  NOT list_contains(g.cs, o.current_cluster_id) AND NOT list_contains(g.ps, o.previous_cluster_id) AS ok FROM grd g JOIN ovr o ON o.n = g.n + 1) o""",
    "lin": """SELECT o.current_cluster_id, o.previous_cluster_id, o.overlap_count, o.jaccard, CASE WHEN jaccard >= 0.5 THEN 'stable' ELSE 'related' END AS transition_label
  FROM ovr o JOIN grd g ON g.n = o.n AND g.took
  UNION ALL SELECT cluster_id, NULL, 0, 0.0, 'new' FROM (SELECT DISTINCT cluster_id FROM mb) WHERE cluster_id NOT IN (SELECT current_cluster_id FROM ovj)
  UNION ALL SELECT NULL, cluster_id, 0, 0.0, 'disappeared' FROM (SELECT DISTINCT cluster_id FROM prev) WHERE cluster_id NOT IN (SELECT previous_cluster_id FROM ovj)""",
    "gold": "SELECT * FROM fx_gold",
    "gends": "SELECT address_a AS address FROM gold UNION SELECT address_b FROM gold",
    "logd": "SELECT CASE topic0 WHEN 'vote' THEN 'vote' ELSE 'proposal' END AS kind, CASE topic0 WHEN 'vote' THEN '0x' || lower(right(topic1, 40)) ELSE '0x' || lower(right(data[67:130], 40)) END AS address, CAST(block_hex AS BIGINT) AS block_num FROM fx_logs",
    "gov": "SELECT address, min(block_num) AS first_seen_block, CASE WHEN bool_or(kind = 'vote') THEN 'voter' ELSE 'proposer' END AS seed_type FROM logd GROUP BY address",
    "part": "SELECT address, min(block_num) AS first_block, count(*) AS n FROM (SELECT from_addr AS address, block_num FROM fx_transfers UNION ALL SELECT to_addr, block_num FROM fx_transfers) GROUP BY address",
    "pool": "SELECT address, coalesce(first_block, 0) AS first_seen_block FROM part WHERE n < 1000 AND address <> '0x0000000000000000000000000000000000000000' AND address NOT IN (SELECT address FROM fx_cohort WHERE role = 'governance')",
    "strat": f"SELECT *, CAST({_STRATUM} AS BIGINT) AS stratum, row_number() OVER (PARTITION BY {_STRATUM} ORDER BY first_seen_block, address) AS place FROM pool",
    "samp": """SELECT address, first_seen_block, stratum, 'quota' AS pass FROM strat WHERE place <= 50 UNION ALL SELECT address, first_seen_block, stratum, 'reserve' FROM
  (SELECT *, row_number() OVER (ORDER BY first_seen_block, address) AS nth FROM strat WHERE place > 50) WHERE nth <= 500 - (SELECT count(*) FROM strat WHERE place <= 50)""",
    "roles": "SELECT address, bool_or(role = 'governance') AS g, bool_or(role = 'control') AS c FROM fx_cohort GROUP BY address",
    "cs": "SELECT cluster_id, count(*) AS size, count(*) FILTER (g) AS n_governance, count(*) FILTER (c) AS n_control FROM mb LEFT JOIN roles USING (address) GROUP BY cluster_id",
    "bper": "SELECT kind, key, address, count(*) AS n, list(DISTINCT source) AS sources, min(observed_block) FILTER (observed_block > 0) AS lo, max(observed_block) FILTER (observed_block > 0) AS hi FROM ev GROUP BY ALL",
    "bpr": """SELECT a.address AS address_a, b.address AS address_b, a.kind, least(a.n, b.n) AS support, list_concat(a.sources, b.sources) AS src, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi, 1.0 / greatest(1.0, log2(n_addresses + 1.0)) AS hub
  FROM bper a JOIN bper b ON a.kind = b.kind AND a.key = b.key AND a.address < b.address JOIN keys k ON k.kind = a.kind AND k.key = a.key""",
    "bf": f"""SELECT address_a, address_b, CAST(coalesce(sum(support) FILTER (kind = 'funded_by'), 0) AS BIGINT) AS funded_by_count, CAST(coalesce(sum(support) FILTER (kind = 'safe_owner'), 0) AS BIGINT) AS safe_owner_count,
  CAST(coalesce(sum(support) FILTER (kind IN ('ens_handle', 'did_controller')), 0) AS BIGINT) AS identity_count, CAST(0 AS BIGINT) AS verified_count, CAST(sum(support) AS BIGINT) AS evidence_total,
  CAST(len(list_distinct(flatten(list(src)))) AS BIGINT) AS source_count, min(lo) AS min_block, max(hi) AS max_block, round(avg(hub), 6) AS hub_penalty, string_agg(DISTINCT {_CLASS.format(k='kind')}, ',' ORDER BY {_CLASS.format(k='kind')}) AS classes,
  string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (kind IN ('funded_by', 'safe_owner')), '') AS directed_kinds, max(hi) - min(lo) AS block_span FROM bpr GROUP BY ALL""",
    "br": f"""SELECT *, CASE WHEN identity_count > 0 THEN 'identity_claim_candidate' WHEN safe_owner_count > 0 THEN 'control_link_candidate' ELSE 'related_only' END AS recommendation,
  {_BURST.format(s='block_span')} AS temporal_pattern FROM bf""",
    "bs": """SELECT address_a, address_b, round(least(1.0, least(0.55, 0.14 * funded_by_count) * hub_penalty + least(0.35, 0.12 * safe_owner_count) * hub_penalty + least(0.3, 0.1 * identity_count) * hub_penalty), 4) AS related_score,
  round(least(0.9, 0.22 * safe_owner_count) * hub_penalty, 4) AS control_score, CAST(0 AS DOUBLE) AS did_score FROM bf""",
    "zp": """SELECT a.address AS address_a, b.address AS address_b FROM subj a JOIN subj b ON a.address < b.address
  WHERE NOT EXISTS (SELECT 1 FROM bf WHERE bf.address_a = a.address AND bf.address_b = b.address)""",
    "zn": "SELECT count(*) AS z FROM zp",
    "evv": "SELECT address, kind, key, source FROM ev UNION ALL SELECT address, kind, key, source FROM fx_evidence_verified",
    "vper": "SELECT *, count(*) OVER (PARTITION BY kind, key) AS fan FROM (SELECT kind, key, address, count(*) AS n FROM evv GROUP BY kind, key, address)",
    "vpr": "SELECT a.address AS address_a, b.address AS address_b, a.kind, least(a.n, b.n) AS support, 1.0 / greatest(1.0, log2(a.fan + 1.0)) AS hub FROM vper a JOIN vper b ON a.kind = b.kind AND a.key = b.key AND a.address < b.address",
    "vf": f"""SELECT address_a, address_b, CAST(coalesce(sum(support) FILTER (kind IN ('did_controller_verified', 'signature_verified')), 0) AS BIGINT) AS verified_count, CAST(sum(support) AS BIGINT) AS evidence_total, round(avg(hub), 6) AS hub_penalty,
  string_agg(DISTINCT {_CLASS.format(k="kind")}, ',' ORDER BY {_CLASS.format(k="kind")}) AS classes FROM vpr GROUP BY ALL""",
    "ce": "SELECT DISTINCT cluster_id, ev.address, kind, key, strength, source, observed_block, payload_json FROM ev JOIN mb USING (address) UNION SELECT cluster_id, ev.address, kind, key, strength, source, observed_block, payload_json FROM ev JOIN mb ON mb.address = ev.key WHERE kind = 'safe_owner'",
    "fper": "SELECT cluster_id, lower(key) AS funder, count(DISTINCT address) AS n FROM ce WHERE kind = 'funded_by' GROUP BY ALL",
    "ffund": "SELECT cluster_id, count(*) AS num_unique_funders, first(funder ORDER BY n DESC, funder) AS top_funder, max(n) AS top_funder_count FROM fper GROUP BY ALL",
    "fblk": "SELECT cluster_id, min(observed_block) FILTER (observed_block > 0) AS funding_block_min, max(observed_block) FILTER (observed_block > 0) AS funding_block_max FROM ce WHERE kind = 'funded_by' GROUP BY ALL",
    "cff": f"""SELECT s.cluster_id, size AS num_addresses, coalesce(num_unique_funders, 0) AS num_unique_funders, top_funder, coalesce(top_funder_count, 0) AS top_funder_count, funding_block_min, funding_block_max,
  round(top_funder_count / size, 6) AS top_funder_share, funding_block_max - funding_block_min AS funding_block_span, {_BURST.format(s='(funding_block_max - funding_block_min)')} AS funding_burst_label
  FROM sizes s LEFT JOIN ffund USING (cluster_id) LEFT JOIN fblk USING (cluster_id)""",
    "sper": "SELECT cluster_id, lower(to_addr) AS sink, count(*) AS n FROM fx_transfers JOIN mb ON mb.address = lower(from_addr) WHERE NOT EXISTS (SELECT 1 FROM mb x WHERE x.cluster_id = mb.cluster_id AND x.address = lower(to_addr)) GROUP BY ALL",
    "sagg": "SELECT cluster_id, count(*) AS num_unique_sinks, first(sink ORDER BY n DESC, sink) AS top_sink, max(n) AS top_sink_count, sum(n) AS total FROM sper GROUP BY ALL",
    "csk": """SELECT s.cluster_id, coalesce(num_unique_sinks, 0) AS num_unique_sinks, top_sink, coalesce(top_sink_count, 0) AS top_sink_count, round(CAST(top_sink_count / total AS DOUBLE), 6) AS top_sink_share,
  coalesce(size >= 2 AND top_sink_count / total >= 0.55 AND num_unique_sinks <= 4, FALSE) AS possible_consolidation FROM sizes s LEFT JOIN sagg USING (cluster_id)""",
    "so": "SELECT cluster_id, lower(key) AS owner, address AS safe FROM ce WHERE kind = 'safe_owner'",
    "soc": "SELECT cluster_id, CAST(sum(n) AS BIGINT) AS safe_owner_count, count(*) AS unique_safe_owners, count(*) FILTER (d >= 2) AS shared_safe_owner_count FROM (SELECT cluster_id, owner, count(*) AS n, count(DISTINCT safe) AS d FROM so GROUP BY ALL) GROUP BY ALL",
    "sop": "SELECT cluster_id, count(*) AS pairs FROM (SELECT DISTINCT a.cluster_id, a.safe AS x, b.safe AS y FROM so a JOIN so b ON a.cluster_id = b.cluster_id AND a.owner = b.owner AND a.safe < b.safe JOIN mb m ON m.address = a.safe AND m.cluster_id = a.cluster_id JOIN mb k ON k.address = b.safe AND k.cluster_id = a.cluster_id) GROUP BY ALL",
    "cct": """SELECT s.cluster_id, coalesce(safe_owner_count, 0) AS safe_owner_count, coalesce(unique_safe_owners, 0) AS unique_safe_owners, coalesce(shared_safe_owner_count, 0) AS shared_safe_owner_count,
  CASE WHEN size >= 2 THEN round(coalesce(pairs, 0) / (size * (size - 1) / 2.0), 6) END AS control_link_density FROM sizes s LEFT JOIN soc USING (cluster_id) LEFT JOIN sop USING (cluster_id)""",
    "tk": "SELECT DISTINCT cluster_id, address, 'contract' AS f, key AS token FROM ce WHERE kind = 'safe_owner' AND cluster_id = (SELECT m.cluster_id FROM mb m WHERE m.address = ce.address) UNION SELECT cluster_id, address, 'method', unnest([replace(source, 'safe_owners:', ''), 'exec']) FROM ce WHERE kind = 'safe_owner' AND cluster_id = (SELECT m.cluster_id FROM mb m WHERE m.address = ce.address)",
    "tn": "SELECT cluster_id, f, address, count(*) AS n FROM tk GROUP BY ALL",
    "tc": "SELECT a.cluster_id, a.f, a.address AS x, b.address AS y, count(*) AS c FROM tk a JOIN tk b ON a.cluster_id = b.cluster_id AND a.f = b.f AND a.token = b.token AND a.address < b.address GROUP BY ALL",
    "tj": "SELECT tc.cluster_id, tc.f, sum(c / (a.n + b.n - c)) AS s FROM tc JOIN tn a ON a.cluster_id = tc.cluster_id AND a.f = tc.f AND a.address = x JOIN tn b ON b.cluster_id = tc.cluster_id AND b.f = tc.f AND b.address = y GROUP BY ALL",
    "to": "SELECT n.cluster_id, n.f, n.k, CASE WHEN n.k >= 2 THEN round(coalesce(s, 0.0) / (n.k * (n.k - 1) / 2.0), 6) END AS o FROM (SELECT cluster_id, f, count(*) AS k FROM tn GROUP BY ALL) n LEFT JOIN tj USING (cluster_id, f)",
    "fx0": "SELECT cff.*, csk.num_unique_sinks, csk.top_sink_share, csk.possible_consolidation, cct.shared_safe_owner_count, top_funder_count / num_addresses AS fs, coalesce(top_sink_count / total, 0) AS ss FROM cff JOIN csk USING (cluster_id) JOIN cct USING (cluster_id) LEFT JOIN (SELECT cluster_id, total FROM sagg) USING (cluster_id)",
    "fx1": """SELECT *, num_addresses > 2 AND fs >= 0.65 AND funding_burst_label IN ('same_block', 'short_burst') AS hf, num_addresses > 2 AND ss >= 0.6 AND possible_consolidation AS hs,
  num_addresses >= 2 AND fs >= 0.35 AND fs < 0.65 AND funding_burst_label <> 'long_span' AS mf, num_addresses >= 2 AND ss >= 0.35 AND ss < 0.6 AS ms, shared_safe_owner_count >= 1 AND num_addresses >= 2 AS mo, num_unique_funders = 1 AND num_addresses >= 2 AS m1 FROM fx0""",
    "tiers": """SELECT *, CASE WHEN hf OR hs THEN 'candidate_high' WHEN mf OR ms OR mo OR m1 THEN 'candidate_medium' ELSE 'low' END AS tier,
  CASE WHEN hf OR hs THEN concat_ws(',', CASE WHEN hf THEN 'high_funding' END, CASE WHEN hs THEN 'high_sink' END) ELSE concat_ws(',', CASE WHEN mf THEN 'medium_funding' END, CASE WHEN ms THEN 'medium_sink' END, CASE WHEN mo THEN 'medium_shared_owner' END, CASE WHEN m1 THEN 'medium_single_funder' END) END AS reasons FROM fx1""",
    "blg": """SELECT *, row_number() OVER (PARTITION BY seed, leg ORDER BY block_num NULLS FIRST, tx_hash NULLS FIRST, from_addr NULLS FIRST, to_addr NULLS FIRST, asset NULLS FIRST, value NULLS FIRST) AS r
  FROM (SELECT to_addr AS seed, 0 AS leg, from_addr AS peer, * FROM fx_transfers UNION ALL SELECT from_addr, 1, to_addr, * FROM fx_transfers) WHERE block_num BETWEEN 1000 AND 40000 AND seed IN (SELECT address FROM fx_cohort)""",
    "bfr": "SELECT *, (r - 1) // 3 AS page, row_number() OVER (PARTITION BY seed, leg, coalesce(tx_hash, ''), from_addr, to_addr, coalesce(asset, ''), coalesce(value, '') ORDER BY r) = 1 AS fresh FROM blg",
    "bpg": """SELECT seed, leg, page, max(page) OVER (PARTITION BY seed, leg) > page AS more, rs FROM (SELECT seed, leg, page,
  coalesce(list({'peer': peer, 'from_addr': from_addr, 'to_addr': to_addr, 'value': value, 'block_num': block_num, 'tx_hash': tx_hash, 'asset': asset} ORDER BY r) FILTER (fresh), []) AS rs FROM bfr GROUP BY ALL)""",
    # one row a page that is fetched: the rows that it adds, all addresses met by its end, the room that it leaves
    "bst": """SELECT s.address AS seed, 0 AS leg, 0 AS page, coalesce(rs, [])[1:7] AS got, list_distinct(list_transform(coalesce(rs, [])[1:7], lambda x: x.peer)) AS peers, 7 - len(coalesce(rs, [])[1:7]) AS room, coalesce(more, FALSE) AS more
    FROM (SELECT DISTINCT address FROM fx_cohort) s LEFT JOIN bpg ON bpg.seed = s.address AND bpg.leg = 0 AND bpg.page = 0
  UNION ALL SELECT n.seed, n.leg, n.page, coalesce(rs, [])[1:n.room], list_distinct(n.peers || list_transform(coalesce(rs, [])[1:n.room], lambda x: x.peer)), n.room - len(coalesce(rs, [])[1:n.room]), coalesce(bpg.more, FALSE)
    FROM (SELECT seed, CASE WHEN stop THEN 1 ELSE leg END AS leg, CASE WHEN stop THEN 0 ELSE page + 1 END AS page, CASE WHEN stop THEN [] ELSE peers END AS peers, room
      FROM (SELECT *, room <= 0 OR len(peers) >= 5 OR NOT more OR page >= 1 AS stop FROM bst) WHERE NOT stop OR (leg = 0 AND room > 0)) n LEFT JOIN bpg ON bpg.seed = n.seed AND bpg.leg = n.leg AND bpg.page = n.page""",
    "bfe": "SELECT seed, leg, count(*) AS calls, min(room) <= 0 AS row_cap, max(len(peers)) >= 5 AS peer_cap, min(room) > 0 AND max(len(peers)) < 5 AND bool_and(more) AND count(*) = 2 AS page_cap FROM bst GROUP BY ALL",
    "rgb": "SELECT range AS lo, least(range + 4095, t) AS hi FROM (SELECT min(o_orderkey) AS f, max(o_orderkey) AS t FROM orders) r, range(f, t + 1, 4096)",
    "rgk": "SELECT list(l_orderkey) AS ks FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40",
    # a call fails while its range has over 28 logs; of others, the first (logs mod 3) calls
    "rgn": """SELECT lo, hi, 0 AS depth, len(list_filter(ks, lambda x: x BETWEEN lo AND hi)) AS logs FROM rgb, rgk
  UNION ALL SELECT h.lo, h.hi, h.depth, len(list_filter(ks, lambda x: x BETWEEN h.lo AND h.hi)) FROM
    (SELECT unnest([lo, lo + (hi - lo) // 2 + 1]) AS lo, unnest([lo + (hi - lo) // 2, hi]) AS hi, depth + 1 AS depth FROM rgn WHERE logs > 28 AND hi - lo + 1 > 128) h, rgk""",
    "rgs": "SELECT *, CASE WHEN logs <= 28 THEN 'fetched' WHEN hi - lo + 1 > 128 THEN 'split' ELSE 'failed' END AS status, CASE WHEN logs <= 28 THEN logs % 3 ELSE 3 END AS retries FROM rgn",
}


def _judged(mode: str, kinds: str) -> dict[str, str]:
    m = mode
    return {
        f"ge_{m}": f"SELECT * FROM ev WHERE kind IN ({kinds}) AND address IN (SELECT address FROM gends)",
        f"gk_{m}": f"SELECT kind, key FROM ge_{m} GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50",
        f"gr_{m}": _rows(f"ge_{m}", f"gk_{m}"),
        f"gs_{m}": _stats(f"gr_{m}"),
        f"gm_{m}": f"SELECT address_a, address_b FROM gs_{m} WHERE {_LEGACY_RULE.format(n=2)}",
        **_components(f"gm_{m}", "gends"),
        f"gu_{m}": f"SELECT DISTINCT address, e.kind, e.key, n FROM ge_{m} e JOIN (SELECT kind, key, count(*) AS n FROM ge_{m} GROUP BY ALL HAVING count(*) <= 50) f USING (kind, key)",
        f"go_{m}": f"SELECT address, count(*) AS n FROM gu_{m} WHERE kind = 'safe_owner' GROUP BY ALL",
        f"gp_{m}": f"""SELECT a.address AS address_a, b.address AS address_b, count(*) FILTER (a.kind = 'did_controller') AS did, count(*) FILTER (a.kind = 'safe_owner') AS so, count(*) FILTER (a.kind = 'ens_handle') AS ens,
  coalesce(sum(3.0 / greatest(1e-6, ln(2.0 + a.n))) FILTER (a.kind = 'funded_by'), 0.0) AS fw FROM gu_{m} a JOIN gu_{m} b ON a.kind = b.kind AND a.key = b.key AND a.address < b.address GROUP BY ALL""",
        f"gj_{m}": f"""SELECT g.address_a, g.address_b, label, coalesce(x.cluster_id = y.cluster_id, FALSE) AS merged, coalesce(did, 0) > 0 AS anchor,
  coalesce(12.0 * did + 8.0 * so / greatest(1, least(coalesce(p.n, 0), coalesce(q.n, 0))) + CASE WHEN ens > 0 THEN 5.0 ELSE 0.0 END + fw, 0.0)::DOUBLE AS score
  FROM gold g LEFT JOIN gm_{m}_cl x ON x.address = g.address_a LEFT JOIN gm_{m}_cl y ON y.address = g.address_b LEFT JOIN gp_{m} s ON s.address_a = g.address_a AND s.address_b = g.address_b
  LEFT JOIN go_{m} p ON p.address = g.address_a LEFT JOIN go_{m} q ON q.address = g.address_b""",
    }


_MODES = {
    "all_evidence": "'funded_by', 'safe_owner', 'ens_handle', 'did_controller'",
    "safe_owner_only": "'safe_owner'",
    "did_controller_only": "'did_controller'",
    "funded_by_only": "'funded_by'",
    "ens_handle_only": "'ens_handle'",
    "safe_owner_and_funded_by": "'safe_owner', 'funded_by'",
    "without_ens": "'funded_by', 'safe_owner', 'did_controller'",
}
for _mode, _kinds in _MODES.items():
    CTES |= _judged(_mode, _kinds)


def _confusion(mode: str) -> str:
    cells = []
    for name, hit in (("rule", "merged"), ("score", "(anchor OR score >= 6)")):
        cells += [f"count(*) FILTER (label = 'same_control' AND {hit}) AS {name}_tp", f"count(*) FILTER (label = 'different_control' AND {hit}) AS {name}_fp"]
        cells += [f"count(*) FILTER (label = 'different_control' AND NOT {hit}) AS {name}_tn", f"count(*) FILTER (label = 'same_control' AND NOT {hit}) AS {name}_fn"]
    return f"SELECT '{mode}' AS mode, {', '.join(cells)}, count(*) FILTER (label = 'uncertain') AS ambiguous FROM gj_{mode}"


_SELECTS: dict[str, str] = {
    "transfers_window": "SELECT * FROM fx_transfers WHERE block_num BETWEEN 1000 AND 40000",
    "transfers_dedup": """SELECT from_addr, to_addr, value, min(block_num) AS block_num, tx_hash, asset FROM fx_transfers WHERE tx_hash IS NOT NULL AND asset IS NOT NULL AND value IS NOT NULL GROUP BY ALL
  UNION ALL SELECT * FROM fx_transfers WHERE tx_hash IS NULL OR asset IS NULL OR value IS NULL""",
    "transfers_bounded": """SELECT seed, leg AS direction, CAST(row_number() OVER (PARTITION BY seed ORDER BY leg, page, k) AS INT) AS position, CAST(page AS BIGINT) AS page, g.from_addr, g.to_addr, g.value, g.block_num, g.tx_hash, g.asset
  FROM (SELECT seed, leg, page, unnest(got) AS g, unnest(range(len(got))) AS k FROM bst)""",
    "bounded_fetches": """SELECT seed, leg AS direction, CAST(n AS BIGINT) AS n_rows, calls, calls + page_cap::BIGINT AS pages, row_cap, page_cap, peer_cap FROM bfe JOIN (SELECT seed, leg, sum(len(got)) AS n FROM bst GROUP BY ALL) USING (seed, leg)""",
    "address_validation": """SELECT coalesce(regexp_matches(trim(raw), '^0x[0-9a-fA-F]{40}$'), FALSE) AS valid, count(*) AS n, count(DISTINCT CASE WHEN regexp_matches(trim(raw), '^0x[0-9a-fA-F]{40}$') THEN lower(trim(raw)) END) AS n_addresses
  FROM (SELECT unnest([from_addr, to_addr, upper(to_addr), ' ' || to_addr, to_addr[1:40]]) AS raw FROM fx_transfers) GROUP BY ALL""",
    "addresses_upsert": "SELECT address, min(first_seen_block) AS first_seen_block, any_value(label) AS label FROM (SELECT address, first_seen_block, label FROM fx_addresses UNION ALL SELECT to_addr, block_num, NULL FROM fx_transfers) GROUP BY address",
    "ens_latest": "SELECT address, name, CASE WHEN CAST(address[4:] AS BIGINT) % 3 = 0 THEN NULL ELSE twitter END AS twitter, github, telegram FROM fx_ens_records",
    "safe_owner_classified": "SELECT safe_address, owner_address, right(owner_address, 1) IN ('0', '5', '3') AS owner_is_safe, threshold, observed_block, 'safe-tx-service' AS source FROM fx_safe_owners",
    "evidence_scoped_replace": "SELECT address, kind, key, strength, CASE WHEN kind = 'safe_owner' AND CAST(address[4:] AS BIGINT) % 2 = 0 THEN 'fresh' ELSE source END AS source, observed_block, payload_json FROM ev",
    "evidence_insert_ignore": "SELECT address, kind, key, strength, source, observed_block, CAST(NULL AS VARCHAR) AS payload_json FROM fx_evidence_weak WHERE right(key, 1) NOT IN ('1', '2')",
    "hex_block_decode": "SELECT block_hex, CAST(block_hex AS BIGINT) AS block_num, CAST(NULL AS BIGINT) AS bad FROM fx_logs",
    "ens_blank_to_null": "SELECT address, nullif(trim(twitter), '') AS twitter, lower(regexp_replace(trim(telegram), '^@+', '')) AS telegram FROM fx_ens_records",
    "ev_funded_by": "SELECT * FROM ev_fb",
    "ev_ens_handle": "SELECT * FROM ev_ens",
    "ev_did_controller": "SELECT * FROM ev_did",
    "ev_safe_owner": "SELECT * FROM ev_safe",
    "evidence_all": "SELECT * FROM ev",
    "funder_denylist": "SELECT * FROM ev_fb WHERE NOT (key LIKE '0xa%0')",
    "key_fanout_rows": "SELECT kind, key, fan_out FROM keys",
    "key_fanout_addresses": "SELECT kind, key, n_addresses FROM keys",
    "service_keys_legacy": "SELECT kind, key, fan_out FROM keys WHERE fan_out > 50",
    "service_keys_conservative": "SELECT * FROM svc_c",
    "edge_pairs": "SELECT * FROM rows_l",
    "pair_stats": "SELECT * FROM st_c",
    "burst_hits": "SELECT address_a, address_b, burst_hits FROM st_c WHERE burst_hits > 0",
    "merge_edges_legacy": "SELECT * FROM me_l2",
    "merge_edges_conservative": "SELECT * FROM me_c",
    "clusters_conservative": "SELECT * FROM mb",
    "clusters_min_evidence_2": "SELECT * FROM me_l2_cl",
    "clusters_strong_only": "SELECT * FROM me_s_cl",
    "clusters_legacy": "SELECT * FROM me_l1_cl",
    "cluster_shared_keys": "SELECT * FROM shared_c",
    "cluster_sizes": "SELECT * FROM sizes",
    "concentration": """SELECT count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_addresses, round(sum(size) / count(*), 6) AS addresses_per_cluster,
  coalesce((SELECT min(r) FROM (SELECT row_number() OVER w AS r, sum(size) OVER w AS s FROM sizes WINDOW w AS (ORDER BY size DESC, cluster_id ROWS UNBOUNDED PRECEDING)) WHERE s > 0.5 * (SELECT sum(size) FROM sizes)), count(*)) AS nakamoto,
  round(2 * (SELECT sum(r * size) FROM (SELECT size, row_number() OVER (ORDER BY size, cluster_id) AS r FROM sizes)) / (count(*) * sum(size)) - (count(*) + 1) / count(*), 6) AS gini FROM sizes""",
    "run_metrics_row": """SELECT 'run-1' AS run_id, (SELECT count(*) FROM subj) AS address_count, (SELECT count(*) FROM fx_transfers) AS transfer_count, (SELECT count(*) FROM ev) AS evidence_count, count(*) AS cluster_count,
  count(*) FILTER (size > 1) AS multi_cluster_count, (SELECT count(*) FROM svc_c) AS skipped_key_count, max(size) AS largest_cluster FROM sizes""",
    "candidate_pairs": "SELECT DISTINCT address_a, address_b FROM sk",
    "candidate_pairs_capped": "SELECT DISTINCT address_a, address_b FROM sk ORDER BY ALL LIMIT 2000",
    "pairwise_features": "SELECT * REPLACE (round(funder_weight, 6) AS funder_weight, round(owner_jaccard, 6) AS owner_jaccard, round(owner_min_overlap, 6) AS owner_min_overlap) FROM pf2",
    "pairwise_scores": "SELECT address_a, address_b, round(score, 6) AS score, round(probability, 6) AS probability, tier, anchor, structural FROM ps",
    "pairwise_contributions": """SELECT address_a, address_b, 'did_controller_shared' AS channel, 12.0::DOUBLE * shared_did AS weight FROM ps WHERE shared_did > 0 UNION ALL SELECT address_a, address_b, 'safe_owner_min_overlap', round(8.0 * owner_min_overlap, 6) FROM ps WHERE shared_owners > 0
  UNION ALL SELECT address_a, address_b, 'ens_handle_shared', 5.0 FROM ps WHERE shared_ens > 0 UNION ALL SELECT address_a, address_b, 'funded_by_shared_downweighted', round(funder_weight, 6) FROM ps WHERE shared_funders > 0""",
    "tier_histogram": "SELECT tier, count(*) AS n FROM ps GROUP BY tier",
    "passing_edges": "SELECT * FROM pek",
    "cluster_descriptors": """SELECT s.cluster_id, size, CASE WHEN m = 3 THEN 'Controller-level cluster' WHEN o THEN 'Shared-owner governance-control cluster' ELSE 'Evidence-supported cluster' END AS descriptor
  FROM sizes s LEFT JOIN (SELECT cluster_id, max(strength) AS m, bool_or(kind = 'safe_owner') AS o FROM pek GROUP BY ALL) USING (cluster_id)""",
    "passing_keys": "SELECT cluster_id, key, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM pe GROUP BY ALL",
    "top_clusters": "SELECT cluster_id, size FROM sizes ORDER BY size DESC, cluster_id LIMIT 10",
    "graph_identifier_nodes": "SELECT * FROM idn",
    "graph_evidence_nodes": "SELECT * FROM evn",
    "graph_links": f"SELECT identifier_id, evidence_id, kind, {_STRENGTH.format(c='max(strength)')} AS strength, min(observed_block) AS first_seen_block, max(observed_block) AS last_seen_block, count(*) AS attestation_count FROM onn GROUP BY identifier_id, evidence_id, kind",
    "graph_events": f"SELECT identifier_id, evidence_id, kind, {_STRENGTH.format(c='strength')} AS strength, source, observed_block, key AS counterparty, payload_json FROM onn",
    "pairwise_graph_links": """SELECT 'addr:' || address_a AS source, 'addr:' || address_b AS target, tier, round(score, 6) AS score, round(probability, 6) AS probability, anchor FROM
  (SELECT * FROM ps WHERE address_a IN (SELECT address FROM idn) AND address_b IN (SELECT address FROM idn) ORDER BY address_a, address_b LIMIT 2000) WHERE tier <> 'rejected'""",
    "graph_cluster_context": """SELECT i.cluster_id, count(DISTINCT i.id) AS n_identifiers, count(DISTINCT identifier_id || evidence_id) AS n_links, count(DISTINCT evidence_id) AS n_evidence_nodes, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS kinds
  FROM idn i LEFT JOIN onn ON onn.identifier_id = i.id GROUP BY i.cluster_id""",
    "lineage_overlap": "SELECT current_cluster_id, previous_cluster_id, overlap_count, round(jaccard, 6) AS jaccard FROM ovj",
    "lineage_rows": "SELECT 'run-2' AS current_run_id, current_cluster_id, 'run-1' AS previous_run_id, previous_cluster_id, overlap_count, round(jaccard, 6) AS jaccard, transition_label FROM lin",
    "lineage_new_disappeared": "SELECT transition_label, current_cluster_id, previous_cluster_id FROM lin WHERE transition_label IN ('new', 'disappeared')",
    "lineage_label_counts": "SELECT count(*) FILTER (transition_label = 'stable') AS stable, count(*) FILTER (transition_label = 'related') AS related, count(*) FILTER (transition_label = 'new') AS new, count(*) FILTER (transition_label = 'disappeared') AS disappeared, count(*) AS total_rows FROM lin",
    "latest_run_by_profile": """SELECT run_id, chain, policy_profile_id, created_at FROM (SELECT 'run-' || CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS chain, o_orderstatus AS policy_profile_id, o_orderdate AS created_at,
  row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, 'run-' || CAST(o_orderkey AS VARCHAR) DESC) AS n FROM orders) WHERE n = 1""",
    "gold_pairs": "SELECT least(address_a, address_b) AS address_a, greatest(address_a, address_b) AS address_b, label FROM gold, range(2) WHERE address_a <> address_b",
    "gold_endpoints": "SELECT address FROM gends",
    "ablation_counts": """SELECT mode, kind, count(*) AS n FROM ev JOIN (VALUES ('all_evidence', ['funded_by', 'safe_owner', 'ens_handle', 'did_controller']), ('safe_owner_only', ['safe_owner']), ('did_controller_only', ['did_controller']), ('funded_by_only', ['funded_by']),
  ('ens_handle_only', ['ens_handle']), ('safe_owner_and_funded_by', ['safe_owner', 'funded_by']), ('without_ens', ['funded_by', 'safe_owner', 'did_controller'])) m(mode, kinds) ON list_contains(kinds, kind) GROUP BY ALL""",
    "eval_confusion": _confusion("all_evidence"),
    "eval_ablations": " UNION ALL ".join(_confusion(m) for m in _MODES),
    "eval_counts": "SELECT 'all_evidence' AS mode, (SELECT count(DISTINCT cluster_id) FROM gm_all_evidence_cl) AS cluster_count, (SELECT count(*) FROM (SELECT kind, key FROM ge_all_evidence GROUP BY ALL HAVING count(*) > 50)) AS skipped_keys",
    "precision_at_k": """SELECT k, round(hits / k, 6) AS precision FROM (SELECT row_number() OVER w AS k, sum((label = 'same_control')::INT) OVER w AS hits FROM gj_all_evidence WHERE label <> 'uncertain'
  WINDOW w AS (ORDER BY round(score, 6) DESC, address_a, address_b ROWS UNBOUNDED PRECEDING)) WHERE k IN (1, 2, 5, 10, 20, 50, 100)""",
    "log_decode": "SELECT * FROM logd",
    "governance_merge": "SELECT * FROM gov",
    "participants_first_seen": "SELECT * FROM part",
    "control_pool": "SELECT * FROM part WHERE n < 40 AND address <> '0x0000000000000000000000000000000000000000' AND address NOT IN (SELECT address FROM fx_cohort WHERE role = 'governance')",
    "stratified_sample": "SELECT * FROM samp",
    "stratum_counts": "SELECT r.range AS stratum, count(address) AS n FROM range(10) r LEFT JOIN strat ON strat.stratum = r.range GROUP BY ALL",
    "capped_governance": "SELECT * FROM gov ORDER BY first_seen_block, address LIMIT (SELECT CASE WHEN count(*) > 100 THEN 50 ELSE 100 END FROM gov)",
    "pool_hash": "SELECT sha256(string_agg(address || ',' || CAST(first_seen_block AS VARCHAR), chr(10) ORDER BY address || ',' || CAST(first_seen_block AS VARCHAR))) AS pool_sha256 FROM samp",
    "coordination_tier": """SELECT *, CASE WHEN size = 1 THEN CASE WHEN n_control = 1 THEN 'singleton_negative_control_reference' WHEN n_governance = 1 THEN 'singleton_governance_seed' ELSE 'singleton' END
  WHEN n_control = size THEN 'multi_identifier_coordination_control_only' WHEN n_governance = size THEN 'multi_identifier_coordination_governance_only'
  WHEN n_governance > 0 AND n_control > 0 THEN 'multi_identifier_coordination_mixed_governance_and_control' ELSE 'multi_identifier_coordination_candidate' END AS tier FROM cs""",
    "service_dominance": """SELECT s.cluster_id, size, coalesce(k, 0) AS n_keys, coalesce(kept, 0) AS n_kept_keys, size >= 5 AND coalesce(k, 0) > 0 AND coalesce(kept, 0) = 0 AS dominated FROM sizes s LEFT JOIN
  (SELECT cluster_id, count(*) AS k, count(*) FILTER (NOT EXISTS (SELECT 1 FROM svc_c v WHERE v.kind = shared_c.kind AND v.key = shared_c.key)) AS kept FROM shared_c GROUP BY ALL) USING (cluster_id)""",
    "cohort_comparison": """SELECT role, n_addresses, multi_rate, median_cluster_size, coalesce(pure_clusters, 0) AS pure_clusters, coalesce(short_burst, 0) AS short_burst, coalesce(top_funder, 0) AS top_funder, coalesce(common_sink, 0) AS common_sink,
  coalesce(candidate_medium, 0) AS candidate_medium, coalesce(candidate_high, 0) AS candidate_high FROM
  (SELECT role, count(*) AS n_addresses, round(count(*) FILTER (size > 1) / count(*), 6) AS multi_rate, median(size) AS median_cluster_size FROM (SELECT DISTINCT address, role FROM fx_cohort) JOIN mb USING (address) JOIN cs USING (cluster_id) GROUP BY role)
  LEFT JOIN (SELECT role, count(*) AS pure_clusters, count(*) FILTER (b) AS short_burst, count(*) FILTER (f) AS top_funder, count(*) FILTER (k) AS common_sink, count(*) FILTER (b OR f) AS candidate_medium, count(*) FILTER (size >= 3 AND b AND f) AS candidate_high FROM
    (SELECT CASE WHEN n_control = size THEN 'control' ELSE 'governance' END AS role, size, coalesce(funding_block_span <= 5000, FALSE) AS b, coalesce(fs > 0.8, FALSE) AS f, coalesce(ss > 0.8, FALSE) AS k FROM cs JOIN fx0 USING (cluster_id) WHERE size > 1 AND (n_governance = size OR n_control = size)) GROUP BY role) USING (role)""",
    "range_bisection": "SELECT lo AS from_block, hi AS to_block, depth, status, CAST(retries + 1 AS BIGINT) AS calls, CAST(retries AS BIGINT) AS retries FROM rgs",
    "range_counters": """SELECT CAST(sum(retries + 1) AS BIGINT) AS total_calls, CAST(sum(retries) AS BIGINT) AS retries_attempted, CAST(sum(retries) AS BIGINT) AS retried_chunks, count(*) FILTER (status = 'split') AS split_chunks, count(*) FILTER (status = 'failed') AS failed_chunks,
  count(*) FILTER (status = 'fetched') AS fetched_chunks, CAST(0 AS BIGINT) AS pending_chunks, CAST(sum(hi - lo + 1) FILTER (status = 'failed') AS BIGINT) AS failed_blocks FROM rgs""",
    "range_logs": "SELECT kind, address, count(*) AS n, min(b) AS first_block FROM (SELECT o_orderkey AS b, CASE WHEN o_orderkey % 97 = 0 THEN 'proposal' ELSE 'vote' END AS kind, '0xc' || lpad(CAST(o_custkey AS VARCHAR), 39, '0') AS address FROM orders WHERE o_orderkey % 5 = 0) JOIN rgs ON b BETWEEN lo AND hi AND status = 'fetched' GROUP BY ALL",
    "merge_policy_comparison": "SELECT 'legacy' AS policy, count(*) AS clusters, count(*) FILTER (n > 1) AS multi, max(n) AS largest FROM (SELECT cluster_id, count(*) AS n FROM me_l2_cl GROUP BY ALL) UNION ALL SELECT 'conservative', count(*), count(*) FILTER (size > 1), max(size) FROM sizes",
    "fetch_cap_hits": "SELECT count(*) FILTER (row_cap) AS row_cap_hits, count(*) FILTER (page_cap) AS page_cap_hits, count(*) FILTER (peer_cap) AS peer_cap_hits, CAST(sum(calls) AS BIGINT) AS calls, (count(*) FILTER (row_cap) + count(*) FILTER (page_cap) + count(*) FILTER (peer_cap)) / count(DISTINCT seed) > 0.2 AS bias_risk FROM bfe",
    "incremental_clusters": "SELECT cluster_id, address FROM mb WHERE address IN (SELECT address FROM ev)",
    "running_participants": "SELECT address, min(block_num) AS first_block, count(*) AS n, CAST(count(*) >= 20 AS INT) AS crossings FROM (SELECT unnest([from_addr, to_addr]) AS address, block_num FROM fx_transfers) GROUP BY address",
    "baseline_pair_features": "SELECT * FROM bf",
    "baseline_scores": "SELECT * FROM bs",
    "baseline_recommendation": """SELECT address_a, address_b, recommendation, CASE WHEN recommendation = 'related_only' THEN 'weak' WHEN hub_penalty >= 0.5 THEN 'medium' ELSE 'medium_low' END AS confidence,
  CASE WHEN recommendation = 'identity_claim_candidate' AND safe_owner_count > 0 THEN 'control_link_candidate' ELSE '' END AS secondary_signals, hub_penalty < 0.75 AS hub_note, temporal_pattern FROM br
  UNION ALL SELECT address_a, address_b, 'insufficient_evidence', 'none', '', FALSE, 'unknown' FROM zp""",
    "baseline_rankings": " UNION ALL ".join(f"""SELECT '{name}' AS ranking, row_number() OVER (ORDER BY {order}, address_a, address_b) AS place, address_a, address_b
  FROM (SELECT br.*, related_score, control_score, 0.0 AS did_score FROM br JOIN bs USING (address_a, address_b)) WHERE {taken} QUALIFY place <= 20""" for name, (taken, order) in RANKINGS.items() if name != "insufficient_zero")
    + " UNION ALL SELECT 'insufficient_zero', row_number() OVER (ORDER BY address_a, address_b) AS place, address_a, address_b FROM zp QUALIFY place <= 20",
    "baseline_verified": """SELECT address_a, address_b, verified_count, evidence_total, hub_penalty, round(least(0.95, 0.35 * verified_count) * hub_penalty, 4) AS did_score, classes, 'verified_did_or_controller' AS recommendation, 'strong' AS confidence, '' AS secondary_signals FROM vf WHERE verified_count > 0""",
    "baseline_caveats": f"""SELECT recommendation, secondary, text || CASE WHEN secondary <> '' THEN '{ALSO_CONTROL}' ELSE '' END || CASE WHEN hub THEN '{HUB_NOTE.replace("=%.3f", "")}' ELSE '' END AS caveat, count(*) AS n FROM
  (SELECT recommendation, hub_penalty < 0.75 AS hub, CASE WHEN recommendation = 'identity_claim_candidate' AND safe_owner_count > 0 THEN 'control_link_candidate' ELSE '' END AS secondary FROM br)
  JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in CAVEATS.items())}) v(recommendation, text) USING (recommendation) GROUP BY ALL""".replace("secondary,", "secondary AS secondary_signals,", 1),
    "baseline_zero_pairs": "SELECT address_a, address_b, CAST(1.0 AS DOUBLE) AS hub_penalty, CAST(0 AS BIGINT) AS evidence_total FROM zp",
    "baseline_diagnostics": """SELECT count(*) + (SELECT z FROM zn) AS pair_count, (SELECT z FROM zn) AS pairs_with_no_evidence, count(*) FILTER (funded_by_count > 0) AS pairs_with_funded_by, count(*) FILTER (funded_by_count > 0 AND safe_owner_count = 0 AND identity_count = 0) AS pairs_with_funded_by_only,
  count(*) FILTER (safe_owner_count > 0) AS pairs_with_safe_owner, count(*) FILTER (identity_count > 0) AS pairs_with_identity, CAST(0 AS BIGINT) AS pairs_with_verified, (SELECT z FROM zn) AS insufficient_without_evidence, CAST(0 AS BIGINT) AS insufficient_with_evidence,
  count(*) FILTER (safe_owner_count > 0 AND recommendation = 'control_link_candidate') AS safe_owner_as_control_link, count(*) FILTER (safe_owner_count > 0 AND recommendation <> 'control_link_candidate') AS safe_owner_not_control_link,
  count(*) FILTER (safe_owner_count > 0 AND recommendation = 'identity_claim_candidate') AS identity_with_secondary_control, count(*) FILTER (funded_by_count > 0 AND safe_owner_count = 0 AND identity_count = 0) AS funded_only_as_related_only,
  CAST(0 AS DOUBLE) AS max_did_score, count(*) FILTER (hub_penalty < 0.5) AS hub_penalty_lt_0_5, count(*) FILTER (hub_penalty < 0.75) AS hub_penalty_lt_0_75, count(*) FILTER (temporal_pattern = 'unknown') + (SELECT z FROM zn) AS temporal_unknown,
  count(*) FILTER (temporal_pattern = 'same_block') AS temporal_same_block, count(*) FILTER (temporal_pattern = 'short_burst') AS temporal_short_burst, count(*) FILTER (temporal_pattern = 'long_span') AS temporal_long_span FROM br""",
    "hub_quantiles": "SELECT CAST(len(v) AS BIGINT) AS n, round(v[1], 4) AS min, round(v[len(v) // 4 + 1], 4) AS p25, round(v[len(v) // 2 + 1], 4) AS median, round(v[3 * len(v) // 4 + 1], 4) AS p75, round(v[len(v)], 4) AS max FROM (SELECT list(hub_penalty ORDER BY hub_penalty) AS v FROM (SELECT hub_penalty FROM bf UNION ALL SELECT 1.0 FROM zp))",
    "baseline_gold_matrix": """SELECT label, coalesce(recommendation, CASE WHEN zp.address_a IS NULL THEN 'missing' ELSE 'insufficient_evidence' END) AS recommendation, count(*) AS n
  FROM gold LEFT JOIN br USING (address_a, address_b) LEFT JOIN zp USING (address_a, address_b) GROUP BY ALL""",
    "cf_funding": "SELECT * FROM cff",
    "cf_first_funder": """SELECT cluster_id, max(n) AS first_funder_shared_count FROM (SELECT cluster_id, f, count(*) AS n FROM (SELECT lower(to_addr) AS address, lower(from_addr) AS f, row_number() OVER (PARTITION BY lower(to_addr) ORDER BY block_num, coalesce(tx_hash, ''), lower(from_addr)) AS r
  FROM fx_transfers WHERE block_num IS NOT NULL) JOIN mb USING (address) WHERE r = 1 GROUP BY ALL) GROUP BY ALL""",
    "cf_sinks": "SELECT * FROM csk",
    "cf_control_density": "SELECT * FROM cct",
    "cf_identity": """SELECT i.cluster_id, num_identifiers, coalesce(num_evidence_rows, 0) AS num_evidence_rows, coalesce(ens_count, 0) AS ens_count, coalesce(did_count, 0) AS did_count, CAST(0 AS BIGINT) AS verified_did_count, FALSE AS did_verified_present FROM
  (SELECT cluster_id, count(*) AS num_identifiers FROM (SELECT cluster_id, address FROM mb UNION SELECT cluster_id, CASE WHEN starts_with(trim(key), '0x') THEN lower(trim(key)) ELSE trim(key) END FROM ce WHERE kind IN ('ens_handle', 'did_controller') AND trim(key) <> '') GROUP BY ALL) i
  LEFT JOIN (SELECT cluster_id, count(*) AS num_evidence_rows, count(*) FILTER (kind = 'ens_handle') AS ens_count, count(*) FILTER (kind = 'did_controller') AS did_count FROM ce GROUP BY ALL) USING (cluster_id)""",
    "cf_token_overlap": """SELECT s.cluster_id, coalesce(c.k, 0) AS contract_addresses, c.o AS contract_overlap, coalesce(m.k, 0) AS method_addresses, m.o AS method_overlap FROM sizes s
  LEFT JOIN (SELECT * FROM "to" WHERE f = 'contract') c USING (cluster_id) LEFT JOIN (SELECT * FROM "to" WHERE f = 'method') m USING (cluster_id)""",
    "cf_tiers": "SELECT cluster_id, tier, reasons FROM tiers",
    "audit_kinds": "SELECT kind, count(*) AS n, CASE kind WHEN 'funded_by' THEN 'event_evidence' WHEN 'safe_owner' THEN 'control_evidence' ELSE 'identity_claim' END AS semantic_class, kind IN ('funded_by', 'safe_owner') AS directed FROM ev GROUP BY kind",
    "audit_sources": "SELECT source, count(*) AS n FROM ev GROUP BY source ORDER BY n DESC, source LIMIT 200",
    "audit_duplication": """SELECT count(*) AS raw_rows, count(DISTINCT address || '|' || key) AS unique_pairs, count(DISTINCT address || '|' || kind || '|' || key) AS unique_pair_kinds, count(DISTINCT source) AS unique_sources, CAST(0 AS BIGINT) AS unique_tx_hashes,
  round(count(*) / count(DISTINCT address || '|' || key), 6) AS rows_per_pair, round(count(*) / count(DISTINCT address || '|' || kind || '|' || key), 6) AS rows_per_pair_kind FROM ev""",
    "audit_temporal": "SELECT count(*) FILTER (observed_block > 0) > 0 AS has_block_number, min(observed_block) FILTER (observed_block > 0) AS min_block, max(observed_block) FILTER (observed_block > 0) AS max_block, FALSE AS has_timestamp, CAST(NULL AS VARCHAR) AS min_timestamp, CAST(NULL AS VARCHAR) AS max_timestamp FROM ev",
    "audit_readiness": "SELECT count(*) > 0 AS relatedness, bool_or(kind = 'safe_owner') AS control_link, bool_or(kind IN ('ens_handle', 'did_controller')) AS identity_claim, FALSE AS same_controller, bool_and(kind = 'funded_by') AS event_only FROM ev",
    "audit_table_rows": "SELECT 'addresses' AS \"table\", count(*) AS n FROM fx_addresses UNION ALL SELECT 'transfers', count(*) FROM fx_transfers UNION ALL SELECT 'ens_records', count(*) FROM fx_ens_records UNION ALL SELECT 'safe_owners', count(*) FROM fx_safe_owners UNION ALL SELECT 'evidence', count(*) FROM ev UNION ALL SELECT 'entity_clusters', count(*) FROM subj",
    "audit_gold_profile": "SELECT label, count(*) AS n FROM gold GROUP BY label",
    "diag_top_keys": "SELECT kind, key, fan_out AS attestations FROM keys ORDER BY fan_out DESC, kind, key LIMIT 25",
    "diag_top_addresses": "SELECT address, count(*) AS attestations FROM ev GROUP BY address ORDER BY attestations DESC, address LIMIT 20",
    "diag_strength": "SELECT strength, count(*) AS n FROM ev GROUP BY strength",
    "diag_fanout_histogram": "SELECT n_addresses AS addresses_per_key, count(*) AS n_keys FROM keys GROUP BY ALL",
}


def _with(select: str) -> str:
    """``select`` behind the expressions it needs, in the order of their definition."""
    words = {name: set(re.findall(r"[a-z_0-9]+", sql)) for name, sql in CTES.items()}
    need, todo = set(), set(re.findall(r"[a-z_0-9]+", select)) & set(CTES)
    while todo:
        name = todo.pop()
        need.add(name)
        todo |= (words[name] & set(CTES)) - need
    parts = [f'"{name}" AS ({sql.strip()})' for name, sql in CTES.items() if name in need]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + select


ORACLES = {name: _with(select) for name, select in _SELECTS.items()}
