"""The benchmark tables as domain tables: SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: One query per domain table, over the names of the base tables.
FIXTURES = {
    "addresses": """
select concat('0xc', lpad(cast(c_custkey as string), 39, '0')) as address,
       min(o_orderkey) as first_seen_block, c_mktsegment as label
from customer left join orders on o_custkey = c_custkey
group by c_custkey, c_mktsegment
""",
    "transfers": """
select concat('0xa', lpad(cast(l_partkey as string), 39, '0')) as from_addr,
       concat('0xc', lpad(cast(o_custkey as string), 39, '0')) as to_addr,
       cast(cast(round(l_extendedprice * 100) as bigint) as string) as value,
       case when l_orderkey % 10 = 0 then null else l_orderkey end as block_num,
       concat('0x1', lpad(cast(l_orderkey * 100 + l_linenumber as string), 63, '0')) as tx_hash, 'ERC20' as asset
from lineitem join orders on l_orderkey = o_orderkey
where l_returnflag = 'R' and l_linestatus = 'F' and o_orderstatus = 'F'
union all
select '0x0000000000000000000000000000000000000000', concat('0xc', lpad(cast(o_custkey as string), 39, '0')),
       '1', o_orderkey, concat('0x2', lpad(cast(o_orderkey as string), 63, '0')), 'MINT'
from orders where o_orderkey % 40 = 0
union all
select '0x28c6c06298d514db089934071355e5743bf21d60', concat('0xc', lpad(cast(o_custkey as string), 39, '0')),
       '1', o_orderkey, cast(null as string), 'ETH'
from orders where o_orderkey % 50 = 1
union all
select concat('0xb', lpad(cast(cast(floor(c_custkey / 3) as bigint) as string), 39, '0')),
       concat('0xc', lpad(cast(c_custkey as string), 39, '0')), '5', 1000000 + 3000 * c_custkey,
       concat('0x4', lpad(cast(c_custkey as string), 63, '0')), 'ETH'
from customer
union all
select concat('0x9', lpad(cast(cast(floor(c_custkey / 5) as bigint) as string), 39, '0')),
       concat('0xc', lpad(cast(c_custkey as string), 39, '0')), '7', 1000000 + 3000 * c_custkey,
       concat('0x5', lpad(cast(c_custkey as string), 63, '0')), 'ETH'
from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0
union all
select concat('0xc', lpad(cast(o_custkey as string), 39, '0')),
       concat('0x8', lpad(cast(cast(floor(o_custkey / 3) as bigint) as string), 39, '0')), '9', o_orderkey,
       concat('0x6', lpad(cast(o_orderkey as string), 63, '0')), 'ETH'
from orders where o_orderkey % 3 = 0
union all
select concat('0xc', lpad(cast(o_custkey as string), 39, '0')),
       concat('0xd', lpad(cast(l_suppkey as string), 39, '0')), '2', l_orderkey,
       concat('0x7', lpad(cast(l_orderkey as string), 63, '0')), 'ERC20'
from lineitem join orders on l_orderkey = o_orderkey
where l_returnflag = 'A' and l_linestatus = 'F' and l_linenumber = 1
union all
select concat('0xb', lpad(cast(cast(floor(c_custkey / 3) as bigint) as string), 39, '0')),
       concat('0xc', lpad(cast(c_custkey as string), 39, '0')), '5', 1000000 + 3000 * c_custkey,
       concat('0x4', lpad(cast(c_custkey as string), 63, '0')), 'ETH'
from customer where c_custkey % 10 = 0
""",
    "ens_records": """
select concat('0xc', lpad(cast(c_custkey as string), 39, '0')) as address,
       concat(lower(c_mktsegment), '-', cast(c_custkey as string), '.eth') as name,
       case when c_custkey % 4 = 0 then concat(' @User', cast(cast(floor(c_custkey / 8) as bigint) as string))
            when c_custkey % 4 = 2 then '   ' end as twitter,
       case when c_acctbal < 0 then concat(upper(c_mktsegment), cast(c_nationkey as string)) end as github,
       case when c_custkey % 6 = 0 then concat('@@tg', cast(cast(floor(c_custkey / 12) as bigint) as string)) end as telegram
from customer where c_custkey % 2 = 0
""",
    "safe_owners": """
select concat('0xc', lpad(cast(o_custkey as string), 39, '0')) as safe_address,
       concat('0xd', lpad(cast(l_suppkey as string), 39, '0')) as owner_address,
       l_suppkey % 5 = 0 as owner_is_safe, 1 + o_custkey % 4 as threshold, min(l_orderkey) as observed_block,
       case when o_custkey % 2 = 0 then 'safe-tx-service' else 'manual' end as source
from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey
where c_mktsegment = 'MACHINERY' and l_linenumber = 1 and l_quantity >= 40
group by o_custkey, l_suppkey
""",
    "did_documents": """
select concat('did:ethr:0xc', lpad(cast(c_custkey as string), 39, '0')) as did,
       concat('0xc', lpad(cast(c_custkey as string), 39, '0')) as subject_address,
       case when c_acctbal < 0
            then concat('0xe', lpad(cast(c_nationkey * 100 + length(c_mktsegment) as string), 39, '0'))
            else concat('0xc', lpad(cast(c_custkey as string), 39, '0')) end as controller,
       'ethr' as method, cast(null as string) as document_json, 100 + c_custkey as observed_block, 'fixture' as source
from customer where c_acctbal < 100
union all
select concat('did:ethr:scroll:0xc', lpad(cast(c_custkey as string), 39, '0')),
       concat('0xc', lpad(cast(c_custkey as string), 39, '0')),
       concat('0xe', lpad(cast(c_nationkey * 100 + length(c_mktsegment) as string), 39, '0')),
       'ethr', cast(null as string), case when c_custkey % 4 = 0 then null else 200 + c_custkey end, 'fixture2'
from customer where c_acctbal < 0 and c_custkey % 2 = 0
""",
    "evidence_weak": """
select concat('0xc', lpad(cast(user_id as string), 39, '0')) as address, 'ens_handle' as kind,
       concat(event_type, ':', regexp_extract(props, '[0-9]+', 0)) as key, 1 as strength,
       concat('events@', cast(event_id % 3 as string)) as source, min(event_id) as observed_block
from events group by user_id, event_type, regexp_extract(props, '[0-9]+', 0), event_id % 3
""",
    "evidence_verified": """
select concat('0xc', lpad(cast(c_custkey as string), 39, '0')) as address,
       case when c_custkey % 2 = 0 then 'did_controller_verified' else 'signature_verified' end as kind,
       concat('0xf', lpad(cast(c_nationkey * 10 + c_custkey % 4 as string), 39, '0')) as key,
       3 as strength, 'attestation' as source, c_custkey as observed_block
from customer where c_custkey % 3 = 0
""",
    "cohort": """
select concat('0xc', lpad(cast(c_custkey as string), 39, '0')) as address,
       case when c_custkey % 4 = 0 then 'governance' else 'control' end as role
from customer where c_custkey % 4 in (0, 1)
""",
    "gold": """
select concat('0xc', lpad(cast(c_custkey as string), 39, '0')) as address_a,
       concat('0xc', lpad(cast(c_custkey + 1 as string), 39, '0')) as address_b,
       case when c_custkey % 50 = 0 then 'uncertain'
            when floor(c_custkey / 3) = floor((c_custkey + 1) / 3) then 'same_control'
            else 'different_control' end as label
from customer where c_custkey % 10 in (0, 3, 7)
""",
    "logs": """
select concat('0x', lower(hex(o_orderkey))) as block_hex,
       case when o_orderkey % 97 = 0 then 'proposal' else 'vote' end as topic0,
       concat('0x', lpad(concat('c', lpad(cast(o_custkey as string), 39, '0')), 64, '0')) as topic1,
       concat('0x', lpad(cast(o_orderkey as string), 64, '0'),
              lpad(concat('c', lpad(cast(o_custkey as string), 39, '0')), 64, '0')) as data
from orders where o_orderkey % 5 = 0
""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, straight over the scans of the base tables it names."""
    query, frames = FIXTURES[name], {}
    for table in BASE_TABLES:
        query, n = re.subn(rf"\b(from|join) {table}\b", rf"\1 {{{table}}}", query)
        if n:
            frames[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(query, **frames)
