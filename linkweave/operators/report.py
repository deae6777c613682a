"""What a run's report shows: passing edges and keys, descriptors, and their renderings."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.functions.scalar import strength_label
from linkweave.operators.linking import merges, shared_rows
from linkweave.operators.metrics import cluster_sizes, concentration
from linkweave.runtime import checkpoint
from linkweave.schemas import BOUNDARY, LEGACY, STRONG, MergePolicy

TOP_CLUSTERS, TOP_SERVICE_KEYS = 10, 20


def passing_edges(evidence: DataFrame, members: DataFrame, *, min_evidence: int = 1, policy: MergePolicy = LEGACY) -> DataFrame:
    """(cluster_id, source, target, kind, keys, strength): per pair of one cluster that passes the rule, its kinds.

    One pass over the shared rows: kinds are aggregated per pair first and the pair's totals
    come from those few rows, so the rows are not joined with their own totals.
    """
    funded = F.col("kind") == "funded_by"
    per_kind = shared_rows(evidence, policy).groupBy("address_a", "address_b", "kind").agg(
        F.count("*").alias("n"), F.max("strength").alias("strength"), F.array_sort(F.collect_set("key")).alias("keys"), F.count_if(funded & (F.col("block_delta") <= policy.burst_blocks)).alias("bursts")
    )
    entry = F.struct("kind", "n", "strength", "keys", "bursts")
    other = ~funded
    pairs = per_kind.groupBy("address_a", "address_b").agg(
        F.sum("n").alias("n_edges"),
        F.max("strength").alias("max_strength"),
        F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)).alias("nf_edges"),
        F.coalesce(F.max(F.when(other, F.col("strength"))), F.lit(1)).alias("nf_max"),
        F.coalesce(F.sum(F.when(funded, F.size("keys"))), F.lit(0)).alias("funded_keys"),
        F.sum("bursts").alias("burst_hits"),
        F.collect_list(entry).alias("kinds"),
    )
    label = lambda side: members.select(F.col("address").alias(f"address_{side}"), F.col("cluster_id").alias(f"cluster_{side}"))
    inside = pairs.where(merges(policy, min_evidence)).join(label("a"), "address_a").join(label("b"), "address_b").where("cluster_a = cluster_b")
    return inside.select(F.col("cluster_a").alias("cluster_id"), F.col("address_a").alias("source"), F.col("address_b").alias("target"), F.explode("kinds").alias("e")).select("cluster_id", "source", "target", "e.kind", "e.keys", "e.strength")


def cluster_descriptors(members: DataFrame, edges: DataFrame) -> DataFrame:
    """A phrase per cluster, by the evidence that passed in it."""
    facts = edges.groupBy("cluster_id").agg(F.max("strength").alias("s"), F.bool_or(F.col("kind") == "safe_owner").alias("owner"))
    phrase = F.when(F.col("s") == STRONG, "Controller-level cluster").when(F.col("owner"), "Shared-owner governance-control cluster").otherwise("Evidence-supported cluster")
    return cluster_sizes(members).join(facts, "cluster_id", "left").select("cluster_id", "size", phrase.alias("descriptor"))


def passing_keys(edges: DataFrame) -> DataFrame:
    """(cluster_id, key, kinds) of the keys on passing edges."""
    return edges.select("cluster_id", "kind", F.explode("keys").alias("key")).groupBy("cluster_id", "key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def top_clusters(members: DataFrame, n: int = 3) -> DataFrame:
    return cluster_sizes(members).orderBy(F.desc("size"), "cluster_id").limit(n)


#: Columns that order the lines of a text; all texts below are rows with them.
ORDER = ("section", "a", "part", "b", "c", "d")
_LINE = "section int, a bigint, part int, b string, c string, d string, line string"


def _fixed(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    """Lines that the driver knows, in their order."""
    return spark.createDataFrame([(section, n, 0, "", "", "", line) for n, line in enumerate(lines)], _LINE)


def _lines(rows: DataFrame, section: int, line: Column, *, a: Column | None = None, part: int | Column = 0, b: Column | None = None, c: Column | None = None, d: Column | None = None) -> DataFrame:
    blank = F.lit("")
    values = (F.lit(section), F.lit(0) if a is None else a, part if isinstance(part, Column) else F.lit(part), b if b is not None else blank, c if c is not None else blank, d if d is not None else blank, line)
    kinds = ("int", "bigint", "int", "string", "string", "string", "string")
    return rows.select(*[v.cast(k).alias(n) for v, k, n in zip(values, kinds, (*ORDER, "line"), strict=True)])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def text_of(lines: DataFrame) -> str:
    """A text that fits the driver, for printing."""
    return "".join(f"{r['line']}\n" for r in lines.orderBy(*ORDER).collect())


def write_ordered(lines: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """The text in a folder: executors sort and write ranges of it, and its parts in the order of their names are the text."""
    lines.orderBy(*ORDER).select("line").write.mode(mode).text(folder)


def numbered(rows: DataFrame, key: str, into: str) -> DataFrame:
    """``rows``, one of each key, with their places in its order from 0.

    Ranges of the key are numbered on their own; only the sizes of the ranges are added up in
    one place. The rows are written once, as ranges may fall elsewhere when they are made again.
    """
    ranged = checkpoint(rows.repartitionByRange(key).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("__range")) - F.col("n")).select("__range", "before")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranged.join(F.broadcast(before), "__range").withColumn(into, (F.col("before") + place).cast("bigint")).drop("__range", "before")


def _in_order(rows: DataFrame, order: list[Column], into: str) -> DataFrame:
    return rows.withColumn(into, F.row_number().over(Window.orderBy(*order)) - 1)


def markdown_lines(run: dict, evidence: DataFrame, members: DataFrame, services: DataFrame, *, min_evidence: int = 1, policy: MergePolicy = LEGACY, threshold: float = 0.5) -> DataFrame:
    """Report of one run: totals, the largest clusters with what links them, suspected service keys.

    The driver takes the totals, the heads of the largest clusters and the largest service keys;
    keys and members of those clusters, however many, stay rows.
    """
    spark = members.sparkSession
    sizes = checkpoint(cluster_sizes(members))
    edges = checkpoint(passing_edges(evidence, members, min_evidence=min_evidence, policy=policy))
    top = checkpoint(_in_order(sizes.where("size > 1").orderBy(F.desc("size"), "cluster_id").limit(TOP_CLUSTERS), [F.desc("size"), F.col("cluster_id")], "place"))
    chosen = top.select("cluster_id", "place")
    own = members.join(F.broadcast(chosen), "cluster_id")
    keys = passing_keys(edges.join(F.broadcast(chosen.select("cluster_id")), "cluster_id", "left_semi")).join(F.broadcast(chosen), "cluster_id")
    phrases = cluster_descriptors(own.select("cluster_id", "address"), edges).join(F.broadcast(chosen), "cluster_id").orderBy("place").collect()
    with_keys = {r["place"] for r in keys.select("place").distinct().collect()}
    totals, multi = concentration(sizes, threshold).first().asDict(), sizes.where("size > 1").count()

    head = ["# Evidence linking report", "", f"Run `{run['run_id']}`, started {run['started_at']}, parameters `{run['params_json']}`.", "", "## Summary", ""]
    head += [f"- Identifiers analyzed: **{totals['n_addresses'] or 0}**", f"- Inferred clusters: **{totals['n_clusters']}**"]
    if totals["addresses_per_cluster"] is not None:
        head += [f"- Identifiers per cluster: **{totals['addresses_per_cluster']:.2f}**", f"- Nakamoto coefficient (more than {threshold:.0%}): **{totals['nakamoto']}**", f"- Gini coefficient: **{totals['gini']:.3f}**"]
    head += ["", "## Top Clusters", ""] + ([] if phrases else ["_No cluster has more than one identifier._", ""])
    titles: list[tuple[int, int, int, str]] = []
    for r in phrases:
        n = r["place"]
        titles += [(n, 0, 0, f"### {r['descriptor']} — `{_short(r['cluster_id'])}` ({r['size']} identifiers)"), (n, 0, 1, "")]
        titles += [(n, 1, 0, "Evidence keys on passing edges:"), (n, 3, 0, "")] if n in with_keys else []
        titles += [(n, 4, 0, "Members:"), (n, 6, 0, "")]
    heads = spark.createDataFrame([(1, n, part, str(k), "", "", line) for n, part, k, line in titles], _LINE)
    key_lines = _lines(keys, 1, F.concat(F.lit("- `"), "key", F.lit("` ("), F.array_join("kinds", ", "), F.lit(")")), a=F.col("place"), part=2, b=F.col("key"))
    member_lines = _lines(own, 1, F.concat(F.lit("- `"), "address", F.lit("`")), a=F.col("place"), part=5, b=F.col("address"))
    shown = services.orderBy(F.desc("fan_out"), "kind", "key").limit(TOP_SERVICE_KEYS).collect()
    foot = [f"_{multi - len(phrases)} more clusters have several identifiers._", ""] if multi > len(phrases) else []
    if shown:
        foot += ["## Suspected Service Keys", "", "| Kind | Key | Fan-out |", "|---|---|---|", *[f"| `{s['kind']}` | `{s['key']}` | {s['fan_out']} |" for s in shown], ""]
    foot += ["## Reproducibility", "", "A cluster's id is its smallest address; the same evidence and parameters give the same clusters.", "", BOUNDARY]
    return _all([_fixed(spark, 0, head), heads, key_lines, member_lines, _fixed(spark, 2, foot)])


def render_markdown(run: dict, evidence: DataFrame, members: DataFrame, services: DataFrame, **settings: object) -> str:
    return text_of(markdown_lines(run, evidence, members, services, **settings))


def json_lines(run: dict, members: DataFrame, services: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The run as one JSON object over several lines, a service key a line."""
    spark, totals = members.sparkSession, concentration(cluster_sizes(members), threshold).first().asDict()
    entry = numbered(services.select(F.to_json(F.struct("kind", "key", "fan_out")).alias("entry"), F.to_json(F.array("kind", "key")).alias("by")), "by", "n")
    head = ["{", f'"run": {json.dumps(run, default=str)},', *[f"{json.dumps(k)}: {json.dumps(v)}," for k, v in totals.items()], '"service_keys": [']
    rows = _lines(entry, 1, F.concat(F.when(F.col("n") == 0, "").otherwise(","), "entry"), a=F.col("n"))
    return _all([_fixed(spark, 0, head), rows, _fixed(spark, 2, ["],", f'"boundary": {json.dumps(BOUNDARY)}', "}"])])


def report_json(run: dict, members: DataFrame, services: DataFrame, threshold: float = 0.5) -> str:
    return text_of(json_lines(run, members, services, threshold))


def _short(value: str) -> str:
    return f"{value[:6]}…{value[-4:]}" if len(value) >= 12 else value


def _short_of(c: Column) -> Column:
    return F.when(F.length(c) >= 12, F.concat(F.substr(c, F.lit(1), F.lit(6)), F.lit("…"), F.right(c, F.lit(4)))).otherwise(c)


def _quoted(c: Column) -> Column:
    """A DOT string."""
    escaped = c
    for plain, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(safe))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _comment(c: Column) -> Column:
    return F.translate(c, "\n\r", "  ")


def dot_lines(run: dict, evidence: DataFrame, members: DataFrame, services: DataFrame, *, min_evidence: int = 1, policy: MergePolicy = LEGACY) -> DataFrame:
    """A Graphviz graph of clusters and passing edges, in a fixed order; clusters are numbered by their ids."""
    spark, text = members.sparkSession, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    edges = checkpoint(passing_edges(evidence, members, min_evidence=min_evidence, policy=policy))
    known = numbered(cluster_descriptors(members, edges), "cluster_id", "number")
    plain = lambda value: str(value).replace("\n", " ").replace("\r", " ")
    head = ["graph linkweave {", "  rankdir=LR;", "  node [shape=box];", *[f"  // {k}: {plain(v)}" for k, v in run.items()], f"  // {BOUNDARY}"]
    noun = F.when(F.col("size") == 1, " identifier)").otherwise(" identifiers)")
    label = _quoted(text(F.col("descriptor"), " ", _short_of(F.col("cluster_id")), " (", F.col("size").cast("string"), noun))
    number = F.col("number")
    clusters = [
        _lines(known, 1, text("  subgraph cluster_", number.cast("string"), " {"), a=number, part=0),
        _lines(known, 1, text("    label=", label, ";"), a=number, part=1),
        _lines(members.join(known.select("cluster_id", "number"), "cluster_id"), 1, text("    ", _quoted(F.col("address")), " [label=", _quoted(_short_of(F.col("address"))), "];"), a=number, part=2, b=F.col("address")),
        _lines(known, 1, F.lit("  }"), a=number, part=3),
    ]
    keys = F.array_join(F.transform("keys", _short_of), ", ")
    named = _quoted(text(F.col("kind"), " ", strength_label(F.col("strength")), ": ", keys))
    drawn = _lines(edges, 2, text("  ", _quoted(F.col("source")), " -- ", _quoted(F.col("target")), " [label=", named, "];"), b=F.col("source"), c=F.col("target"), d=F.col("kind"))
    suppressed = _lines(services, 3, text("  // service key ", _comment(F.col("kind")), " ", _comment(F.col("key")), ": ", F.col("fan_out").cast("string"), " rows"), a=-F.col("fan_out"), b=F.col("kind"), c=F.col("key"))
    return _all([_fixed(spark, 0, head), *clusters, drawn, suppressed, _fixed(spark, 4, ["}"])])


def render_dot(run: dict, evidence: DataFrame, members: DataFrame, services: DataFrame, *, min_evidence: int = 1, policy: MergePolicy = LEGACY) -> str:
    return text_of(dot_lines(run, evidence, members, services, min_evidence=min_evidence, policy=policy))


def write_text(path: str, text: str) -> None:
    """A driver-side file that appears whole or not at all."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.part", path)


def dump(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, default=str)

