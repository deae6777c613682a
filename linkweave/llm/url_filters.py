"""URL filters by a sort-merge range join, in DataFrame functions only.

A host's canonical key is its labels in reverse, each followed by a dot, so a rule's host and
all subdomains of it are one interval of keys, and intervals of different rules are nested or
apart. Rules become boundary events that carry the stack of rules active from there on; urls
are sorted together with the events, and the last event at or before a url's key is its
stack. Of the stack's rules whose path begins the url's path, the longest wins.

The keys are cut into ranges of about ``block`` events each, with the stack that is active where
the range begins, so rules of any number are swept in bounded pieces. The urls of a range are
dealt round robin over as many partitions as their share of all urls asks for, and only that
range's events are repeated into those, so a host with most of the urls is spread evenly.

Paths are a second level of the same kind where a host has more than ``INLINE`` rules: its rules are
left out of the stacks, which only name it, and each url below it is swept once more by (that
host, path), where a rule's path is an interval of the paths that it begins. An event there
carries the one rule that wins from it on, so a host of a million rules costs a url no more than
a host of one.

Defined cases: a null url or one without ``://`` has an empty host and path and no rule; an
empty path fits no rule; ports and user names count as part of the host; rules with a null
host or path are ignored; of equal rules block wins; no rules leave every url to the default;
repeated urls are judged alike; other columns of the urls are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.runtime import checkpoint, shuffle_partitions

#: Boundary events of one range of keys, about: two for each distinct host of the rules.
BLOCK = 65_536

#: Rules of a host that its stacks carry; a host of more is swept by path.
INLINE = 1024

_RULE = "struct<size:int,host_size:int,block:int,path:string,rule:string,verdict:string>"
_STACK = "array<struct<size:int,host_size:int,block:int,path:string,rule:string,verdict:string>>"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.substring_index(F.substring_index(F.substr(url, at + 3), "#", 1), "?", 1)
    slash = F.locate("/", rest)
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))
    has = F.coalesce(at > 0, F.lit(False))
    return F.when(has, lower).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _rule() -> Column:
    """A rule as it is compared: the longest wins, then the longer host, then block."""
    return F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").cast("int").alias("block"), "path", F.concat("host", "path").alias("rule"), "verdict").cast(_RULE)


def boundaries(rules: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """(key, stack): the rules active from ``key`` on, for rules (host, path, verdict).

    A rule host's stack is its own rules and those of its suffixes; a closing boundary brings
    back the stack of the nearest suffix that has rules. Hosts of ``wide`` have no rules there but
    are themselves named, as a rule without a path.
    """
    own = rules.groupBy("host").agg(F.collect_set(_rule()).alias("own"))
    if wide is not None:
        named = F.array(F.struct(F.lit(-1), F.lit(-1), F.lit(-1), F.lit(None).cast("string"), F.col("host"), F.lit(None).cast("string")).cast(_RULE))
        own = own.join(wide, "host", "left_anti").unionByName(wide.select("host", named.alias("own")))
    labels = F.split("host", r"\.")
    suffixes = own.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    held = own.select(F.col("host").alias("suffix"), "own")
    nested = suffixes.join(held, "suffix").groupBy("host").agg(
        F.flatten(F.collect_list("own")).alias("all"),
        F.flatten(F.collect_list(F.when(F.col("suffix") != F.col("host"), F.col("own")))).alias("outer"),
    )
    first = lambda stack: F.sort_array(stack, asc=False).cast(_STACK)
    opens = nested.select(host_key(F.col("host")).alias("key"), first(F.col("all")).alias("stack"))
    closes = nested.select(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("/")).alias("key"), first(F.col("outer")).alias("stack"))
    return opens.union(closes)


def path_key(host: Column, path: Column) -> Column:
    """Host, then the path's bytes in hexadecimal digits, so that a closing ``G`` comes after all that begins alike."""
    return F.concat(host, F.lit("/"), F.hex(F.encode(path, "UTF-8")))


def path_boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): the one rule that wins from ``key`` on among the paths of one host, in an array.

    Behind the end of a rule's paths that is the rule of its longest prefix, found by a join of
    all prefixes, or none.
    """
    one = rules.groupBy("host", "path").agg(F.max(_rule()).alias("r"))
    prefixes = one.select("host", F.col("path").alias("longer"), F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n")).select("host", "longer", F.substr("longer", F.lit(1), F.col("n")).alias("path")).where("path <> longer")
    around = prefixes.join(one, ["host", "path"]).groupBy("host", F.col("longer").alias("path")).agg(F.max("r").alias("outer"))
    closed = one.select("host", "path").join(around, ["host", "path"], "left")
    array = lambda c: F.when(c.isNull(), F.array().cast(_STACK)).otherwise(F.array(c))
    opens = one.select(path_key(F.col("host"), F.col("path")).alias("key"), F.array("r").alias("stack"))
    return opens.union(closed.select(F.concat(path_key(F.col("host"), F.col("path")), F.lit("G")).alias("key"), array(F.col("outer")).alias("stack")))


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted ``bounds`` are at or below ``key``, by halving."""
    if not bounds:
        return F.lit(0)
    known = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(known, F.least(at + step, F.lit(len(bounds)))) <= key), at + step).otherwise(at))


def _sweep(asked: DataFrame, events: DataFrame, block: int) -> DataFrame:
    """``asked`` (with a ``key``) with ``active``: the stack of the last event at or before its key."""
    spark = asked.sparkSession
    ranges, bounds = max(1, -(-events.count() // block)), []
    if ranges > 1:
        dealt = events.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("n")).agg(F.min("key").alias("least"))
        # one key for each range, whose number is that of the rules by ``block``
        bounds = sorted(r["least"] for r in dealt.collect())[1:]
    columns = asked.columns
    asked = asked.withColumn("range", _range_of(F.col("key"), bounds)).withColumn("kind", F.lit(1))
    told = events.withColumn("range", _range_of(F.col("key"), bounds))
    parts = [shuffle_partitions(spark)]
    if bounds:
        ends = told.groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
        told = told.unionByName(ends.select((F.col("range") + 1).alias("range"), F.lit("").alias("key"), "stack").where(F.col("range") <= len(bounds)))
        sizes = {r["range"]: r["count"] for r in asked.groupBy("range").count().collect()}
        whole = max(1, sum(sizes.values()))
        parts = [max(1, -(-parts[0] * sizes.get(k, 0) // whole)) for k in range(len(bounds) + 1)]
    first = F.array(*[F.lit(sum(parts[:k])) for k in range(len(parts))])
    many = F.try_element_at(F.array(*[F.lit(n) for n in parts]), F.col("range") + 1)
    start = F.try_element_at(first, F.col("range") + 1)
    asked = asked.withColumn("part", (start + F.monotonically_increasing_id() % many).cast("int"))
    told = told.withColumn("part", F.explode(F.sequence(start, start + many - 1))).withColumn("kind", F.lit(0))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = asked.unionByName(told, allowMissingColumns=True).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    return swept.select(*columns, "active")


def judge(urls: DataFrame, rules: DataFrame, *, url: str = "url", into: str = "filtered", default: str = "allow", block: int = BLOCK, inline: int = INLINE) -> DataFrame:
    """``urls`` with a struct ``into``: host, path, rule and verdict."""
    given = rules.where("host is not null and path is not null").select(F.lower("host").alias("host"), "path", "verdict")
    wide = checkpoint(given.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > inline).select("host"))
    some = not wide.isEmpty()
    host, path = split_url(F.col(url))
    row = F.struct(*[F.col(f"`{c}`") for c in urls.columns])
    asked = urls.select(row.alias("row"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    placed = _sweep(asked, checkpoint(boundaries(given, wide if some else None)), block)
    best = F.try_element_at(F.filter("active", lambda r: F.col("path").startswith(r["path"])), F.lit(1))
    if some:
        hosts = F.transform(F.filter("active", lambda r: r["path"].isNull()), lambda r: r["rule"])
        marked = checkpoint(placed.select("row", "host", "path", best.alias("near"), hosts.alias("hosts"), F.monotonically_increasing_id().alias("id")))
        below = marked.select("id", F.col("path").alias("p"), F.explode("hosts").alias("h")).select("id", path_key(F.col("h"), F.col("p")).alias("key"))
        told = checkpoint(path_boundaries(given.join(wide, "host", "left_semi")))
        far = _sweep(below, told, block).select("id", F.try_element_at("active", F.lit(1)).alias("r")).groupBy("id").agg(F.max("r").alias("far"))
        # of two rules the greater one wins, and nothing is less than any
        placed, best = marked.join(far, "id", "left"), F.greatest("near", "far")
    found = F.struct("host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
    return placed.select(*[F.col("row")[c].alias(c) for c in urls.columns if c != into], found.alias(into))


#: The production rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as a table of literals, without a Python task."""
    rows = [F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    source = F.array(*rows) if rows else F.array().cast("array<struct<host:string,path:string,verdict:string>>")
    return spark.range(1).select(F.explode(source).alias("r")).select("r.*")


def url_verdicts(pages: DataFrame, rules: DataFrame | None = None, *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule and verdict."""
    asked = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    return judge(asked, rule_table(pages.sparkSession) if rules is None else rules, into="__f").select("page_id", "__f.*")
