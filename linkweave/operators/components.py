"""Connected components over an edge DataFrame."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkweave.runtime import checkpoint_dir, remove, written

#: More than log2 of any number of nodes, several times over.
ROUNDS = 400


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return ``(node, component)`` for every endpoint; ``component`` is its smallest node.

    Each node points to a smaller one of its component. In a round, a node learns the least of
    what its neighbours' pointers point to; it takes that as its own pointer and hooks what it
    pointed to under it, and pointers are halved. Chains of n nodes in any order close in about
    log2(n) + 2 rounds. A round shuffles the edges once, aggregates hubs on the map side, and
    is written to the shared checkpoint folder; the round before is then deleted, so the disk
    holds the edges and two rounds at most. The files of the last round stay, as the result is
    read from them. The edges are evaluated once. Null endpoints are ignored; self loops and
    repeated edges are harmless; no edges give no rows.
    """
    spark = edges.sparkSession
    folder = f"{checkpoint_dir(spark)}/components-{uuid.uuid4().hex}"
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    # both directions come from one evaluation: another may list other edges of the same components, and half of each list is no graph
    directions = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    both = written(pairs.select(F.explode(directions).alias("e")).select("e.x", "e.y").distinct(), f"{folder}/edges")
    links = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("link")), f"{folder}/0")
    for turn in count(1):
        if turn > ROUNDS:
            raise RuntimeError(f"components are not closed after {ROUNDS} rounds")
        onward = links.select(F.col("node").alias("t"), F.col("link").alias("far"))
        ahead = links.join(onward, links.link == onward.t).select("node", "link", "far")
        near = both.join(ahead.select(F.col("node").alias("n"), "far"), F.col("y") == F.col("n")).groupBy("x").agg(F.min("far").alias("least"))
        own = F.struct(F.col("node").alias("node"), F.least("link", "least", "far").alias("link"), F.col("link").alias("was"))
        hooked = F.struct(F.col("link").alias("node"), F.col("least").alias("link"), F.lit(None).alias("was"))
        offers = ahead.join(near, F.col("node") == F.col("x")).select(F.explode(F.array(own, hooked)).alias("o")).select("o.*")
        changed = Observation()
        moved = offers.groupBy("node").agg(F.min("link").alias("link"), F.max("was").alias("was"))
        # counted while it is written, so that the end of the rounds is no job of its own
        step = written(moved.observe(changed, F.count_if(F.col("link") != F.col("was")).alias("n")), f"{folder}/{turn}")
        remove(spark, f"{folder}/{turn - 1}")
        links = step.select("node", "link")
        if not changed.get["n"]:
            break
    remove(spark, f"{folder}/edges")
    return links.withColumnRenamed("link", "component")
