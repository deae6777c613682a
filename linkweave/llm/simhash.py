"""SimHash near-duplicates by multi-index hashing.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words joined by
a blank and taken with repeats (fewer words: the whole sequence), each hashed with XXH64
(seed 42); a bit is set where it is set in over half the hashes. A text without a word has
fingerprint zero. Two fingerprints link when at most three bits differ.

Search: a fingerprint is cut into two 32-bit segments. Three differing bits leave one segment
with at most one, so each fingerprint is stored under both segments and looked up under every
member of the Hamming ball of radius one around them; of two segments that differ in one bit,
only the one that has the bit set enumerates the other, which halves the ball. Each table
bucket is a sorted run of one partition: its matches are verified on all 64 bits and only a
spanning forest of them is emitted, so a bucket of near copies never becomes all its pairs.
A bucket with more than ``dense`` stored fingerprints is dealt anew under each of the 56 ways
to keep five of the eight nibbles of the other segment (three differing bits touch at most
three nibbles), which bounds it at 4096 distinct fingerprints, exactly.

Defined cases: null and empty texts have fingerprint zero and link like any other; equal
fingerprints are one node; repeated rows and ids each give a row of :func:`near_duplicates`; a
null id takes part but never is a component's id unless all its ids are null; no rows give no
rows; the columns of the documents are kept by :func:`keep_one_per_component`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.arrow_text import LOWER_BYTES, give_back, texts
from linkweave.operators.components import connected_components
from linkweave.llm.columns import unused_name
from linkweave.runtime import checkpoint, is_empty, shuffle_partitions

DENSE = 1024
_SEGMENT = np.uint64(0xFFFFFFFF)
_BITS = (np.uint64(1) << np.arange(32, dtype=np.uint64)).astype(np.uint64)
_KEEPS = [sum(15 << 4 * n for n in kept) for kept in combinations(range(8), 5)]


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one UTF-8 text, as an unsigned integer."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) < 3:
        hashes = [digest(joined, 42)]
    else:
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = np.concatenate(([0], stop[:-3] + 1)).tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(first, stop[2:].tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array(np.array([fingerprint(t) for t in texts(column)], dtype=np.uint64).view(np.int64))
    give_back()


def with_fingerprint(docs: DataFrame, *, text: str = "text", into: str = "fingerprint") -> DataFrame:
    return docs.withColumn(into, _fingerprints(F.col(text)))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, probe, fp): a stored row for each segment and a probe for each bit set in it."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(fps), 1 << 15):
            own = fps[at : at + (1 << 15)]
            buckets, probes, whose = [], [], []
            for segment in (0, 1):
                half = (own >> np.uint64(32 * segment)) & _SEGMENT
                row, bit = np.nonzero(half[:, None] & _BITS)
                base = np.uint64(segment << 32)
                buckets += [base | half, base | (half[row] ^ _BITS[bit])]
                probes += [np.zeros(len(own), bool), np.ones(len(row), bool)]
                whose += [own, own[row]]
            yield _rows(np.concatenate(buckets), np.concatenate(probes), np.concatenate(whose))


def _rows(buckets: np.ndarray, probes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets.view(np.int64)), pa.array(probes), pa.array(fps.view(np.int64))], names=["bucket", "probe", "fp"])


def _deal_dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of dense buckets, under each choice of five nibbles of the other segment."""
    for batch in batches:
        buckets, probes, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        buckets, fps = buckets.astype(np.int64).view(np.uint64), fps.astype(np.int64).view(np.uint64)
        other = np.where(buckets >> np.uint64(32) == 0, fps >> np.uint64(32), fps & _SEGMENT)
        for number, mask in enumerate(_KEEPS):
            kept, shift = np.zeros(len(fps), dtype=np.uint64), 0
            for nibble in range(8):
                if mask >> 4 * nibble & 15:
                    kept |= ((other >> np.uint64(4 * nibble)) & np.uint64(15)) << np.uint64(shift)
                    shift += 4
            yield _rows(buckets << np.uint64(26) | np.uint64(number << 20) | kept, probes, fps)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)), dtype=bool)
    for at in range(0, len(a), 256):
        out[at : at + 256] = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= 3
    return out


def _forest(stored: np.ndarray) -> np.ndarray:
    """For each stored fingerprint of a bucket, the index of its component's first member there."""
    near, label = _close(stored, stored), np.arange(len(stored))
    while True:
        low = np.array([label[row].min() for row in near])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of sorted bucket runs: every probe to its matches' forest, and the forest itself.

    Stored rows come before probes in a run, so only the stored rows of the run at the end of
    a batch are carried over; they are bounded by the bucket's bound.
    """
    carried_bucket, carried = None, np.zeros(0, np.uint64)
    for batch in batches:
        buckets, probes, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fps = fps.astype(np.int64).view(np.uint64)
        if not len(fps):
            continue
        if carried_bucket is not None and len(carried):
            buckets = np.concatenate((np.full(len(carried), carried_bucket), buckets))
            probes = np.concatenate((np.zeros(len(carried), bool), probes))
            fps = np.concatenate((carried, fps))
        first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
        stop = np.append(first[1:], len(buckets))
        stored_n = np.add.reduceat((~probes).astype(np.int64), first)
        left, right = [], []
        for k in np.flatnonzero((stored_n > 0) & (stop - first > 1)).tolist():
            a, b, n = first[k], stop[k], stored_n[k]
            stored, asking = fps[a : a + n], fps[a + n : b]
            label = _forest(stored) if n > 1 else np.zeros(1, np.int64)
            tied = label != np.arange(n)
            left.append(stored[tied])
            right.append(stored[label[tied]])
            for at in range(0, len(asking), 1024):
                row, column = np.nonzero(_close(asking[at : at + 1024], stored))
                if len(row):
                    once = np.unique(np.stack((row, label[column])), axis=1)
                    left.append(asking[at : at + 1024][once[0]])
                    right.append(stored[once[1]])
        carried_bucket = buckets[-1]
        carried = fps[first[-1] : first[-1] + stored_n[-1]]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])


def _search(rows: DataFrame) -> DataFrame:
    # sorted by fp too: a forest names its first member, and the order in which a shuffle's blocks arrive must not choose it
    return rows.repartition(shuffle_partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "probe", "fp").mapInArrow(_links, "a bigint, b bigint")


def fingerprint_links(fps: DataFrame, *, dense: int = DENSE) -> DataFrame:
    """Links (a, b) whose components are those of "at most three bits differ" over distinct ``fps.fp``.

    Not every pair is listed: within a bucket only enough of them to connect what is connected,
    and the same ones whatever the order of ``fps``.
    """
    # a few MB of fingerprints become about 34 times as many rows: adaptive reading must not leave them to a few tasks
    fps = fps.select("fp").repartition(shuffle_partitions(fps.sparkSession))
    entries = fps.mapInArrow(_entries, "bucket bigint, probe boolean, fp bigint")
    segments = fps.select(F.explode(F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32).bitwiseOR(1 << 32))).alias("bucket"))
    crowded = checkpoint(segments.groupBy("bucket").count().where(F.col("count") > dense).select("bucket"))
    if is_empty(crowded):
        return _search(entries)
    thin = _search(entries.join(crowded, "bucket", "left_anti"))
    thick = entries.join(crowded, "bucket", "left_semi").mapInArrow(_deal_dense, "bucket bigint, probe boolean, fp bigint")
    return thin.union(_search(thick))


def _components(marked: DataFrame, dense: int) -> DataFrame:
    """(node, component, component_id) of each fingerprint of ``marked`` (doc_id, fp): its component's mark and smallest id."""
    nodes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    components = connected_components(fingerprint_links(nodes, dense=dense))
    placed = nodes.join(components, nodes.fp == components.node)
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("least_id"))
    linked = placed.join(smallest, "component").select(F.col("fp").alias("linked_fp"), "component", "least_id")
    named = nodes.join(linked, nodes.fp == F.col("linked_fp"), "left").select(F.col("fp").alias("node"), F.coalesce("component", "fp").alias("component"), F.coalesce("least_id", "first_id").alias("component_id"))
    return checkpoint(named)  # so that both sides of a join with the documents are plain shuffles, whose hot fingerprints Spark splits


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id, the smallest reachable doc_id."""
    marked = checkpoint(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), into="fp").select("doc_id", "fp"))
    named = _components(marked, dense)
    return marked.join(named, marked.fp == named.node).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """``docs`` with exactly one row of each component: the smallest id, then the least text hash; its columns stay.

    Null ids come last, so that of a component of null ids alone one row stays. Rows that
    repeat id and text are one document, of which one row stays; rows that share an id alone
    are not, and each is judged by its own text.
    """
    null, own, digest = (unused_name(docs, c) for c in ("null", "id", "hash"))
    keys = {null: F.col(doc_id).isNull(), own: F.coalesce(F.col(doc_id).cast("string"), F.lit("")), digest: F.xxhash64(text)}
    marked = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")), into="fp")
    marked = checkpoint(marked.select("doc_id", "hash", "fp"))
    named = _components(marked, dense)
    rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "hash")
    first = marked.join(named, marked.fp == named.node).groupBy("component").agg(F.min(rank).alias("f"))
    first = first.select(F.col("f.null").alias(null), F.coalesce(F.col("f.doc_id").cast("string"), F.lit("")).alias(own), F.col("f.hash").alias(digest))
    # rows that repeat meet on the keys of the join, so that they are told apart without another shuffle
    return docs.withColumns(keys).join(first, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)
