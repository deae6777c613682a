"""The corpus pipeline: quality, near copies, repeated lines, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), where ``docs`` has the columns of the table documents,
works on every row that the stage before kept, and returns those columns and any others that it
was given; the last one returns the encoding, with doc_id, lang and source, in place of the text.
In every stage an empty table gives no rows, ids may be null or repeated, and rows that repeat id
and text are one document. Memory follows the longest text. :func:`run` writes each stage as Parquet under the shared
checkpoint folder and reads it again as the next one's input, so a lost executor costs a stage
at most and lineage never grows; a stage's files go when the next stage is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import decontamination, line_dedup, quality_gam, sentencepiece_bpe, simhash
from linkweave.llm.queries import GOOD, piece_model, quality_model
from linkweave.runtime import checkpoint_dir, spread


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score reaches the bar; learnt from the labels of these documents.

    A null or empty text is scored as a text without words, equal texts alike; labels without a
    document here, or null, teach nothing, and without any label every score is the same.
    """
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gam.score(docs, model, into="__score").where(F.col("__score") >= GOOD).drop("__score")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies.

    Null, empty and blank texts are one group; null ids rank last, equal ids by their texts'
    hashes; of rows that repeat id and text one stays.
    """
    return simhash.keep_one_per_component(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out; n_chars follows the text. A document left without a word goes.

    The place of the least (id, text hash, position) keeps a passage, null ids first. Documents
    without words from the start, nulls included, stay as they are.
    """
    cleaned = line_dedup.remove_repeats(docs, into="__removed")
    changed = F.col("__removed.n") > 0
    kept = cleaned.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).drop("__removed")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Null texts hold none and stay; items that are null or without words, and an empty benchmark,
    drop nothing.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their count, and digests of the ids and of their decoding.

    A null text is encoded as an empty one: no ids, and the digests of nothing.
    """
    return sentencepiece_bpe.encode(docs, piece_model(), into="__e").select("doc_id", "lang", "source", F.col("__e.n_tokens").alias("n_tokens"), F.col("__e.ids").alias("ids"), F.col("__e.ids_sha256").alias("ids_sha256"), F.col("__e.decoded_sha256").alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("substring", substring_stage), ("decontamination", decontamination_stage), ("encoding", encoding_stage)]

#: SQL cannot express the classifier, SimHash or the encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
