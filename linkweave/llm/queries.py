"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import decontamination, fill_in_middle, language_id, license_scan, line_dedup, preference, quality_gam, quality_rules, sentencepiece_bpe, simhash, token_counts, url_filters, whitening
from linkweave.llm.oracles import ORACLE_SQL
from linkweave.runtime import spread

#: A document is held out from learning when its id's CRC-32 leaves this remainder.
HELD_OUT, FOLDS = 2, 4
#: Files of the public tokenizers that the queries take.
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
GOOD = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents, spread over the cores where they lie in few files."""
    docs = _table(spark, sf_dir, "documents")
    return spread(docs.select(*columns) if columns else docs)


def held_out(doc_id: str = "doc_id"):
    """Null ids are neither held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(BYTES)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(_learnable(_documents(spark, sf_dir, "doc_id", "text", "lang")))
    found = language_id.identify(_documents(spark, sf_dir, "doc_id", "text"), model, into="__l")
    return found.select("doc_id", held_out().alias("held_out"), F.col("__l.lang_pred").alias("lang_pred"), F.col("__l.score").alias("score"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_gam.AdditiveModel:
    return quality_gam.fit(docs, _learnable(labels))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = quality_model(docs, _table(spark, sf_dir, "labels"))
    scored = quality_gam.score(docs, model, into="__score")
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= GOOD).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_report(_documents(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encoding_digests(_documents(spark, sf_dir, "doc_id", "text"), piece_model())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(_documents(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_report(_table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_report(_documents(spark, sf_dir, "doc_id", "text"))


def op7_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy removes, and what it alone removes, from one pass over the ledger."""
    return quality_rules.ablations(quality_rules.ledger(_documents(spark, sf_dir, "doc_id", "text")), quality_rules.POLICIES["v2"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(_documents(spark, sf_dir, "doc_id", "text"))


def op9_line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line that is not blank, without a floor: each line's digest alone is grouped."""
    return line_dedup.dedup_report(_documents(spark, sf_dir, "doc_id", "text"), unit="line", min_words=1)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(_table(spark, sf_dir, "pages"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(_documents(spark, sf_dir, "doc_id", "text"), byte_tokenizer())


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_report(_documents(spark, sf_dir, "doc_id", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_classifier, op3_license_scan, op4_sentencepiece, op5_decontamination, op6_preference_format, op7_quality_rules, op7_ablations, op8_simhash, op9_line_dedup, op9_line_units, op10_url_filters, op11_token_counts, op12_fill_in_middle, op13_whitening, pipeline)}
ORACLES = ORACLE_SQL
