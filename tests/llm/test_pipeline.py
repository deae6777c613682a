"""The pipeline's stages against the operators' brute-force versions, and its registry."""

import corpus_pipeline
from pyspark.sql import functions as F

from linkweave.llm import line_dedup, queries
from tests.llm.test_text_operators import _brute_components, _brute_contamination, _brute_dedup, _brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = docs.collect()
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        after = {r["doc_id"]: r["text"] if "text" in r else None for r in rows[name]}
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            wrong = sum((d in after) != bool(q) for d, q in labels.items())
            assert wrong <= 0.05 * len(labels) and len(after) < len(before)
        if name == "simhash":
            fps = {d: _brute_fingerprint(t) for d, t in before.items()}
            comp, least = _brute_components(list(fps.values())), {}
            for d in sorted(fps):
                least.setdefault(comp[fps[d]], d)
            assert set(after) == set(least.values())
        if name == "substring":
            want = _brute_dedup(list(before.items()))
            assert after == {d: t for d, (_, t) in want.items() if t.strip() or t == before[d]}
            assert all(r["n_chars"] == len(r["text"]) for r in rows[name])
        if name == "decontamination":
            assert set(after) == {d for d, t in before.items() if not _brute_contamination(t, items)[1]}
        if name == "encoding":
            assert set(after) == set(before) and all(r["n_tokens"] == len(r["ids"]) for r in rows[name])


def test_run_and_registry(spark):
    assert "pipeline" in queries.QUERIES and len(queries.QUERIES) == 16
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() > 0 and whole.select("doc_id").distinct().count() == whole.count()


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], empty.schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
    assert line_dedup.remove_repeats(odd).where(F.col("text").isNull()).count() == 1
