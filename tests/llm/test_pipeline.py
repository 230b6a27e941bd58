from __future__ import annotations

import random

import corpus_pipeline
from lodegraph.llm import decontamination, jaccard_join
from lodegraph.llm.line_dedup import lines_of
from pyspark.sql import functions as F


def test_stages(spark, sf_dir):
    """Each stage keeps the columns, and its decisions hold on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    before = docs.count()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
    for name in list(stages)[:-1]:
        out = corpus_pipeline.written(stages[name](spark, docs, sf_dir))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        n = out.count()
        assert n <= before and n > 0.5 * before
        if name == "line_dedup":
            shared = docs.select("doc_id", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: F.lower(F.trim(x))))).alias("k")).where("k <> ''").groupBy("k").count().where("count >= 10")
            left = out.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("x")).select(F.lower(F.trim("x")).alias("k"))
            assert left.join(shared, "k", "left_semi").count() == 0
            assert out.where(F.length("text") != F.col("n_chars")).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where("t <> text").count() == 0
        if name == "jaccard_join":
            assert jaccard_join.near_duplicates(out).where("n_links > 0 OR (n_copies > 1)").count() == 0
        if name == "decontamination":
            assert decontamination.leaks(out, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
        docs, before = out, n
    pieces = stages["packing"](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_clean_documents_stay(spark, sf_dir, tmp_path):
    rng = random.Random(0)
    words = ["house", "river", "stone", "garden", "winter", "silver", "paper", "window", "morning", "bridge"]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "123", "en", "s", 3), (5, texts[5], "en", "s", len(texts[5]))]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path))
    spark.createDataFrame([(1, "nothing of this kind is written in any of the documents of this corpus")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(30))


def test_an_empty_table_stays_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item that nothing holds")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
