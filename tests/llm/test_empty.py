"""Operators and the pipeline over empty tables."""

import corpus_pipeline
from cuewright.llm import jaccard, linkgraph, matroska, mixing, quality, secrets, simple8b, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_operators_over_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    assert substring.remove_repeats(docs).count() == 0
    assert matroska.described(matroska.to_media(docs)).count() == 0
    assert secrets.scan(docs).count() == 0
    assert jaccard.near_groups(docs).count() == 0
    assert jaccard.keep_one(docs).columns == docs.columns and jaccard.keep_one(docs).count() == 0
    assert mixing.mixed(docs).count() == 0
    assert quality.scored(docs, quality.train_on(docs, spark.createDataFrame([], LABELS))).count() == 0
    assert simple8b.token_table(docs).count() == 0
    assert linkgraph.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_the_pipeline_over_no_documents(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "a passage of the benchmark")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
