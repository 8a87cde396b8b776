"""The mixing stage of the pipeline: quality weights, and counts per row."""

from emberframe.llm import mixing
from pyspark.sql import functions as F


def test_mixing_takes_rows_and_weighs_them(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, "a", f"null {k}") for k in range(41)] + [
        (k, s, "some words of text") for s, first in (("b", 1000), ("c", 2000)) for k in range(first, first + 400)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labels = spark.createDataFrame(
        [(k, int(k % 2)) for first in (1000, 2000) for k in range(first, first + 400)], "doc_id long, quality int"
    )
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    size = F.regexp_count("text", F.lit(mixing.WORD))
    weight = F.when(F.col("quality") == 1, 2.0).otherwise(0.5)
    rated = docs.join(labels, "doc_id", "left")
    want = {
        r["source"]: r["t"] for r in mixing.mix_sources(
            rated, size=size, weight=F.when(F.col("quality").isNotNull(), weight)
        ).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    }
    got = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum(size).alias("t")).collect()} == want
    good = {
        r["source"]: r["g"] for r in got.groupBy("source").agg(F.avg(F.pmod("doc_id", F.lit(2))).alias("g")).collect()
    }
    assert good["b"] > 0.6


def test_mixing_takes_some_of_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, s, f"word {k}") for s in "abc" for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    size = F.regexp_count("text", F.lit(mixing.WORD))
    want = {
        r["source"]: r["t"] for r in mixing.mix_sources(docs, size=size).groupBy("source").agg(
            F.sum("taken").alias("t")
        ).collect()
    }
    got = {
        r["source"]: r["t"] for r in corpus_pipeline.mix_sources(
            spark, docs, str(tmp_path)
        ).groupBy("source").agg(F.sum(size).alias("t")).collect()
    }
    assert {k: got.get(k, 0) for k in want} == want
