"""A training-corpus pipeline: quality, near-duplicates, repeated passages, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet and read again as the next
stage's documents; all stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import minhash, mixing, packing, quality, repeats
from emberframe.llm.queries import GRADE
from emberframe.llm.shared import materialize


#: Words of a passage that counts as repeated: over 50.
PASSAGE = 51


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least 1/2, by a model fitted on the labelled ones. Rows are judged
    one by one by their texts, so repeated rows share a result; a null or empty text is judged by the model's prior. Without
    labels the prior is 1/2 and all stay. An empty table stays empty, and further columns may have any names."""
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.expr(GRADE))
    return quality.select_quality(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on shingles of five words, that of the least id.
    Null, empty and blank texts, and rows with a null id, have no links and stay. Rows that repeat an id stay together. An
    empty table stays empty, and further columns may have any names."""
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words (``PASSAGE`` or more) that occur more than once. Null texts stay null,
    emptied texts stay as empty rows, repeated rows are repeats of each other."""
    return repeats.remove_repeats(docs, words=PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the sources' words near their targets. Documents labelled good weigh 2,
    those labelled bad 1/2, others 1. A document without words (null, empty, emptied) adds nothing to a mix measured in
    words and is left out; of repeated rows as many are taken as the mix took. Null ids and sources count as any other, an
    empty table stays empty, and further columns may have any names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    own = [
        docs["doc_id"].alias("own_id"), docs["source"].alias("own_source"), size.alias("own_size"),
        F.monotonically_increasing_id().alias("own_row")
    ]
    rows = docs.select(*[docs[c].alias(n) for n, c in zip(names, docs.columns)], *own)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(
        F.col("doc_id").alias("labelled")
    ).agg(F.min("quality").alias("rated"))
    # labels grow with the documents: both sides are shuffled at every size
    rated = rows.join(labels.hint("merge"), F.col("own_id") == F.col("labelled"), "left")
    weight = F.when(F.col("rated") == 1, 2.0).when(F.col("rated") == 0, 0.5).otherwise(1.0)
    taken = mixing.repeat_rows(
        rated, size="own_size", row="own_row", weight=weight, doc_id="own_id", source="own_source"
    )
    return taken.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. A null or empty text is its end id alone, repeated rows are documents of their own,
    an empty table gives no pieces; further columns are not read."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither a fitted classifier nor a public tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents to the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
