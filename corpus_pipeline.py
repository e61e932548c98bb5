"""A corpus from raw documents to packed sequences: five stages, each written and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All but the last return the columns of ``documents``; ``n_chars`` follows the
text. Further columns of any name are handed through as they are.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm import cotraining
from massloom.llm.jaccard import ngram_jaccard_join
from massloom.llm.packing import concatenate_and_cut, tokenized
from massloom.llm.pii import pseudonymise
from massloom.llm.queries import EXAMPLE_KEY
from massloom.llm.storage import stored
from massloom.llm.suffix_dedup import suffix_dedup
from massloom.session import shared_dir


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame):
    """``docs`` with its further columns under names that no operator uses, and the way back from a stage's rows."""
    names = [c if c in OWN else f"other_{i}" for i, c in enumerate(docs.columns)]
    renamed = docs.toDF(*names)

    def back(made: DataFrame) -> DataFrame:
        made = made.select(*names)
        if "n_chars" in names:  # lengths follow the text
            made = made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
        return made.toDF(*docs.columns)

    return renamed, back


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    rows, _ = _apart(docs)
    model = cotraining.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.score(rows, model, keep=rows.columns).where("kept").select(*rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that with the smallest id; null ids come last. Repeated rows are copies."""
    # Ids may repeat or be null, so rows get keys of their own, written down for every later read.
    named, _ = _apart(docs)
    rows = stored(named.withColumn("row", F.monotonically_increasing_id()), "keyed-rows")
    groups = ngram_jaccard_join(rows, "row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "row")
    stays = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order)["row"].alias("row"))
    return rows.join(stays, "row", "left_semi").select(*named.columns).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings of 100 bytes seen earlier are cut out; every document stays."""
    rows, back = _apart(docs)
    return back(suffix_dedup(rows, keep=rows.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; every document stays."""
    rows, back = _apart(docs)
    return back(pseudonymise(rows, EXAMPLE_KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids."""
    return concatenate_and_cut(tokenized(docs, public_tokenizers.path("word_bpe_49k.json")), 4096)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packing),
]

#: SQL can't express trained models and tokenizers; tests compare the near-duplicate stage with brute force, the others by columns and row counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
