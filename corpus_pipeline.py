"""The corpus pipeline: toxicity, near-duplicate join, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each stage's result as Parquet and rereads
it as the next one's documents. All but the last return the columns of ``documents``. Nulls, empty texts, repeated
rows and empty tables are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitframe.llm import decontaminate, jaccard, mixing, pii, toxicity
from transitframe.llm.common import part_of, store


def clean_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The classifier learns from the labelled documents outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(part_of("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, {f"_{i}": F.col(c) for i, c in enumerate(docs.columns)})
    return scored.where("score < 0.5").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document of least id stays."""
    return jaccard.first_of_each(docs, words=5, percent=80)


def off_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets; n_chars follows."""
    return pii.mask(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mixture: documents with their copy, block and order; no source is repeated more than 1.25 times."""
    return mixing.mix(docs, budget_share=1.0, repetitions=1.25)


STAGES = [("toxicity", clean_only), ("jaccard_join", one_of_each), ("decontamination", off_benchmark), ("personal_data", masked), ("mixing", mixture)]
#: Classifier and random field have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = store(docs)
    return docs
