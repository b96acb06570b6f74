"""A training corpus from the documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmap.llm import decontam, mixing, ngram_join, sharding, toxicity
from quillmap.llm.store import without_ids, written

#: Near duplicates share five-word shingles with a similarity of 0.8 or more.
NEAR = ngram_join.Jaccard(width=5, num=80, den=100)
SHARDS = 8


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't hold for toxic; it is trained on the labels of documents at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, toxicity.train(*toxicity.training_sample(docs, labels)))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that n-gram Jaccard links connect."""
    return ngram_join.one_of_each(docs, NEAR)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    hits = decontam.contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(docs, written(hits.select(F.col("doc_id").alias("id")).distinct(), "hits").df)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.materialised(mixing.mix_sources(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, with its shard and its slot there."""
    dims = [F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "lang", "source"]
    out = sharding.kd_shards(docs, dims, n_shards=SHARDS)
    return out.select(*docs.columns, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


STAGES = [("toxicity", clean_speech), ("ngram_jaccard_join", one_of_near), ("benchmark_decontamination", uncontaminated), ("source_mixing", mixed), ("kd_sharding", sharded)]

#: String-kernel training, alignment and iterative splits aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the documents after all stages. A stage's table goes as soon as the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        table = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            last.drop()
        docs, last = table.df, table
    return docs
