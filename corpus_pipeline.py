"""The corpus pipeline: five stages over ``documents``, each written and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents``. Every stage works on all rows that its predecessor kept, in the
order toxicity, near-dedup, decontamination, personal data, packing.

Defined results: a null text counts as empty, is never filtered by its content and stays
null until it is packed as the closing id alone; blank texts are near copies of each other;
rows with a null id pass the near-dedup stage, as no decision can name them; repeated rows
leave one; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm import decontaminate, packing, pii, simhash, toxicity
from fleetstats.llm.common import shared_folder

#: No SQL: the stages learn models, hash with XXH64 and run a byte-level tokenizer.
ORACLE_SQL = None

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = packing.Limits(tokens=1024, segments=1024, loss=1024)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity reaches the fitted cut go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: 3-word shingles, 3 bits at most."""
    return simhash.keep_first(docs, shingle=3, reach=3).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, to a similarity of 0.8, go."""
    return decontaminate.drop_leaky(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become marks; ``n_chars`` is that of the new text."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 1024; one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN,
                                  SEQUENCE).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminated),
          ("pii", redacted), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over the Parquet that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
