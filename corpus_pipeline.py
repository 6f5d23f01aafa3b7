"""From raw documents to token ids: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet into the
shared folder and read again as the next stage's ``docs``, which cuts the lineage at every stage.
All but the last return the columns of ``documents``, whatever other columns the input has.

Defined results, in every stage: a row is judged by its text and never lost for its id, so that rows with null or repeated
ids stay as long as their texts do; null texts are judged like empty ones and stay null (toxicity, decontamination and masking
keep them; of all texts without words the near-duplicate stage keeps one row, as their fingerprints are equal); texts of any
length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.llm import bpe, decontam, pii, simhash, toxicity
from wickline.llm.common import delete, fresh_path, table, unused
from wickline.llm.queries import default_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the models see all documents of the input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    (name,) = unused(docs, "toxicity")
    return toxicity.score(docs, model, out=name).filter(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, language, source and token ids, with a check that decoding restores the text; a null text has no ids."""
    digested = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    coded = bpe.code(digested, default_vocabulary(), drop_text=True)
    return coded.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("digest")).alias("restored")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii_masking", mask_personal_data),
    ("bpe_encoding", encode_tokens),
]

#: Model fitting, connected components and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)  # its successor is written
        docs, last = spark.read.parquet(path), path
    return docs
