"""A training corpus from raw documents: toxicity, near-duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of ``documents``. The texts differ from stage to stage, so none reads ``documents`` again but the first, which
fits its model on labelled texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.llm import byte_bpe, circulant_minhash, contextual_pii, kneser_ney, prefix_join
from labelsieve.llm.queries import TOKENIZERS, table, toxicity_model
from labelsieve.session import ensure_checkpoint_dir, materialize

TOXIC_FROM = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are toxic with a probability of 0.7 or more; null and empty texts stay, repeated rows alike."""
    scored = kneser_ney.score(docs, "text", toxicity_model(spark, sf_dir), "_toxicity")
    return scored.filter(F.col("_toxicity") < TOXIC_FROM).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The one of the smallest id stays. Texts without words and rows without id are linked with nothing and stay; of rows
    that repeat an id, one stays.
    """
    return circulant_minhash.keep_one(docs, "text", "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which one word in twenty or more lies in a benchmark item's windows; a text without words stays."""
    marked = prefix_join.mark_contamination(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", ("doc_id", "text"))
    return marked.filter(~F.col("contaminated")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in brackets in place of personal data; every row stays, null texts stay null."""
    found = contextual_pii.with_spans(docs, "text", ("doc_id", "text"))
    text = contextual_pii.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the text that they decode to; a null text is empty. Every row stays."""
    definition = byte_bpe.read_tokenizer(f"{TOKENIZERS}/byte_bpe_50k.json")
    ids = materialize(byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", definition).drop("text"))
    decoded = byte_bpe.decode(ids, "ids", definition, "text")
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: The toxicity model, discovered identifiers and tokenization have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read by the next."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
