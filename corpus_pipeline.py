"""From documents to packed token sequences, in stages that are each written and read again.

A stage's rows are written after its function has returned, so each sets the session itself to small batches of texts
(``lower_batches``) and leaves it so: what one machine holds at a time then does not depend on the session's settings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.llm import langid, packing, secrets, simhash, toxicity
from tallyrank.llm.common import lower_batches
from tallyrank.llm.queries import vocabulary
from tallyrank.session import scratch_path

#: SQL cannot express the stages; tests hold near copies against all pairs and toxic rows against labels, and look for secrets left.
ORACLE_SQL = None
#: Smallest likeness to a language's profile that a document must reach; held-out ones reached 0.36 and more (README).
LEAST_LANGUAGE = 0.2
#: Toxicity score from which a document goes.
MOST_TOXIC = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language known from the labelled ones."""
    lower_batches(spark)
    return langid.accepted(docs, langid.fit(docs), least=LEAST_LANGUAGE)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that a model of the labelled ones does not find toxic."""
    lower_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels), most=MOST_TOXIC)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: shingles of five words, 0.8 alike."""
    lower_batches(spark)
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; ``n_chars`` is that of the masked text."""
    lower_batches(spark)
    found = secrets.scan(docs, secrets.fit(docs), out="_secrets")
    masked = secrets.masked(found, "text", F.col("_secrets.all"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in windows of equal size."""
    lower_batches(spark)
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", without_toxic),
    ("simhash", without_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
