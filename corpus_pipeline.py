"""A training-data pipeline over `documents`: five operators in a row, each on what the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from seamline.lineage import shared_folder
from seamline.llm.common import read_table, small_batches

#: From this score on a document is rejected as toxic.
TOXIC = 0.7
#: The mixture is as large as what reaches it, in equal shares of the sources.
EPOCHS, SEED = 1.0, 42


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC under a model of all labelled documents.

    A null or empty text has no hits and stays; rows that repeat an id are scored each by its own
    text; without labels nothing is rejected; extra columns pass.
    """
    small_batches(spark)
    model = toxicity.fit(toxicity.training_rows(docs, read_table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model, reject=TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id.

    Null and empty texts are one group; a null id loses to any other; of rows that repeat the id
    that stays, one stays. Extra columns pass.
    """
    small_batches(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or
    more, by any chain of links): that with the smallest doc_id.

    Texts without words are one group; rows with a null id stay; rows that repeat an id are decided
    each by its own text. Extra columns pass.
    """
    small_batches(spark)
    return simhash.near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null texts hold none and stay; rows that repeat an id are decided each by its own text; an empty
    benchmark rejects nothing. Extra columns pass.
    """
    small_batches(spark)
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture, with `copy` and `shuffle_key`, in a global random order.

    A null source is one of its own; rows that repeat an id repeat its draw; input columns named
    `copy` or `shuffle_key` are replaced, all others pass.
    """
    return mixing.poisson_mix(docs, epochs=EPOCHS, seed=SEED)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]
#: SQL has neither zstandard nor XXH64 nor connected components over Hamming distance; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written as Parquet, beside the session's checkpoints, and read again.

    An empty table gives no rows. Nulls, empty texts, repeated rows and extra columns pass as each
    stage says.
    """
    docs, top = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
