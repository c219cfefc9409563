"""A training-data pipeline over whole documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet in the shared folder and hands it on re-read.

1. toxicity: documents that the classifier rejects go.
2. n-gram Jaccard join: one document of each group of near copies stays
   (five-word shingles, similarity 0.8).
3. secret scans: secrets, also encoded ones, are replaced in the text.
4. mixing: each text becomes the words that the source mix takes of it.
5. packing: the ids of what is left, packed into sequences.

Documents with null texts pass stages 1 to 3 and have no words for stage 4;
empty tables pass through; columns beyond those of ``documents`` are kept up to
stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm import jaccard_join, mixing, packing, secrets, toxicity
from citeweave.storage import Store
from citeweave.llm.tables import read_table

NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the labels that may be learned from come with the corpus."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of linked documents."""
    return jaccard_join.keep_one_per_group(docs, NEAR_WORDS, NEAR_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Learned weights, pseudorandom permutations and a vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    store = Store(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
