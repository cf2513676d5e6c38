"""From documents to token ids: five stages, each one operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again
as the next one's docs; all but the last return the columns of documents. Sizes and thresholds are
those of the operators (`wardlens.llm`).

An empty table gives an empty result in every stage. A null or empty text is rejected by the first stage; a later
one takes it as an empty text. Very long texts are treated whole. Repeated rows stay one after `exact_dedup`; null
doc_ids keep their rows but for copies. Columns that documents have besides its own pass through all stages but
the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from wardlens.llm.common import shared_folder
from wardlens.llm.queries import MIX_EPOCHS, MIX_POWER, MIX_SEED, tokenizer_file


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    kept = quality_rules.cleaned(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.deduplicated(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight draws, shuffled globally."""
    weights = mixing.tempered_weights(docs, MIX_POWER)
    mixture = mixing.mixed_sources(docs, weights, MIX_SEED, MIX_EPOCHS)
    return mixture.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether the ids decode to the text again."""
    return bpe.encoded(docs, tokenizer_file())


STAGES = [
    ("quality_rules", clean_lines),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Sketches, sampling and BPE are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
