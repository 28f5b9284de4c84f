"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; all but the
last give the columns of ``documents``, and further ones that it has. An empty
table gives an empty result. A stage's result is written as Parquet
and read again as the next one's documents, so a lost executor costs at most
one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.langid import accepted
from tessera.llm.line_dedup import deduplicated
from tessera.llm.mixing import mixed_documents
from tessera.llm.packing import default_tokenizer, packed
from tessera.llm.shingle_dedup import keep_one_similar
from tessera.operators.storage import new_path, remove


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: null texts and texts without a letter always, and all where no row is labelled. Repeated rows stay or go together; null ids and sources stay."""
    return accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which no line is left; ``n_chars`` follows. Null texts stay; null ids come first in order, and equal rows lose the same lines."""
    return deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (SimHash within 3 bits or a shared MinHash, verified: 0.8 of their five-word shingles or more) stays: the one of least id (nulls last), then of least text hash. Null and blank texts are copies of each other."""
    return keep_one_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it. Null texts have no words, a null source is one of its own, and rows that repeat an id are taken together."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences. A null text is its end id alone; ids may be null or repeat."""
    return packed(docs, default_tokenizer())


STAGES = [
    ("language", keep_known_languages),
    ("line-dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No single SQL text expresses the whole run; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what the next stage reads is written; the stage before it is not needed
            remove(spark, before)
        before = path
    return docs
