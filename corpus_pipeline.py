"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its rows are written to the shared
folder and read again as the next one's input.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickweave.llm import language_id, line_dedup, mixing, near_duplicates, packing
from tickweave.llm.common import written
from tickweave.llm.queries import quality_weights, table, tokenizer_path




def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; ``lang`` stays as given."""
    return language_id.accepted(docs).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those of which nothing is left go, and ``n_chars`` follows the text."""
    cleaned = line_dedup.remove_boilerplate(docs)
    left = (F.col("n_removed") == 0) | (F.trim("text") != "")
    rest = cleaned.where(left)
    return rest.select(*[F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(c)).cast("bigint").alias(c)
                         if c == "n_chars" else F.col(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates (five words, 0.8)."""
    return near_duplicates.without_duplicates(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.mixed_rows(docs, quality_weights(spark, sf_dir)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language scores, tokens and the search for full bins are not SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
