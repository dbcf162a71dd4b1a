"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, folder) and works on all that the stage before it
kept; all but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailstream.llm import language, mixing, packing, similar, simhash, toxicity
from retailstream.llm.common import stored, table
from retailstream.llm.queries import VOCABULARY

# The stages can't be said in SQL: they learn models and pack by a heuristic.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score as toxic go."""
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    return docs.filter(toxicity.scored(model, F.col("text")) < 0.5)


def language_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in no language go: those without text or without a letter."""
    model = language.learn(docs)
    return docs.filter(language.identified(spark, model, F.col("text"))["lang_pred"] != language.UNKNOWN)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Near copies share at least 0.8 of their runs of five words.
    """
    return simhash.deduplicated(docs, shingle=similar.SHINGLE, similarity=similar.SIMILARITY)


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents and their places in sequences of tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on the documents of a folder, each result written as Parquet and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, folder)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
