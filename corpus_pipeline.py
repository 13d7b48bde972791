"""A corpus pipeline made of the operators in codelake.llm.

Every stage takes and returns the columns of documents, but for the last, which
returns the packed pieces. Rows with a null doc_id pass the stages that remove
documents by id. `run` writes each stage's documents to the shared folder before the
next one reads them, so no stage runs twice and a lost executor costs one stage at
most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import cut, fresh_dir, read_table
from codelake.llm.contamination import find_items
from codelake.llm.linededup import remove_repeats
from codelake.llm.neardup import near_duplicates
from codelake.llm.packing import cut_pieces, pack
from codelake.llm.quality import keep_good


#: Up to so many ids (16 MB) go to every task, so that no text is shuffled to drop a few documents.
MOST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = cut(ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_IDS else gone, "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and passages that stand elsewhere are cut out of all texts but the first that has them; documents that lose all of their text go."""
    return remove_repeats(docs, emptied=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return _without(docs, near_duplicates(docs).filter(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, find_items(docs, read_table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' tokens, packed into sequences."""
    import public_tokenizers

    return pack(cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No SQL expresses the learned and the hashed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            folder = fresh_dir(spark, name)
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
