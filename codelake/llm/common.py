"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python task; keeps very long texts from piling up.
BATCH_BYTES = 16 << 20
#: Characters whose words are worked on at once, where each word takes an array's row.
PART_CHARS = 1 << 18


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codelake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/codelake/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parts_of(texts: list[str], most: int = PART_CHARS) -> Iterator[list[str]]:
    """The texts in order, in lists of `most` characters at most or of one text; none has no list."""
    lo = size = 0
    for hi, text in enumerate(texts):
        if hi > lo and size + len(text) > most:
            yield texts[lo:hi]
            lo, size = hi, 0
        size += len(text)
    if lo < len(texts):
        yield texts[lo:]


#: How to empty what this Python process remembers of words, by the name of the memory.
_memories: dict[str, Callable[[], object]] = {}


def only_memory(name: str, empty: Callable[[], object]) -> None:
    """Says that the words under `name` are in use and empties all other memories.

    Spark gives a Python worker to one operator after another, whose memories would pile up.
    """
    if name not in _memories or len(_memories) > 1:
        for other in [n for n in _memories if n != name]:
            _memories.pop(other)()
        _memories[name] = empty


def ranges_for(docs: DataFrame) -> int:
    """How many ranges to sort documents into: as many as the input has splits, so that each stays as small as one."""
    return max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and the whole text, null as empty; any other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def held_out(column: str, folds: int):
    """Whether crc32 of the id as text is divisible by folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0
