"""Groups of any size as blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, parts: Column, id_column: str) -> DataFrame:
    """Adds part, block_a <= block_b so that any two rows of a key meet in one group (key, block_a, block_b).

    A key's rows go to so many parts by a hash of the id. A group holds two parts
    (or one, where block_a = block_b), and a row is repeated once for every part of
    its key. Rows of the same part meet in each of its groups.
    """
    out = rows.withColumn("_parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64(id_column), F.col("_parts")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return out.withColumns({"block_a": F.least("part", "_other"), "block_b": F.greatest("part", "_other")}).drop("_parts", "_other")


def paired_blocks(rows: DataFrame, keys: list[str], id_column: str, size: int, weight: str | None = None) -> DataFrame:
    """`dealt`, with parts of about `size` rows; a row counts as many times as its column `weight` says, once if not given."""
    n = F.sum(weight) if weight else F.count("*")
    sizes = rows.groupBy(*keys).agg(F.ceil(n / size).alias("_size"))
    return dealt(rows.join(sizes, keys), F.col("_size"), id_column).drop("_size", "part")
