"""Source files as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A condition of the C preprocessor; its line is blanked, so that line numbers stay.
CONDITIONAL = r"(?m)^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b.*$"


def files(spark: SparkSession, root: str, pattern: str = "*", strip_conditionals: bool = False) -> DataFrame:
    """(path, text): one row per file under root whose name fits the pattern."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    text = F.regexp_replace("value", CONDITIONAL, "") if strip_conditionals else F.col("value")
    return reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), text.alias("text"))


def lines(source: DataFrame) -> DataFrame:
    """(path, line, text): lines numbered from 1, from (path, text)."""
    each = F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"))
    return source.select("path", each.alias("line", "text")).withColumn("line", F.col("line") + 1)


def with_level_and_area(rows: DataFrame) -> DataFrame:
    """Adds the level's folder name and the area's number (0 outside of any) that a path tells."""
    return rows.withColumns({
        "level": F.regexp_extract("path", r"levels/([^/]+)/", 1),
        "area": F.coalesce(F.expr(r"try_cast(regexp_extract(path, '/areas/([^/]+)/', 1) as int)"), F.lit(0)),
    })
