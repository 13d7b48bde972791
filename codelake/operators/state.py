"""Scans that carry state from row to row, and choices of one row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut


def last_seen(value: Column, by: list[str], order: list[str]) -> Column:
    """The last value that is not null, up to and with this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


#: Rows of one key up to which a window carries values along; beyond, every range of rows is a task of its own.
MOST_ROWS = 1_000_000


def _in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows in order, in ranges that the order's quantiles bound, with the range's number in `_range`.

    Written down, as other rows might come to a range if it were computed twice.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    return cut(df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)).withColumn("_range", F.spark_partition_id())


def carried(df: DataFrame, values: Mapping[str, Column], by: list[str], order: list[str], most: int = MOST_ROWS) -> DataFrame:
    """Adds for each name the last value of its column that is not null, up to and with this row of a key.

    Where no key has more than `most` rows that is a window. Otherwise rows are dealt
    to ranges by key and order, so that a key with most of all rows is many tasks'
    work: one pass notes what each range ends with (a row for each), the next carries
    on from what the ranges before it have left for the key that runs over their border.
    """
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return df.withColumns({name: last_seen(value, by, order) for name, value in values.items()})
    own = {name: f"_value_{i}" for i, name in enumerate(values)}
    ranged = _in_ranges(df.withColumns({own[name]: value for name, value in values.items()}).withColumn("_key", F.struct(*by)), [*by, *order])
    # The order is total within a range already; its last row and what precedes it are maxima by place.
    placed = ranged.withColumn("_place", F.monotonically_increasing_id())
    last = F.max_by("_key", "_place")
    ends = placed.groupBy("_range").agg(last.alias("_key"), F.min_by("_key", "_place").alias("_head")).withColumnRenamed("_key", "_tail")
    tails = placed.join(F.broadcast(ends), "_range").filter(F.col("_key").eqNullSafe(F.col("_tail"))).groupBy("_range")
    tails = tails.agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_place"))).alias(c) for c in own.values()))
    # One row for each range: what the ranges before it leave to its first key.
    ends = ends.join(tails, "_range")
    before = Window.partitionBy("_tail").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    left = ends.select(F.col("_tail").alias("_head"), F.col("_range").alias("_from"), *(F.last(c, ignorenulls=True).over(before).alias(c) for c in own.values()))
    given = ends.select("_range", "_head").alias("e").join(left.alias("l"), F.col("e._head").eqNullSafe(F.col("l._head")) & (F.col("_from") < F.col("_range")))
    given = given.groupBy("_range").agg(F.any_value("e._head").alias("_head"), *(F.max_by(c, "_from").alias(f"{c}_before") for c in own.values()))
    # Within a range the rows of a key are a window of (range, key).
    inside = Window.partitionBy("_range", "_key").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in own.values()}).join(F.broadcast(given), "_range", "left")
    same = F.col("_key").eqNullSafe(F.col("_head"))
    return filled.withColumns({name: F.coalesce(c, F.when(same, F.col(f"{c}_before"))) for name, c in own.items()}).select(*df.columns, *own)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> tuple[DataFrame, int]:
    """Adds each row's place in the order, from 0 on, and says how many rows there are; no task sees more than a range of the rows."""
    ranged = _in_ranges(df, order)
    sizes = ranged.groupBy("_range").count().orderBy("_range").collect()  # a row for each range
    starts = dict(zip((r["_range"] for r in sizes), accumulate((r["count"] for r in sizes), initial=0)))
    offsets = df.sparkSession.createDataFrame(list(starts.items()), "_range int, _start long")
    # Spark counts a partition's rows in the lower 33 bits.
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = ranged.withColumn("_at", within).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_start") + F.col("_at")).cast("long"))
    return rows.drop("_range", "_at", "_start"), sum(r["count"] for r in sizes)


def first_row(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that comes first; a partial aggregate, so no key's rows are gathered."""
    rest = [c for c in df.columns if c not in by and c not in order]
    return df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(*by, *(F.col(f"_first.{c}").alias(c) for c in [*order, *rest]))


def zip_by_place(left: DataFrame, right: DataFrame, left_order: Sequence[str | Column], right_order: Sequence[str | Column], strict: bool = True) -> DataFrame:
    """Joins the n-th rows of two lists, such as an enum and the array it numbers; lists of other lengths are an error unless not strict."""
    (a, n), (b, m) = numbered(left, left_order), numbered(right, right_order)
    if strict and n != m:
        raise ValueError(f"lists of {n} and of {m} rows can't be zipped")
    return a.join(b, "place")


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows that SQL's NOT IN keeps, of a one-column table of values.

    A null among the values leaves nothing; a null in the column stays only if there
    are no values at all. Values are made distinct once, and that is read by the anti
    join and by the one row that says what is among them: values stand in structs,
    whose nulls no join filters away on one of its sides alone.
    """
    [name] = values.columns
    own = values.groupBy(F.struct(F.col(name).alias("v")).alias("_value")).agg(F.lit(1).alias("_n"))
    held = own.agg(F.count("*").alias("_n"), F.count_if(F.col("_value.v").isNull()).alias("_nulls"))
    rows = df.join(own, F.struct(F.col(column).alias("v")) == F.col("_value"), "left_anti")
    return rows.crossJoin(F.broadcast(held)).filter((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).drop("_n", "_nulls")
