"""Dense integer keys from an order, without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpoint

#: Bits of an id that count the rows of a partition; the others name the partition.
ROWS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... by the order, in which no two rows are equal.

    Rows are dealt by ranges of the order, so that no prefix or value is hot, and
    written in order; each partition's size (a row for each) gives its offset.
    """
    sorted_rows = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order))
    rows = sorted_rows.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", ROWS)
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    joined = rows.join(F.broadcast(offsets), part == F.col("__p"))
    place = F.col("__id").bitwiseAND(F.lit((1 << ROWS) - 1))
    return joined.withColumn(name, (F.col("__offset") + place).cast("bigint")).drop("__id", "__p", "__offset")
