"""Generators of square grids: precinct graph and cell shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid_nodes(spark: SparkSession, n: int, population: list[list[int]] | None = None) -> DataFrame:
    """Nodes of an n x n grid; id = x * n + y. Population 1 unless a matrix is given."""
    x, y = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    people = F.lit(1)
    if population is not None:
        people = F.get(F.lit([int(v) for row in population for v in row]), F.col("id").cast("int"))
    outer = [(x == 0), (x == n - 1), (y == 0), (y == n - 1)]
    return spark.range(n * n).select(
        F.col("id").cast("int").alias("precinct_idx"),
        F.col("id").cast("int").alias("precinct_id"),
        F.format_string("(%d,%d)", x, y).alias("precinct_id_str"),
        sum((c.cast("int") for c in outer[1:]), outer[0].cast("int")).alias("border_length"),
        x.alias("x_location"), y.alias("y_location"), F.lit(1).alias("area"),
        people.cast("bigint").alias("population"), F.lit("A").alias("county"),
    )


def grid_edges(spark: SparkSession, n: int) -> DataFrame:
    """src, dst, length, place: neighbours in the order up, down, left, right."""
    steps = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate([(-1, 0), (1, 0), (0, -1), (0, 1)])])
    cells = spark.range(n * n).select(F.col("id").cast("int").alias("src"), F.inline(steps))
    x, y = F.floor(F.col("src") / n) + F.col("dx"), F.col("src") % n + F.col("dy")
    inside = (x >= 0) & (x < n) & (y >= 0) & (y < n)
    return cells.where(inside).select("src", (x * n + y).cast("int").alias("dst"), F.lit(1).cast("bigint").alias("length"), "place")


def grid_shape(spark: SparkSession, n: int, cell_size: float = 1.0, crs: str = "EPSG:3857") -> DataFrame:
    """id, precinct, corners x0 y0 x1 y1, wkt, crs of the cells; id = row * n + column."""
    i, j = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    cell = F.lit(float(cell_size))
    rows = spark.range(n * n).select(F.col("id").cast("int").alias("id"), F.format_string("(%d,%d)", i, j).alias("precinct"), (j * cell).alias("x0"), (i * cell).alias("y0"))
    rows = rows.withColumn("x1", F.col("x0") + cell).withColumn("y1", F.col("y0") + cell)
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    ring = F.concat_ws(", ", *[F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string")) for a, b in corners])
    return rows.withColumn("wkt", F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).withColumn("crs", F.lit(crs))
