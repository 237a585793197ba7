"""Precinct graphs: a JSON document with nodes, adjacency and a district count."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = (
    "struct<precinct_id:int,precinct_id_str:string,border_length:int,x_location:int,"
    "y_location:int,area:int,population:bigint,county:string>"
)
SCHEMA = f"directed boolean, multigraph boolean, graph array<string>, num_districts int, nodes array<{NODE}>, adjacency array<array<struct<id:int,length:bigint>>>"


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """One row: the document."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def precincts(graph: DataFrame) -> DataFrame:
    """precinct_idx (position among the nodes) and the nodes' fields."""
    return graph.select(F.posexplode("nodes").alias("precinct_idx", "n")).select("precinct_idx", "n.*")


def edges(graph: DataFrame) -> DataFrame:
    """src, dst, length: both directions of every edge."""
    lists = graph.select(F.posexplode("adjacency").alias("src", "a"))
    return lists.select("src", F.explode("a").alias("e")).select("src", F.col("e.id").alias("dst"), F.col("e.length").alias("length"))


def labels(precinct_rows: DataFrame) -> DataFrame:
    """label, precinct_idx. Of a repeated label the last position counts."""
    return precinct_rows.groupBy(F.col("precinct_id_str").alias("label")).agg(F.max("precinct_idx").alias("precinct_idx"))


def weights(precinct_rows: DataFrame) -> DataFrame:
    """One row: weights array<bigint> by precinct, total."""
    pairs = F.array_sort(F.collect_list(F.struct("precinct_idx", F.col("population").cast("bigint").alias("w"))))
    return precinct_rows.agg(F.transform(pairs, lambda x: x["w"]).alias("weights"), F.sum(F.col("population").cast("bigint")).alias("total"))


def distance_cap(total: int, num_districts: int) -> int:
    """Twice the mean district weight, rounded down."""
    return 2 * total // num_districts


def write_graph(nodes: DataFrame, edge_rows: DataFrame, path: str, num_districts: int) -> dict:
    """Write one indented JSON document, to any store that Spark writes, and return it."""
    fields = ["precinct_id", "precinct_id_str", "border_length", "x_location", "y_location", "area", "population", "county"]
    rows = nodes.orderBy("precinct_idx").select(*fields).collect()
    adjacency: list[list[dict]] = [[] for _ in rows]
    for e in edge_rows.orderBy("src", "place").collect():
        adjacency[e["src"]].append({"id": e["dst"], "length": e["length"]})
    document = {
        "directed": False, "multigraph": False, "graph": [], "num_districts": int(num_districts),
        "nodes": [r.asDict() for r in rows], "adjacency": adjacency,
    }
    spark = nodes.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(document, indent=4).encode()))
    finally:
        out.close()
    return document
