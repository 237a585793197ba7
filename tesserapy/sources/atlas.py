"""Atlas files of sampled plans: JSON lines, gzip or plain.

Lines 0 to 2 are a header; line 2 may name the number of districts. Every other
line is {"name": "step<N>", "districting": [{label: district}, ...]}.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpoint

RECORD = "struct<name:string,districting:array<map<string,int>>>"


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_ordinal, tag, block, line_idx, value: numbered lines of the files in the order given.

    Plain files are read in splits, gzip files in one. Within a split lines keep
    their order, so a line's number is its place in the split after the counts of
    the splits before; only those counts, a row for each split, are summed up in
    order, and no task takes a whole plain file.
    """
    out = None
    for k, path in enumerate(paths):
        name = path.rsplit("/", 1)[-1].split(".")[0]
        lines = spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
        lines = lines.select(F.lit(k).alias("file_ordinal"), F.lit(name).alias("tag"), "file_path", "block", "id", "value")
        out = lines if out is None else out.unionByName(lines)
    if out is None:
        raise ValueError("no atlas file was given")
    # The ids of a read and the counts over them must be of one reading.
    out = checkpoint(out)
    split = ["file_ordinal", "file_path", "block"]
    sizes = out.groupBy(*split).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file_ordinal").orderBy("file_path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"s_{c}") for c in split], "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    met = out.join(starts, [out[c] == starts[f"s_{c}"] for c in split])
    return met.select("file_ordinal", "tag", F.col("before").alias("block"), (F.col("before") + F.col("id") - F.col("first")).alias("line_idx"), "value")


def header_districts(lines: DataFrame) -> int | None:
    """The district count in the header of the last file that has one."""
    found = lines.where("line_idx = 2").select("file_ordinal", F.try_variant_get(F.try_parse_json("value"), F.lit("$.districts"), "int").alias("n"))
    row = found.where("n is not null").orderBy(F.desc("file_ordinal")).first()
    return None if row is None else int(row["n"])


def read_samples(lines: DataFrame, labels: DataFrame, num_precincts: int, max_length: int, min_step: int = 0) -> DataFrame:
    """plan_id, step, sample_tag, plan_vector.

    Steps up to min_step are dropped, then the first max_length rows of each file
    are kept. Districts are counted from 0; a precinct without one has -1. A key
    may be a label or a JSON list whose first item is the label; an unknown label
    is an error. No rows at all is an error too.
    """
    rows = lines.where("line_idx >= 3").withColumn("r", F.from_json("value", RECORD))
    step = F.regexp_replace("r.name", "^step", "").cast("bigint")
    rows = rows.withColumn("step", step).where(F.col("step") > min_step)
    # Places are counted within a split, after the rows of the file's earlier splits.
    place = F.row_number().over(Window.partitionBy("file_ordinal", "block").orderBy("line_idx"))
    rows = rows.withColumn("__n", place)
    # One row for each split, then one for each file.
    split = rows.groupBy(F.col("file_ordinal").alias("__f"), F.col("block").alias("__b")).agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    sizes = split.groupBy(F.col("__f").alias("__g")).agg(F.least(F.sum("__size"), F.lit(max_length)).alias("__kept"))
    before = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__g", F.coalesce(F.sum("__kept").over(before), F.lit(0)).alias("__start"))
    places = split.join(starts, F.col("__f") == F.col("__g")).select("__f", "__b", "__before", "__start")
    rows = rows.join(places, (F.col("file_ordinal") == F.col("__f")) & (F.col("block") == F.col("__b")))
    rows = rows.where(F.col("__before") + F.col("__n") <= max_length)
    rows = rows.withColumn("plan_id", (F.col("__start") + F.col("__before") + F.col("__n") - 1).cast("bigint"))
    entry = F.col("e")
    each = rows.select("plan_id", "step", "tag", F.posexplode("r.districting").alias("at", "e"))
    key = F.map_keys(entry)[0]
    each = each.select("plan_id", "step", "tag", "at", F.coalesce(_first_of_list(key), key).alias("label"), F.map_values(entry)[0].alias("district"))
    joined = each.join(labels.withColumnRenamed("label", "__label"), F.col("label") == F.col("__label"), "left")
    known = F.when(F.col("precinct_idx").isNull(), F.raise_error(F.concat(F.lit("unknown precinct label "), F.col("label"))).cast("int")).otherwise(F.col("precinct_idx"))
    joined = joined.select("plan_id", "step", "tag", known.alias("p"), F.struct("at", "district").alias("d"))
    last = joined.groupBy("plan_id", "step", "tag", "p").agg(F.max("d")["district"].alias("district"))
    owned = F.map_from_entries(F.collect_list(F.struct("p", "district")))
    plans = last.groupBy("plan_id", "step", "tag").agg(owned.alias("m"))
    # A sample without any entry has no rows above.
    plans = rows.select("plan_id", "step", "tag").join(plans.select("plan_id", "m"), "plan_id", "left").withColumn("m", F.coalesce("m", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))))
    vector = F.transform(F.sequence(F.lit(0), F.lit(num_precincts - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0)) - 1)
    return plans.select("plan_id", "step", F.col("tag").alias("sample_tag"), vector.alias("plan_vector"))


def _first_of_list(key):
    """The first item of a key that is a JSON list, else null."""
    listed = key.startswith("[") & key.endswith("]")
    return F.when(listed, F.try_variant_get(F.try_parse_json(key), F.lit("$[0]"), "string"))


def require_rows(samples: DataFrame) -> DataFrame:
    """The samples, or an error if there are none."""
    if not samples.take(1):
        raise ValueError("no sample is left after the step filter")
    return samples


def write_samples(samples: DataFrame, labels: DataFrame, path: str, header: dict, listed_keys: bool = False, scores: tuple[str, ...] = (), one_file: bool = False) -> None:
    """Write an atlas as gzip text, in order of step.

    The file is one sequence, so one task writes it: a part in a folder of the
    path's name, or with one_file the path itself. listed_keys writes labels as
    JSON lists. scores are columns that each record carries as its data.
    """
    each = samples.select("step", F.posexplode("plan_vector").alias("precinct_idx", "d")).where("d >= 0").join(labels, "precinct_idx")
    quoted = F.to_json(F.array("label")) if listed_keys else F.col("label")
    entry = F.create_map(quoted, F.col("d") + 1)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("precinct_idx", F.to_json(entry).alias("j")))), lambda x: x["j"])
    rows = each.groupBy("step").agg(lists.alias("l"))
    data = F.lit("")
    if scores:
        rows = rows.join(samples.select("step", F.struct(*scores).alias("s")), "step")
        data = F.concat(F.lit('"data":'), F.to_json("s"), F.lit(","))
    line = F.concat(F.lit('{"name":"step'), F.col("step"), F.lit('",'), data, F.lit('"districting":['), F.array_join("l", ","), F.lit("]}"))
    spark = samples.sparkSession
    head = [(-3, json.dumps({"atlas": "plans"})), (-2, json.dumps({})), (-1, json.dumps(header))]
    out = spark.createDataFrame(head, "step bigint, value string").unionByName(rows.select("step", line.alias("value")))
    folder = f"{path}.parts" if one_file else path
    out.repartition(1).sortWithinPartitions("step").select("value").write.mode("overwrite").option("compression", "gzip").text(folder)
    if one_file:
        named = spark._jvm.org.apache.hadoop.fs.Path
        fs = named(path).getFileSystem(spark._jsc.hadoopConfiguration())
        [part] = [f.getPath() for f in fs.listStatus(named(folder)) if f.getPath().getName().startswith("part-")]
        fs.delete(named(path), True)
        fs.rename(part, named(path))
        fs.delete(named(folder), True)
