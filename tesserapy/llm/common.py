"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpoint, shared_dir

__all__ = ["FOLDED", "WORD", "checkpoint", "discard", "fold_of", "fresh", "parted", "shared_dir", "table", "unit_hash", "word_count"]

#: A word: a run of anything but the space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written under a path, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bits that a set of keys is folded into, in rows of 64: a million rows of two numbers at most.
FOLDED = 1 << 26


def parted(df: DataFrame, key: Column, keys: DataFrame, folded: int = FOLDED) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the keys, and those whose key is not; a null key never is.

    key: 64-bit hashes; keys: one column of such hashes. The keys set bits of a
    table of a fixed size, which is broadcast whatever their number. So rows that
    need no join with what stands behind the keys are told without a shuffle.
    """
    [name] = keys.columns
    place = F.pmod(F.col(name), F.lit(folded))
    at, word, bits = fresh(df, "at", "word", "bits")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int"))
    table = keys.select(place.alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(bit(F.col(at))).alias(bits))
    marked = df.withColumn(at, F.pmod(key, F.lit(folded))).join(F.broadcast(table), F.shiftright(at, 6) == F.col(word), "left")
    has = F.coalesce(F.col(bits).bitwiseAND(bit(F.col(at))) != 0, F.lit(False))
    return marked.where(has).drop(at, word, bits), marked.where(~has).drop(at, word, bits)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores after it until no column of the frame has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds (null for a null key)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone (32 bits of MD5)."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
