"""Mixing sources to target weights.

Tokens are summed for each source, a target is derived for each source, and the
ratio of the two is the source's repetition rate. A document is emitted
``floor(rate)`` times, and once more if a hash of its id falls below the
fraction. Everything is DataFrame operations; the only values without a key are
sums over the table of sources, which has a row for each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, unit_hash, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 17
#: The table of sources is broadcast up to so many rows and bytes of names.
SMALL_ROWS, SMALL_BYTES = 50_000, 4 << 20


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of each source.

    sizes has ``source`` and ``source_size``. Sources in order of code points,
    null last, take the weights in turn. Together they get ``share`` of all
    sizes; none gets over ``most`` times its own size, and what is cut off goes
    to the others by weight, until none is above. In order of size by weight the
    sources that are cut off come first, so running sums find the level at once.
    A source of size zero has target zero; without sources there are no rows.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    whole = Window.partitionBy(F.lit(0))
    filled = Window.partitionBy(F.lit(0)).orderBy((F.col("source_size") / F.col("__w")).asc(), F.col("__rank"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(0, Window.unboundedFollowing)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("__rank", F.row_number().over(by_name)).withColumn("__w", weight)
    df = df.withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    df = df.withColumn("__all", F.sum("source_size").over(whole) * F.lit(float(share)))
    df = df.withColumn("__used", F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    df = df.withColumn("__left", F.sum("__w").over(after))
    df = df.withColumn("__full", (F.col("__all") - F.col("__used")) * F.col("__w") >= F.col("__cap") * F.col("__left"))
    df = df.withColumn("__rest", F.col("__all") - F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0.0)).over(whole))
    df = df.withColumn("__open", F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("__w"))).over(whole))
    got = F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__w") * F.col("__rest") / F.nullif(F.col("__open"), F.lit(0.0)))
    return df.select("source", "source_size", got.alias("target"))


def _goals(sized: DataFrame, weights, share: float, most: float, names: tuple[str, str, str]) -> DataFrame:
    """Source, size and target under the names; broadcast if the table has been found small, else joined by source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = checkpoint(targets(per, weights, share, most).toDF(*names))
    size = goal.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(names[0])), F.lit(0)).alias("b")).first()
    return F.broadcast(goal) if size["n"] <= SMALL_ROWS and size["b"] <= SMALL_BYTES else goal


def rates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
) -> DataFrame:
    """Copies of each document: doc_id, source, size, source_size, target, copies.

    A row of the input is a row of the result, repeated rows too (the same id
    draws alike). Null texts and texts without a word have size 0. Null sources
    are one source. The hot source is summed before the shuffle. Documents meet
    the table of sources without a shuffle while it is small; beyond that the join
    is an ordinary one, which adaptive execution splits where skewed.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    goal = _goals(sized, weights, share, most, ("goal", "source_size", "target"))
    joined = sized.join(goal, F.col("source").eqNullSafe(F.col("goal")), "left").drop("goal")
    return joined.withColumn("copies", copies(F.col("doc_id"), F.col("target"), F.col("source_size"), seed))


def copies(key, target, source_size, seed: int = SEED):
    """floor(rate), plus one where the key's hash is below the fraction."""
    rate = F.coalesce(target / F.nullif(source_size, F.lit(0)), F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(unit_hash(F.lit(seed), key) < rate - whole, 1).otherwise(0)).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
) -> DataFrame:
    """The mixed corpus: the documents' own columns, each row as often as it is taken.

    Nulls, texts without a word, repeated rows and sources are as in ``rates``. A
    long text is one row. Columns stay, whatever their names. No documents: no rows.
    """
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    name, size, target, times, copy = fresh(docs, "goal", "size", "target", "times", "copy")
    goal = _goals(sized, weights, share, most, (name, size, target))
    joined = docs.join(goal, F.col(source_col).eqNullSafe(F.col(name)), "left")
    n = copies(F.col(id_col), F.col(target), F.col(size), seed)
    repeated = joined.withColumn(times, n).where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return repeated.drop(name, size, target, times, copy)


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target of the source, taken words."""
    return rates(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SIZES_SQL = r"""
sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from {docs}),
per as (select source, cast(sum(size) as double) as source_size from sized group by source),
ranked as (select *, (array[5.0, 2.0, 1.0])[(row_number() over (order by source asc nulls last) - 1) % 3 + 1]::double as w from per),
caps as (select *, 2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as budget,
  row_number() over (order by source_size / w, source asc nulls last) as o from ranked),
runs as (select *, coalesce(sum(cap) over (order by o rows between unbounded preceding and 1 preceding), 0)::double as used,
  sum(w) over (order by o rows between current row and unbounded following) as rest_w from caps),
flagged as (select *, (budget - used) * w >= cap * rest_w as is_full from runs),
goal as (select source, source_size, case when is_full then cap else w * (budget - sum(case when is_full then cap else 0 end) over ())
  / nullif(sum(case when is_full then 0 else w end) over (), 0) end as target from flagged),
drawn as (select sized.*, goal.source_size, goal.target, coalesce(target / nullif(goal.source_size, 0), 0) as rate,
  (('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint)::double / 4294967296.0 as u
  from sized join goal on sized.source is not distinct from goal.source),
taken as (select *, floor(rate) + case when u < rate - floor(rate) then 1 else 0 end as copies from drawn)
"""

ORACLE = (
    "with " + SIZES_SQL.replace("{docs}", "documents")
    + "select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target, cast(size * copies as bigint) as taken from taken"
)
