"""Alphabets of districts: dendrogram cut, centroids, k-centroid refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import set_distance, weight_of
from ..sources.shared import checkpoint


def cut_linkage(linkage: DataFrame, k: int, n: int) -> DataFrame:
    """district_uid, cluster_id: the dendrogram cut to k clusters.

    Merges are applied until k clusters are left. A cut to n or more never stops
    and leaves one cluster. Leaves come first in the numbering, then merged
    clusters in order of creation. The walk to the roots halves the paths in each
    round, so it takes about log2 of the depth joins.
    """
    spark = linkage.sparkSession
    last = n - k if 0 < k < n else n - 1
    taken = linkage.where(F.col("step") < last)
    child = F.explode(F.array(F.col("a"), F.col("b")))
    up = taken.select(child.alias("node"), (F.col("step") + n).cast("bigint").alias("up"))
    nodes = spark.range(n).select(F.col("id").alias("node")).unionByName(taken.select((F.col("step") + n).cast("bigint").alias("node")))
    to = nodes.join(up, "node", "left").select("node", F.coalesce("up", "node").alias("up"))
    for _ in range(max(1, last).bit_length()):
        to = checkpoint(to)
        jump = to.select(F.col("node").alias("up"), F.col("up").alias("far"))
        to = to.join(jump, "up").select("node", F.col("far").alias("up"))
    roots = to.where(F.col("node") < n).select(F.col("node").alias("district_uid"), F.col("up").alias("root"))
    # As many rows as clusters, so a single window is small.
    names = roots.select("root").distinct().withColumn("cluster_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("root")) - 1).cast("int"))
    return roots.join(names, "root").select("district_uid", "cluster_id")


def seed_assignment(districts: DataFrame, k: int) -> DataFrame:
    """district_uid, cluster_id = uid modulo k: a start that needs no dendrogram."""
    return districts.select("district_uid", (F.col("district_uid") % k).cast("int").alias("cluster_id"))


def _counts(districts: DataFrame, assignment: DataFrame) -> DataFrame:
    own = districts.select("district_uid", "members").join(assignment, "district_uid")
    sizes = own.groupBy("cluster_id").agg(F.count("*").alias("size"))
    held = own.select("cluster_id", F.explode("members").alias("precinct")).groupBy("cluster_id", "precinct").agg(F.count("*").alias("n"))
    return held.join(sizes, "cluster_id")


def densities(districts: DataFrame, assignment: DataFrame, k: int, num_precincts: int) -> DataFrame:
    """cluster_id, precinct, dens: share of a cluster's districts that hold a precinct, zeros included."""
    grid = districts.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"), F.explode(F.sequence(F.lit(0), F.lit(num_precincts - 1))).alias("precinct"))
    held = _counts(districts, assignment).select("cluster_id", "precinct", (F.col("n") / F.col("size")).alias("dens"))
    return grid.join(held, ["cluster_id", "precinct"], "left").select("cluster_id", "precinct", F.coalesce("dens", F.lit(0.0)).alias("dens"))


def centroids(districts: DataFrame, assignment: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """cluster_id, members, weight: precincts that at least half of the cluster's districts hold.

    An empty cluster has no members and weight 0.
    """
    major = _counts(districts, assignment).where(2 * F.col("n") >= F.col("size"))
    sets = major.groupBy("cluster_id").agg(F.array_sort(F.collect_list("precinct")).alias("members"))
    every = districts.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    out = every.join(sets, "cluster_id", "left").withColumn("members", F.coalesce("members", F.array().cast("array<int>")))
    out = out.crossJoin(F.broadcast(weights.select("weights")))
    return out.select("cluster_id", "members", weight_of(F.col("members"), F.col("weights")).alias("weight"))


def _with_weights(districts: DataFrame, weights: DataFrame) -> DataFrame:
    rows = districts.select("district_uid", "members").crossJoin(F.broadcast(weights.select("weights", "cap")))
    return rows.withColumn("w", weight_of(F.col("members"), F.col("weights")))


def centroid_distances(districts: DataFrame, centroid_rows: DataFrame, weights: DataFrame) -> DataFrame:
    """district_uid, cluster_id, d: capped distance to every centroid (k rows for each district).

    The centroids are k rows of at most as many members as there are precincts.
    """
    letters = centroid_rows.select("cluster_id", F.col("members").alias("c"), F.col("weight").alias("cw"))
    d = set_distance(F.col("members"), F.col("c"), F.col("w"), F.col("cw"), F.col("weights"), F.col("cap"))
    return _with_weights(districts, weights).crossJoin(F.broadcast(letters)).select("district_uid", "cluster_id", d.alias("d"))


def assign_nearest(districts: DataFrame, centroid_rows: DataFrame, weights: DataFrame, previous: DataFrame) -> DataFrame:
    """district_uid, cluster_id of the nearest centroid; ties to the current one, then the smallest id."""
    d = centroid_distances(districts, centroid_rows, weights).join(previous.withColumnRenamed("cluster_id", "__now"), "district_uid")
    key = F.struct("d", F.when(F.col("cluster_id") == F.col("__now"), 0).otherwise(1).alias("other"), "cluster_id")
    return d.groupBy("district_uid").agg(F.min(key).alias("k")).select("district_uid", F.col("k.cluster_id").alias("cluster_id"))


def wcss_table(districts: DataFrame, assignment: DataFrame, centroid_rows: DataFrame, weights: DataFrame) -> DataFrame:
    """district_uid, members, letter, centroid, dcentroid."""
    letters = centroid_rows.select("cluster_id", F.col("members").alias("centroid"), F.col("weight").alias("cw"))
    rows = _with_weights(districts, weights).join(assignment, "district_uid").join(letters, "cluster_id")
    d = set_distance(F.col("members"), F.col("centroid"), F.col("w"), F.col("cw"), F.col("weights"), F.col("cap"))
    return rows.select("district_uid", "members", F.col("cluster_id").alias("letter"), "centroid", d.alias("dcentroid"))


def wcss(districts: DataFrame, assignment: DataFrame, centroid_rows: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: the total of capped distances to the own centroid."""
    return wcss_table(districts, assignment, centroid_rows, weights).agg(F.coalesce(F.sum("dcentroid"), F.lit(0)).cast("bigint").alias("wcss"))


def kcentroids(districts: DataFrame, assignment: DataFrame, weights: DataFrame, k: int, threshold: float = 0.01, max_iter: int = 50) -> tuple[DataFrame, DataFrame]:
    """Assignment and centroids after refinement.

    Each epoch reassigns all districts and rebuilds the centroids. It ends after
    an epoch without improvement (which still counts), with no change, or with a
    relative improvement under the threshold. Epochs are written to the shared
    folder, so plans stay short; one row a round comes to the driver.
    """
    now = assignment
    letters = checkpoint(centroids(districts, now, weights, k))
    before = wcss(districts, now, letters, weights).first()["wcss"]
    for _ in range(max_iter):
        new = checkpoint(assign_nearest(districts, letters, weights, now))
        changed = bool(new.join(now.withColumnRenamed("cluster_id", "__was"), "district_uid").where("cluster_id <> __was").take(1))
        letters = checkpoint(centroids(districts, new, weights, k))
        after = wcss(districts, new, letters, weights).first()["wcss"]
        now, gain = new, before - after
        if gain <= 0 or not changed or (gain / before if before > 0 else 0.0) < threshold:
            break
        before = after
    return now, letters


def node_members(linkage: DataFrame, n: int) -> DataFrame:
    """node, district_uid: the leaves under every node of the dendrogram, the leaves' own nodes included.

    Ways to the ancestors double in each round, so it takes log2 of the depth
    joins. The result has a row for each leaf and ancestor.
    """
    child = F.explode(F.array(F.col("a"), F.col("b")))
    jump = checkpoint(linkage.select(child.alias("node"), (F.col("step") + n).cast("bigint").alias("up")))
    found = linkage.sparkSession.range(n).select(F.col("id").alias("district_uid"), F.col("id").alias("node"))
    while jump.take(1):
        found = checkpoint(found.unionByName(found.join(jump, "node").select("district_uid", F.col("up").alias("node"))))
        jump = checkpoint(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up")))
    return found


#: Steps whose running sums one task adds up.
STEPS = 1024


def elbow_curve(districts: DataFrame, linkage: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """k, wcss: total of capped distances to the own centroid for each number of clusters that the dendrogram gives, 1 to n.

    One sweep: a merge takes the costs of two nodes away and adds that of the new
    one, so each node's cost is computed once, whatever the number of cuts. The
    running sums are taken in blocks of steps with an offset each.
    """
    own = node_members(linkage, n).join(districts.select("district_uid", "members"), "district_uid")
    sizes = own.groupBy("node").agg(F.count("*").alias("size"))
    held = own.select("node", F.explode("members").alias("precinct")).groupBy("node", "precinct").agg(F.count("*").alias("n"))
    major = held.join(sizes, "node").where(2 * F.col("n") >= F.col("size")).groupBy("node").agg(F.array_sort(F.collect_list("precinct")).alias("c"))
    one = F.broadcast(weights.select("weights", "cap"))
    centre = sizes.join(major, "node", "left").select("node", F.coalesce("c", F.array().cast("array<int>")).alias("c"))
    rows = own.join(centre, "node").crossJoin(one)
    d = set_distance(F.col("members"), F.col("c"), weight_of(F.col("members"), F.col("weights")), weight_of(F.col("c"), F.col("weights")), F.col("weights"), F.col("cap"))
    costs = checkpoint(rows.groupBy("node").agg(F.sum(d).alias("cost")))
    cost = lambda name: costs.select(F.col("node").alias(name), F.col("cost").alias(f"cost_{name}"))
    steps = linkage.select("step", "a", "b", (F.col("step") + n).cast("bigint").alias("r")).join(cost("r"), "r").join(cost("a"), "a").join(cost("b"), "b")
    gain = steps.select("step", F.floor(F.col("step") / STEPS).alias("block"), (F.col("cost_r") - F.col("cost_a") - F.col("cost_b")).alias("gain"))
    gain = checkpoint(gain)
    running = gain.withColumn("run", F.sum("gain").over(Window.partitionBy("block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    totals = gain.groupBy("block").agg(F.sum("gain").alias("total"))
    before = totals.alias("x").join(totals.alias("y"), F.col("y.block") < F.col("x.block"), "left").groupBy("x.block").agg(F.coalesce(F.sum("y.total"), F.lit(0)).alias("before"))
    singles = districts.sparkSession.createDataFrame([(n, 0)] if n else [], "k bigint, wcss bigint")
    summed = running.join(before, "block").select((F.lit(n - 1) - F.col("step")).cast("bigint").alias("k"), (F.col("run") + F.col("before")).cast("bigint").alias("wcss"))
    return singles.unionByName(summed)


def knee(curve: DataFrame) -> DataFrame:
    """One row: k, wcss where a falling curve lies farthest below the line between its ends; of equals the smallest k."""
    ends = curve.agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.max_by("wcss", F.col("k")).alias("w1"), F.min_by("wcss", F.col("k")).alias("w0"))
    line = F.col("w0") + (F.col("w1") - F.col("w0")) * (F.col("k") - F.col("k0")) / F.greatest(F.col("k1") - F.col("k0"), F.lit(1))
    below = curve.crossJoin(F.broadcast(ends)).select("k", "wcss", F.round(line - F.col("wcss"), 6).alias("below"))
    best = below.agg(F.max(F.struct("below", (-F.col("k")).alias("order"), "k", "wcss")).alias("x"))
    return best.where("x is not null").select("x.k", "x.wcss")
