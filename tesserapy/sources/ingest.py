"""From a graph document and atlas files to stored tables, and back from the store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, cluster, distance, hcc, strata, words
from . import atlas, graph
from .store import Store

#: Sampled districts and bins of the distance edges, when samples are processed and when edges are missing on reload.
EDGES, EDGES_ON_RELOAD = (100, 50), (500, 400)


@dataclass
class Processed:
    """The stored tables of an ensemble over one graph."""

    store: Store
    weights: DataFrame  # one row: weights, total, cap
    num_precincts: int
    num_districts: int
    samples: DataFrame
    districts: DataFrame
    plans: DataFrame
    distributions: DataFrame
    edges: DataFrame  # one row: edges array<int>

    def distances(self) -> DataFrame:
        """All pairwise distances; computed and stored if absent."""
        return self.store.ensure("distances", lambda: distance.pair_distances(self.districts, self.weights))

    def linkage(self) -> DataFrame:
        """The dendrogram over the distances; computed and stored if absent."""
        return self.store.ensure("linkage", lambda: hcc.linkage(self.distances(), self.districts.count()))


    def alphabet(self, k: int, epochs: int = 50, threshold: float = 0.01, from_linkage: bool = True) -> DataFrame:
        """Centroids of k clusters of the districts: the dendrogram's cut, or the numbers modulo k, after refinement."""
        if from_linkage:
            start = cluster.cut_linkage(self.linkage(), k, self.districts.count())
        else:
            start = cluster.seed_assignment(self.districts, k)
        return cluster.kcentroids(self.districts, start, self.weights, k, threshold, epochs)[1]

    def words(self, letters: DataFrame, degree: int, **options) -> DataFrame:
        """The nearest words of every stored plan over an alphabet."""
        chosen = letters.select(F.col("cluster_id").alias("l"), F.col("cluster_id").alias("pos"))
        lists = words.letters_by_centroid(self.districts, letters, self.weights, chosen)
        return words.enumerate_words(self.distributions, lists, degree, **options)

    def strata(self, word_rows: DataFrame, temperature: float) -> DataFrame:
        """The words with their shares of the plans."""
        return strata.pou_weights(word_rows, self.distributions, temperature)


def _weights(nodes: DataFrame, num_districts: int) -> DataFrame:
    one = graph.weights(nodes).first()
    row = [(list(one["weights"]), one["total"], graph.distance_cap(one["total"], num_districts))]
    return nodes.sparkSession.createDataFrame(row, "weights array<bigint>, total bigint, cap bigint")


def _edges(districts: DataFrame, weights: DataFrame, samples: int, bins: int) -> DataFrame:
    drawn = distance.sampled(districts, samples)
    return distance.quantile_edges(distance.pair_distances(drawn, weights), int(weights.first()["cap"]), bins)


def process_samples(spark: SparkSession, root: str, map_file: str, paths: list[str], max_length: int, min_step: int = 0, edge_samples: int = EDGES[0], edge_bins: int = EDGES[1]) -> Processed:
    """Read atlases over a graph and store samples, districts, plans, distributions and edges under the root.

    The number of districts is that of the last atlas whose header has one, else
    the graph's. No sample after the step filter is an error.
    """
    store, doc = Store(spark, root), graph.read_graph(spark, map_file)
    nodes, lines = graph.precincts(doc), atlas.read_lines(spark, paths)
    precincts = nodes.count()
    num = atlas.header_districts(lines) or int(doc.first()["num_districts"])
    weights = _weights(nodes, num)
    samples = store.write("samples", atlas.require_rows(atlas.read_samples(lines, graph.labels(nodes), precincts, max_length, min_step)))
    expanded = catalog.expand_samples(samples, num)
    districts = store.write("districts", catalog.district_catalog(expanded, weights))
    plans = store.write("plans", catalog.summarize_plans(catalog.attach_district_ids(expanded, districts)))
    distributions = store.write("distributions", catalog.distributions(plans))
    edges = store.write("distance_edges", _edges(districts, weights, edge_samples, edge_bins))
    return Processed(store, weights, precincts, num, samples, districts, plans, distributions, edges)


def load_processed(spark: SparkSession, root: str, map_file: str, edge_samples: int = EDGES_ON_RELOAD[0], edge_bins: int = EDGES_ON_RELOAD[1]) -> Processed:
    """The tables that process_samples has stored; edges are computed and stored if they are missing.

    The number of districts is that of the first plan. Districts whose stored
    weight is not what the graph gives them belong to another graph: an error.
    """
    store, nodes = Store(spark, root), graph.precincts(graph.read_graph(spark, map_file))
    plans, districts = store.read("plans"), store.read("districts")
    num = catalog.num_districts_of(plans)
    weights = _weights(nodes, num)
    own = F.aggregate("members", F.lit(0).cast("bigint"), lambda s, p: s + F.get("weights", p))
    if districts.crossJoin(F.broadcast(weights.select("weights"))).where(~own.eqNullSafe(F.col("weight"))).take(1):
        raise ValueError("the stored districts do not belong to this graph")
    edges = store.ensure("distance_edges", lambda: _edges(districts, weights, edge_samples, edge_bins))
    return Processed(store, weights, nodes.count(), num, store.read("samples"), districts, plans, store.read("distributions"), edges)
