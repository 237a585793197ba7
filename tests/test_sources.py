import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserapy.operators import grid
from tesserapy.sources import atlas, graph
from tesserapy.sources.store import Store


def test_grid_round_trip_through_json(spark, tmp_path):
    path = str(tmp_path / "g.json")
    graph.write_graph(grid.grid_nodes(spark, 5), grid.grid_edges(spark, 5), path, 3)
    doc = graph.read_graph(spark, path)
    nodes, edges = graph.precincts(doc), graph.edges(doc)
    assert nodes.count() == 25 and edges.count() == 80
    total = graph.weights(nodes).first()["total"]
    assert total == 25 and graph.distance_cap(total, doc.first()["num_districts"]) == 16
    corner = nodes.where("precinct_idx = 0").first()
    assert (corner["precinct_id_str"], corner["border_length"]) == ("(0,0)", 2)
    order = json.load(open(path))["adjacency"][6]
    assert [e["id"] for e in order] == [1, 11, 5, 7]


def test_grid_takes_a_population_matrix_and_shapes_have_corners(spark):
    nodes = grid.grid_nodes(spark, 2, [[1, 2], [3, 4]])
    assert [r["population"] for r in nodes.orderBy("precinct_idx").collect()] == [1, 2, 3, 4]
    cell = grid.grid_shape(spark, 2, 2.0).where("id = 1").first()
    assert (cell["x0"], cell["y0"], cell["x1"], cell["y1"], cell["precinct"]) == (2.0, 0.0, 4.0, 2.0, "(0,1)")
    assert cell["wkt"].startswith("POLYGON ((2.0 0.0, 4.0 0.0")


LABELS = ["(0,0)", "(0,1)", "(1,0)"]


def write_atlas(path, steps, listed=False, districts=2, drop=None, label=None):
    key = (lambda s: json.dumps([s])) if listed else (lambda s: s)
    lines = ["{}", "{}", json.dumps({"districts": districts})]
    for k, step in enumerate(steps):
        plan = [{key(label or s): 1 + (k + p) % districts} for p, s in enumerate(LABELS) if s != drop]
        lines.append(json.dumps({"name": f"step{step}", "districting": plan}))
    body = "\n".join(lines) + "\n"
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(body)
    return str(path)


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame(list(zip(LABELS, range(3), strict=True)), "label string, precinct_idx int")


def test_atlas_reads_steps_limits_tags_and_both_keys(spark, tmp_path, labels):
    a = write_atlas(tmp_path / "one.jsonl.gz", [5, 10, 20, 30, 40])
    b = write_atlas(tmp_path / "two.jsonl", [11], listed=True, districts=3, drop="(0,1)")
    lines = atlas.read_lines(spark, [a, b])
    assert atlas.header_districts(lines) == 3
    rows = atlas.read_samples(lines, labels, 3, max_length=2, min_step=10).orderBy("plan_id").collect()
    assert [(r["plan_id"], r["step"], r["sample_tag"]) for r in rows] == [(0, 20, "one"), (1, 30, "one"), (2, 11, "two")]
    assert rows[0]["plan_vector"] == [0, 1, 0] and rows[2]["plan_vector"] == [0, -1, 2]


def test_plain_atlas_in_many_splits(spark, tmp_path, labels):
    steps = [s * 3 for s in range(1, 200)]
    paths = [write_atlas(tmp_path / "a.jsonl", steps, listed=True), write_atlas(tmp_path / "b.jsonl", steps[::-1])]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
        spark.conf.set("spark.sql.files.openCostInBytes", 100)
        lines = atlas.read_lines(spark, paths)
        assert lines.select("file_ordinal", "block").distinct().count() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {(r["file_ordinal"], r["line_idx"]): r["value"] for r in lines.collect()}
    want = {(k, n): x for k, p in enumerate(paths) for n, x in enumerate(open(p).read().splitlines())}
    assert got == want
    rows = atlas.read_samples(lines, labels, 3, max_length=150, min_step=30).orderBy("plan_id").collect()
    assert [(r["sample_tag"], r["step"]) for r in rows] == [("a", s) for s in steps if s > 30][:150] + [("b", s) for s in steps[::-1] if s > 30][:150]
    assert [r["plan_id"] for r in rows] == list(range(300))


def test_unknown_label_and_empty_result_are_errors(spark, tmp_path, labels):
    lines = atlas.read_lines(spark, [write_atlas(tmp_path / "x.jsonl.gz", [1], label="(9,9)")])
    with pytest.raises(Exception, match="unknown precinct label"):
        atlas.read_samples(lines, labels, 3, 10).collect()
    none = atlas.read_samples(atlas.read_lines(spark, [write_atlas(tmp_path / "y.jsonl.gz", [1])]), labels, 3, 10, min_step=1)
    with pytest.raises(ValueError, match="no sample"):
        atlas.require_rows(none)
    with pytest.raises(ValueError, match="no atlas"):
        atlas.read_lines(spark, [])


def test_store_makes_tables_once_and_cleans(spark, tmp_path):
    store, calls = Store(spark, str(tmp_path / "s")), []

    def make():
        calls.append(1)
        return spark.range(3)

    assert not store.has("plans")
    assert store.ensure("plans", make).count() == 3 and store.ensure("plans", make).count() == 3 and len(calls) == 1
    store.clean()
    assert not store.has("plans")
    with pytest.raises(KeyError):
        store.path("other")


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    from tesserapy.streaming.atlas_stream import plan_counts

    rows = spark.createDataFrame([("t", [0, 1, 0]), ("t", [1, 0, 1]), ("t", [0, 0, 1])], "sample_tag string, plan_vector array<int>")
    src = str(tmp_path / "in")
    rows.write.parquet(src)
    stream = plan_counts(spark.readStream.schema(rows.schema).parquet(src), 2)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("counts")) == key(plan_counts(rows, 2)) == [("t", "0.1|2", 1), ("t", "0.2|1", 2)]
    assert F is not None


def test_stream_accepts_each_step_once_over_restarts(spark, tmp_path):
    from tesserapy.streaming.atlas_stream import accept, accepted_batch, take_new

    rng = np.random.default_rng(0)
    rows = [(tag, int(step), [int(x) for x in rng.integers(0, 2, 3)]) for tag, top in (("a", 90), ("b", 25), (None, 10)) for step in range(1, top)]
    whole = spark.createDataFrame(rows, "sample_tag string, step int, plan_vector array<int>")
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for low, high in ((0, 20), (10, 40), (40, 40), (30, 100)):
        whole.where((F.col("step") > low) & (F.col("step") <= high)).repartition(3).write.mode("append").parquet(src)
        take_new(spark, src, out, mark, burn_in=4, most=50)
    key = lambda df: sorted((str(r["sample_tag"]), r["step"], r["place"], r["plan_vector"]) for r in df.collect())
    want = accepted_batch(whole, 4, 50)
    assert key(spark.read.parquet(out)) == key(want)
    assert [(t, len([r for r in rows if r[0] == t and r[1] > 4][:50])) for t in ("a", "b")] == [("a", 50), ("b", 20)] and want.count() == 50 + 20 + 5
    take_new(spark, src, out, mark, burn_in=4, most=50)
    assert key(spark.read.parquet(out)) == key(want)
    twice = accepted_batch(whole.unionByName(whole).unionByName(spark.createDataFrame([("b", 6, [9, 9, 9])], whole.schema)), 4)
    assert key(twice) == key(accepted_batch(whole, 4)) and accept is not None


def test_a_store_is_checked_against_its_graph(spark, tmp_path):
    from tesserapy.sources import ingest

    maps = []
    for name, matrix in (("one", [[3, 1], [1, 2]]), ("two", [[3, 1], [2, 2]]), ("small", [[3, 1]])):
        maps.append(str(tmp_path / f"{name}.json"))
        nodes = grid.grid_nodes(spark, 2, matrix if len(matrix) == 2 else [[3, 1], [1, 2]])
        edges = grid.grid_edges(spark, 2)
        if name == "small":
            nodes, edges = nodes.where("precinct_idx < 3"), edges.where("src < 3 and dst < 3")
        graph.write_graph(nodes, edges, maps[-1], 2)
    labels = grid.grid_nodes(spark, 2).select("precinct_idx", F.col("precinct_id_str").alias("label"))
    samples = spark.createDataFrame([(0, 1, "t", [0, 0, 1, 1]), (1, 2, "t", [0, 1, 0, 1])], "plan_id bigint, step bigint, sample_tag string, plan_vector array<int>")
    atlas.write_samples(samples, labels, str(tmp_path / "t.jsonl.gz"), {"districts": 2}, one_file=True)
    root = str(tmp_path / "store")
    ingest.process_samples(spark, root, maps[0], [str(tmp_path / "t.jsonl.gz")], 10)
    assert ingest.load_processed(spark, root, maps[0]).samples.count() == 2
    for other in maps[1:]:
        with pytest.raises(ValueError, match="another|belong"):
            ingest.load_processed(spark, root, other)
