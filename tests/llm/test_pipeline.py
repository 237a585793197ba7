"""The pipeline's stages against brute force, and what they keep."""

import importlib
import re

import corpus_pipeline as cp
from tesserapy.llm import langid


def stage(spark, tmp_path, name, docs, sf_dir):
    out = str(tmp_path / "out")
    dict(cp.STAGES)[name](spark, docs, sf_dir).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def brute_lines(rows):
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        cut, gone = r["text"].split("\n"), set()
        for p in range(len(cut) - 2):
            if tuple(cut[p : p + 3]) in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(tuple(cut[p : p + 3]))
        out[r["doc_id"]] = "\n".join(x for p, x in enumerate(cut) if p not in gone)
    return out


def brute_near(rows):
    """Smallest ids of the groups over all pairs, by their shingles alone."""
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
        sets[r["doc_id"]] = {tuple(words[k : k + cp.SHINGLE]) for k in range(max(1, len(words) - cp.SHINGLE + 1))} if words else set()
    ids, holders = sorted(sets), {}
    home = {i: i for i in ids}
    for a in ids:
        for x in sets[a] or {()}:
            holders.setdefault(x, []).append(a)
    for a, b in {(a, b) for found in holders.values() for k, a in enumerate(found) for b in found[k + 1 :]}:
        both = len(sets[a] & sets[b])
        if both >= cp.SIMILARITY * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((home[a], home[b]))
            home = {i: x if h == y else h for i, h in home.items()}
    return {i for i in ids if home[i] == i}


def test_stages_follow_brute_force(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(900001, "123 456 !!", "en", "src0", 10), (900002, None, "en", "src0", None)], docs.schema)
    docs = docs.unionByName(extra)
    one = stage(spark, tmp_path / "1", "language ID", docs, sf_dir)
    assert one.columns == docs.columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in one.collect()}
    labels, share = langid.train(docs).label([r["text"] for r in docs.collect()])
    assert gone == {r["doc_id"] for r, x, s in zip(docs.collect(), labels, share, strict=True) if x == "und" or s < 0.5} and {900001, 900002} <= gone
    two = stage(spark, tmp_path / "2", "line dedup", one, sf_dir)
    assert {r["doc_id"]: r["text"] for r in two.collect()} == brute_lines(one.collect()) and two.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = stage(spark, tmp_path / "3", "SimHash near-dedup", two, sf_dir)
    assert {r["doc_id"] for r in three.collect()} == brute_near(two.collect()) and three.columns == docs.columns
    four = stage(spark, tmp_path / "4", "benchmark decontamination", three, sf_dir)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = lambda t: any(i in " ".join(t.lower().split()) for i in items)
    left = {r["doc_id"] for r in four.collect()}
    assert all((r["doc_id"] in left) != holds(r["text"]) for r in three.collect()) and four.columns == docs.columns
    five = stage(spark, tmp_path / "5", "mixing", four, sf_dir)
    assert five.groupBy("doc_id").count().where("count > 2").count() == 0
    assert {r["doc_id"] for r in five.collect()} <= left


def test_run_and_registry(spark, sf_dir):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is cp.run and cp.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
    assert cp.run(spark, sf_dir).count() > 0
    assert [n for n in entry.queries() if n.startswith("op")] == [f"op{n}_" + x for n, x in enumerate(("substring_dedup", "language_id", "decontamination", "ann", "warc", "simhash", "url_filter", "mixing", "quality", "line_dedup", "pii", "crosstok"), 1)]


def test_run_with_odd_names_null_texts_and_no_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("a.b", "a b", "label", "root", "cell", "token")
    odd = docs
    for name in names:
        odd = odd.withColumn(name, docs["doc_id"] * 2)
    nulls = spark.createDataFrame([(None, None, None, None, None), (10**6, None, "en", "src0", None), (10**6 + 1, "", "en", None, 0)], docs.schema)
    for name in names:
        nulls = nulls.withColumn(name, nulls["doc_id"] * 2)
    for place, rows in (("odd", odd.unionByName(nulls)), ("none", odd.limit(0))):
        rows.write.parquet(str(tmp_path / place / "documents.parquet"))
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / place / "benchmark.parquet"))
    got = cp.run(spark, str(tmp_path / "odd"))
    assert set(names) < set(got.columns)
    rows = got.select("doc_id", "`a.b`", "`a b`").collect()
    assert rows and all(r[1] == r[2] == 2 * r[0] for r in rows)
    plain = cp.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.select("doc_id").collect())
    empty = cp.run(spark, str(tmp_path / "none"))
    assert empty.collect() == [] and set(names) < set(empty.columns)
