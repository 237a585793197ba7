"""Both jobs: their SQL, reruns, growing input, and command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import comment_ledger, common, registered, strata_report
from test_queries import rows_of

ROOT = Path(__file__).resolve().parents[1]
CONFIG = {"terms": ["the", "of", "der", "und"], "letters": {"none": [], "en": ["the", "of"], "de": ["der", "und"]}, "weights": [3, 1, 2, 2], "cap": 4}


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_job_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    before = {r["key"]: r["value"] for r in spark.sql("set").collect()}
    df = registered.queries()[name](spark, sf_dir)
    assert {r["key"]: r["value"] for r in spark.sql("set").collect()} == before
    want = con.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


def ledger(spark, out):
    return sorted((r["doc_id"], r["source"], r["terms"], r["n_terms"], r["distance"], r["letter"]) for r in spark.read.parquet(f"{out}/ledger").collect())


def shares(spark, out):
    return sorted(map(str, spark.read.parquet(f"{out}/distribution").select("source", "letter", "cnt", "freq").collect()))


def texts(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(path)


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("texts", "out", "mark"))
    texts(spark, src, [(1, "The cat of THE house", "a"), (2, "Der Hund und die Katze.", "a"), (3, None, None), (4, "", "b")])
    comment_ledger.run(spark, src, out, mark, CONFIG)
    first = ledger_files(out)
    want = [(1, "a", "0.1", 2, 0, "en"), (2, "a", "2.3", 2, 0, "de"), (3, None, "", 0, 0, "none"), (4, "b", "", 0, 0, "none")]
    assert ledger(spark, out) == want
    assert comment_ledger.take(spark, src, f"{out}/ledger", mark, comment_ledger.DEFAULTS | CONFIG) == 0
    comment_ledger.run(spark, src, out, mark, CONFIG)
    assert ledger(spark, out) == want and ledger_files(out) == first
    # More input: only its rows are read, earlier files stay as they are.
    texts(spark, src, [(5, "the und", "a"), (1, "The cat of THE house", "a")])
    texts(spark, src, [(6, "of,of;der", "b")])
    assert comment_ledger.take(spark, src, f"{out}/ledger", mark, comment_ledger.DEFAULTS | CONFIG) == 3
    comment_ledger.run(spark, src, out, mark, CONFIG)
    assert first <= ledger_files(out)
    grown = sorted([*want, (5, "a", "0.3", 2, 3, "en"), (1, "a", "0.1", 2, 0, "en"), (6, "b", "1.2", 2, 3, "none")], key=str)
    assert sorted(ledger(spark, out), key=str) == grown
    # The whole at once gives the same rows, in batches of a file too.
    for files in (0, 1):
        other = str(tmp_path / f"other{files}")
        comment_ledger.run(spark, src, other, f"{other}-mark", CONFIG | {"files_a_batch": files})
        assert sorted(ledger(spark, other), key=str) == grown and shares(spark, other) == shares(spark, out)


def ledger_files(out):
    return {str(p) for p in Path(out, "ledger").rglob("*.parquet")}


def test_distribution_counts_null_sources(spark):
    rows = spark.createDataFrame([(None, "x"), (None, "y"), ("a", "x"), (None, "x")], "source string, letter string")
    got = {(r["source"], r["letter"]): (r["cnt"], round(r["freq"], 6)) for r in comment_ledger.distribution(rows).collect()}
    assert got == {(None, "x"): (2, 0.666667), (None, "y"): (1, 0.333333), ("a", "x"): (1, 1.0)}


def test_ledger_config_is_checked(spark, tmp_path):
    for bad in ({"terms": []}, {"letters": {}}, {"weights": [1]}, {"terms": ["the", "the"]}):
        with pytest.raises(ValueError):
            comment_ledger.run(spark, "nowhere", str(tmp_path), str(tmp_path), CONFIG | bad)
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"cap": 5}))
    assert common.settings(spark, str(file), {"cap": 1, "x": 2}) == {"cap": 5, "x": 2}
    file.write_text(json.dumps({"cpa": 5}))
    with pytest.raises(ValueError):
        common.settings(spark, str(file), {"cap": 1})


def test_report_reruns_alike_and_sums_to_one(spark, sf_dir, tmp_path):
    out, config = str(tmp_path / "report"), {"letters": 6, "epochs": 2, "degree": 3}
    strata_report.run(spark, sf_dir, out, config)
    one = sorted(map(str, spark.read.parquet(out).collect()))
    strata_report.run(spark, sf_dir, out, config)
    two = spark.read.parquet(out)
    assert sorted(map(str, two.collect())) == one
    assert sorted(os.listdir(out))[-2:] == ["sample_tag=col", "sample_tag=row"]
    for r in two.groupBy("sample_tag").agg(F.sum("weight").alias("w"), F.max("rank").alias("r"), F.count("*").alias("n")).collect():
        assert abs(r["w"] - 1) < 1e-6 and r["r"] == r["n"]
    assert max(abs(r["g"]) for r in two.groupBy("word_uid").agg(F.sum("gap").alias("g"), F.count("*").alias("n")).where("n = 2").collect() or [{"g": 0}]) < 1e-6


def test_command_lines(sf_dir, tmp_path):
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_LOCAL_IP": "127.0.0.1"}
    ran = subprocess.run([sys.executable, "-m", "jobs.comment_ledger", "--texts", f"{sf_dir}/documents.parquet*", "--out", str(tmp_path / "o"), "--checkpoint", str(tmp_path / "c")], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and "read" in ran.stderr and "200 new texts" in ran.stderr and "wrote" in ran.stderr
    assert list((tmp_path / "o" / "ledger").glob("letter=*"))
