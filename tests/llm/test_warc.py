import hashlib

import numpy as np
from pyspark.sql import functions as F

from tesserapy.llm import warc


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    body = "é" * 60
    rows = [(1, "http://a/ b", fake * 3), (2, None, body), (5, "u", body), (3, "u", body), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (9, "u", "x" * 300000), (10, "u", "WARC/1.0\r\n"), (11, "u", fake * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages, str(tmp_path / "w")).collect()}
    assert set(got) == {r[0] for r in rows}
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or ""))
        rev = len(data) >= 100 and first != page
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if rev else "response", first if rev else None)
    full = {r["page_id"]: bytes(r["payload"]) for r in warc.read(spark, str(tmp_path / "w"), payloads=True).collect() if r["record_type"] == "response"}
    assert full[1] == (fake * 3).encode() and full[2] == body.encode() and full[7] == b""


def test_repeated_rows_null_ids_and_no_rows(spark, tmp_path):
    body = "z" * 150
    pages = spark.createDataFrame([(1, "u", body, 5), (1, "u", body, 5), (None, "u", body, 5), (None, None, None, None)], "page_id long, url string, html string, digest int")
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.round_trip(pages, str(tmp_path / "w")).collect())
    assert got == [("1", "response", "None"), ("1", "response", "None"), ("None", "response", "None"), ("None", "revisit", "1")]
    assert warc.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_pointer_jumping_equals_a_walk():
    rng = np.random.default_rng(1)
    for _ in range(300):
        size = 100
        start = np.unique(np.append(rng.choice(size, 12), 0 if rng.random() < 0.9 else 1))
        after = np.array([rng.choice(np.append(start[start > s], [size, -1, s + 1])) for s in start])
        want, at = set(), 0
        where = {int(s): int(a) for s, a in zip(start, after, strict=True)}
        while at in where:
            if where[at] < 0:
                break
            want.add(at)
            at = where[at]
        assert set(start[warc.reachable(start, after, size)].tolist()) == want


def test_damage_ends_the_chain(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"body {k} " * 30) for k in range(4)], "page_id long, url string, html string").coalesce(1)
    path = tmp_path / "w"
    warc.write(warc.decide(pages).orderBy("page_id").coalesce(1), str(path))
    part = next(path.glob("part-*.txt"))
    data = part.read_bytes()
    last = [m.start() for m in warc._MAGIC.finditer(data)][3]
    part.write_bytes(data[: last - 20] + b"X" + data[last - 20 :])
    for crc in path.glob(".*.crc"):
        crc.unlink()
    assert sorted(r["page_id"] for r in warc.read(spark, str(path)).collect()) == [0, 1]


def test_folded_digests_collide_without_harm(spark, tmp_path):
    """With very few bits every page meets the join, and the result stays the same."""
    pages = spark.createDataFrame([(k, "u", f"body {k % 40 if k < 90 else k} " * 30) for k in range(200)], "page_id long, url string, html string")
    want = sorted(map(str, warc.decide(pages).collect()))
    assert sum("refers_to=None" not in r for r in want) == 50
    for bits in (64, 256):
        assert sorted(map(str, warc.decide(pages, folded=bits).collect())) == want


def test_very_many_repeated_digests(spark):
    """120,000 pages, of which each payload comes twice, and a third with one payload; read back whole."""
    n = 120000
    body = F.when(F.col("id") % 3 == 0, F.lit("same " * 30)).otherwise(F.concat(F.lit("body "), (F.col("id") % (n // 2)).cast("string"), F.lit(" filled up to one hundred bytes " * 4)))
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), body.alias("html"))
    got = warc.round_trip(pages)
    kinds = {r["record_type"]: r["n"] for r in got.groupBy("record_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"response": 1 + 40000, "revisit": n - 40001}
    wrong = F.when(F.col("page_id") % 3 == 0, ~F.col("refers_to").eqNullSafe(F.when(F.col("page_id") != 0, 0))).otherwise(~F.col("refers_to").eqNullSafe(F.when(F.col("page_id") >= n // 2, F.col("page_id") - n // 2)))
    assert got.where(wrong).count() == 0
    assert "/warc-" not in " ".join(got.inputFiles())


def test_long_payload_and_clashing_columns(spark):
    rows = [(1, "u", "x" * 3_000_000, 1, "a", "b", 2, 3), (2, "v", "x" * 3_000_000, 1, "a", "b", 2, 3)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, digest int, payload string, first string, bits int, at int")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: (3000000, "response", None), 2: (3000000, "revisit", 1)}
