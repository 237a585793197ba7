from pyspark.sql import functions as F

from tesserapy.llm import urls


def test_host_path_and_rules(spark):
    cases = [
        ("https://WWW.Example.ORG/es/1?x#y", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("http://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
        ("http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"),
        ("http://a.com?u=/de/", "a.com", "", None, "allow"),
        ("no scheme/de/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "page_id long, url string")
    empty = spark.createDataFrame([], urls.RULE_SCHEMA)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, empty).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}


def brute_rules(transactions, support, confidence):
    """Token sets by counting all subsets."""
    from itertools import combinations

    n, hold, bad = len(transactions), {}, {}
    for items, blocked in transactions:
        for size in range(1, len(items) + 1):
            for c in combinations(sorted(items), size):
                hold[c] = hold.get(c, 0) + 1
                bad[c] = bad.get(c, 0) + blocked
    return {c for c in hold if bad[c] >= support * n - 1e-9 and bad[c] and bad[c] / hold[c] >= confidence}


def test_mined_rules_equal_brute_force_and_match(spark):
    rows = [(f"http://spam{k % 2}.net/a/{k}", True) for k in range(8)] + [(f"http://good.net/a/{k}", k == 0) for k in range(12)] + [(None, True), ("http://x.net/", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = urls.mine(labelled, 0.1, 0.7)
    t = spark.createDataFrame([r for r in rows if r[0] and r[1] is not None], "url string, blocked boolean").select(urls.tokens(F.col("url")).alias("t"), "blocked").collect()
    got = {tuple(sorted(r["items"])) for r in rules.collect()}
    assert got == brute_rules([(r["t"], r["blocked"]) for r in t], 0.1, 0.7) and ("host:spam0",) in got
    pages = spark.createDataFrame([(1, "http://spam0.net/b"), (2, "http://good.net/a/3"), (3, "http://spam0.net/b"), (4, "http://spam1.org/a/1")], "page_id long, url string")
    verdict = {r["page_id"]: (r["verdict"], r["rule"]) for r in urls.judge(pages, rules).collect()}
    assert verdict == {1: ("block", None), 2: ("allow", None), 3: ("block", None), 4: ("allow", "org/")}


def test_labels_by_document_number_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/en/17.html", 0), (2, "http://a.net/en/18", 0), (3, None, 0)], "page_id long, url string, host int")
    labels = spark.createDataFrame([(17, 0, 0), (18, 1, 0), (18, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    assert {r["url"][-7:]: r["blocked"] for r in urls.labelled_urls(pages, labels).collect()} == {"17.html": True, "t/en/18": True}
    assert urls.filter_urls(spark, pages, labels.limit(0)).count() == 3
    assert urls.filter_urls(spark, pages.limit(0), labels).count() == 0


def test_long_urls_repeated_rows_and_clashing_columns(spark):
    long = "http://a.com/de/" + "x/" * 100_000
    rows = [(1, long, "h", 1), (1, long, "h", 2), (2, "http://b.org/" + "y" * 300_000, None, 3), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int").withColumn("a.b", F.lit(1)).withColumn("verdict", F.lit("x"))
    rules = spark.createDataFrame([], urls.RULE_SCHEMA)
    got = sorted((str(r["page_id"]), r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect())
    assert got == [("1", "a.com", 200_004, "com/de/", "block")] * 2 + [("2", "b.org", 300_001, "org/", "allow"), ("None", "", 0, None, "allow")]
    assert urls.judge(pages.limit(0), rules).collect() == []
