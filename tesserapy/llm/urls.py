"""URL filters: fixed host and path rules, then mined association rules.

URLs are cut into tokens (host labels, path segments with digits masked, query
keys). FP-growth over the tokens of labelled URLs finds combinations that go
with the label "block"; those pruned by support and confidence are the rules.
They match by an inverted index: a rule is listed under its rarest token, and a
URL that holds the token is tested for the others.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the production filter: (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.5
BLOCK_ITEM = "=block"
OTHER_ITEM = "=allow"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host_col == domain) | host_col.endswith("." + domain)) & path_col.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; none for null."""
    masked = F.regexp_replace(path(url), "[0-9]+", "0")
    segments = F.filter(F.split(masked, "/"), lambda x: x != "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=", 2)[0]), lambda x: x != "")
    labels = F.filter(F.split(host(url), "[.]"), lambda x: x != "")
    scheme = F.translate(F.regexp_extract(url, "^([^:/?#]*)://", 1), UPPER, LOWER)
    found = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(segments, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(keys, lambda x: F.concat(F.lit("key:"), x)),
        F.array(F.concat(F.lit("scheme:"), scheme)),
        F.when(_rest(url).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


RULE_SCHEMA = "rule_id long, items array<string>, rarest string, confidence double, support double"


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from (url, blocked boolean): rule_id, items, rarest, confidence, support.

    All labelled URLs count. Rows with a null label or no token are left out;
    without any, there are no rules. Rules that a shorter rule already covers
    (a subset of their tokens) are kept: they cannot change a verdict.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("blocked").isNotNull()).select(tokens(F.col("url")).alias("t"), "blocked").where(F.size("t") > 0)
    label = F.when(F.col("blocked"), F.lit(BLOCK_ITEM)).otherwise(F.lit(OTHER_ITEM))
    items = rows.select(F.concat("t", F.array(label)).alias("items"))
    if not items.take(1):
        return spark.createDataFrame([], RULE_SCHEMA)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK_ITEM))
    rules = rules.where(~F.array_contains("antecedent", OTHER_ITEM))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    each = rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support").withColumn("item", F.explode("items"))
    ranked = each.join(single, "item").groupBy("items", "confidence", "support").agg(F.min(F.struct("freq", "item"))["item"].alias("rarest"))
    return ranked.select(F.xxhash64("items").alias("rule_id"), "items", "rarest", "confidence", "support")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, n_rules, confidence (the best) of the distinct URLs that a rule fits."""
    index = rules.select(F.col("rarest").alias("__token"), "items", "confidence")
    each = urls.select("url").distinct().select("url", tokens(F.col("url")).alias("__t")).withColumn("__token", F.explode("__t"))
    hit = each.join(index, "__token").where(F.size(F.array_except("items", "__t")) == 0)
    return hit.groupBy("url").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, mined: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of the best mined rule.

    A row of the input is a row of the result. Null URLs and URLs without
    ``://`` have an empty host and path, fit no rule and are allowed unless a
    mined rule fits their tokens. Repeated rows are judged alike, each with a row
    of its own; a long URL is one value, and its distinct tokens are one array. No
    pages: no rows; no mined rules: the fixed ones alone. Other columns are left,
    whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rows = rows.withColumn("__fit", fitting_rule(F.col("host"), F.col("path"), rules))
    found = matches(rows.where(F.col("__fit").isNull() & F.col("url").isNotNull()), mined).withColumnRenamed("url", "__url")
    joined = rows.join(found, F.col("url") == F.col("__url"), "left")
    method = F.when(F.col("n_rules").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("__fit.rule").alias("rule"), F.coalesce("__fit.verdict", method).alias("verdict"), "confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, blocked: pages whose path names a labelled document by number.

    A URL is blocked if its document is toxic or of low quality.
    """
    number = F.regexp_extract(path(F.col("url")), "/([0-9]{1,18})(?:[./]|$)", 1).try_cast("long")
    bad = labels.groupBy(F.col("doc_id").alias("__doc")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("blocked"))
    rows = pages.select("url", number.alias("__number")).where(F.col("__number").isNotNull())
    return rows.join(bad, F.col("__number") == F.col("__doc")).select("url", "blocked")


def filter_urls(spark: SparkSession, pages: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Mine rules from the labels and judge every page."""
    return judge(pages, mine(labelled_urls(pages, labels), **options))
