"""The jobs as queries: each runs twice into one new folder, and what stands after the second run is the result."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import comment_ledger, strata_report
from tesserapy.plans import oracle
from tesserapy.sources.shared import shared_dir


def _config(module) -> dict:
    return module.DEFAULTS | json.loads(Path(module.CONFIG).read_text())


def job1_strata_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/strata-report-{uuid.uuid4().hex}"
    for _ in range(2):
        strata_report.run(spark, sf_dir, out, _config(strata_report))
    return spark.read.parquet(out)


def job2_comment_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, with the distribution's count and share of each row's source and letter."""
    root = f"{shared_dir(spark)}/comment-ledger-{uuid.uuid4().hex}"
    for _ in range(2):
        comment_ledger.run(spark, f"{sf_dir}/documents.parquet*", f"{root}/out", f"{root}/checkpoint", _config(comment_ledger))
    ledger = spark.read.parquet(f"{root}/out/ledger")
    shares = spark.read.parquet(f"{root}/out/distribution").select(F.col("source").alias("s"), F.col("letter").alias("l"), "cnt", F.round("freq", 9).alias("freq"))
    return ledger.join(shares, F.col("source").eqNullSafe(F.col("s")) & (F.col("letter") == F.col("l"))).drop("s", "l")


def queries() -> dict:
    return {"job1_strata_report": job1_strata_report, "job2_comment_ledger": job2_comment_ledger}


def _ledger_sql() -> str:
    config = _config(comment_ledger)
    terms = config["terms"]
    listed = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    letters = ", ".join(f"({k}, '{name}', [{', '.join(str(terms.index(t)) for t in of)}]::bigint[])" for k, (name, of) in enumerate(config["letters"].items()))
    return f"""with split as (select doc_id, source, string_split_regex(translate(text, '{comment_ledger.UPPER}', '{comment_ledger.LOWER}'), '[\\x20\\x09-\\x0D.,;:!?]+') ws from documents),
held as (select row_number() over () n, doc_id, source, list_filter(range({len(terms)}), lambda i: coalesce(list_contains(ws, {listed}[i + 1]), false)) m from split),
letters(k, letter, l) as (values {letters}),
far as (select n, k, letter, least(len(list_filter(range({len(terms)}), lambda i: list_contains(m, i) <> list_contains(l, i))), {config["cap"]}) distance from held, letters),
near as (select n, letter, distance from (select *, row_number() over (partition by n order by distance, k) r from far) q where r = 1),
filed as (select doc_id, source, array_to_string(m, '.') terms, cast(len(m) as int) n_terms, cast(distance as bigint) distance, letter from held join near using (n))
select *, count(*) over (partition by source, letter) cnt, round(count(*) over (partition by source, letter) / count(*) over (partition by source), 9) freq from filed"""


def oracle_sql() -> dict:
    parts = oracle._with(oracle.ensemble(), oracle.clusters(1), oracle.words(), oracle.STRATA)
    report = f"""{parts}, spelt as (select k.c, coalesce(string_agg(cast(p as varchar), '.' order by p), '') m from (select cast(unnest(range({oracle.K})) as int) c) k left join cm1 using (c) group by 1),
named as (select word_uid, string_agg(m, '|' order by place) districts from (select word_uid, unnest(word) c, unnest(range(len(word))) place from (select word_uid, any_value(word) word from wx group by 1) u) q join spelt using (c) group by 1),
found as (select sample_tag, word_uid, word_str, count(*) plans, sum(phi_freq) z, round(sum(phi_freq), 9) weight from pf join (select plan_uid, sample_tag from dist) t using (plan_uid) group by all),
tags as (select count(distinct sample_tag) tags from dist),
mean as (select word_uid, sum(z) / any_value(tags) mean from found, tags group by 1)
select sample_tag, word_uid, word_str, districts, plans, weight, cast(row_number() over (partition by sample_tag order by weight desc, word_uid) as int) rank, round(z - mean, 9) gap from found join mean using (word_uid) join named using (word_uid)"""
    return {"job1_strata_report": report, "job2_comment_ledger": _ledger_sql()}
