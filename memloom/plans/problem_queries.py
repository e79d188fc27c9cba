"""Queries of the general problems (3 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.times import with_utc_micros
from memloom.operators.orphans import page_link_orphans, session_reference_orphans
from memloom.sources.tables import table


def orphans(spark: SparkSession, d: str) -> DataFrame:
    sessions = session_reference_orphans(table(spark, d, "smoke_longmemeval"), table(spark, d, "sessions"))
    return sessions.unionByName(page_link_orphans(table(spark, d, "pages")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(spark, d).select("ref_table", "ref_field", "record_key", "ref_value")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans by table, field, month and reason."""
    return orphans(spark, d).groupBy("ref_table", "ref_field", "period", "reason").agg(F.count("*").alias("orphans"))


def raw_times(spark: SparkSession, d: str) -> DataFrame:
    """Every raw time with its row's zone, one row each."""
    tier0 = table(spark, d, "tier0_records").select(
        F.lit("tier0_records.timestamp").alias("field"), F.col("id").alias("record_key"), F.lit(0).alias("pos"),
        F.col("timestamp").alias("raw"), F.try_element_at("metadata", F.lit("tz")).alias("tz"),
    )
    questions = table(spark, d, "smoke_longmemeval")
    asked = questions.select(
        F.lit("smoke_longmemeval.question_date").alias("field"), F.col("question_id").alias("record_key"), F.lit(0).alias("pos"),
        F.col("question_date").alias("raw"), "tz",
    )
    hay = questions.select("question_id", "tz", F.posexplode("haystack_dates").alias("pos", "raw")).select(
        F.lit("smoke_longmemeval.haystack_dates").alias("field"), F.col("question_id").alias("record_key"), "pos", "raw", "tz"
    )
    said = table(spark, d, "messages").select(
        F.lit("messages.timestamp").alias("field"), F.col("msg_id").cast("string").alias("record_key"), F.lit(0).alias("pos"),
        F.col("timestamp").alias("raw"), "tz",
    )
    return tier0.unionByName(asked).unionByName(hay).unionByName(said)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return (
        with_utc_micros(raw_times(spark, d), "raw", "tz", "utc_us")
        .select("field", "record_key", "pos", "utc_us")
        .where(F.col("utc_us").isNotNull())
        .distinct()
    )


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p6_found": p6_found}

_ORPHANS = """
v as (select session_id, min(created_at) c, bool_or(deleted_at is not null) g from sessions group by 1),
r as (select distinct question_id k, 'answer_session_ids' f, unnest(answer_session_ids) x, ingested_at i from smoke_longmemeval union select distinct question_id, 'haystack_session_ids', unnest(haystack_session_ids), ingested_at from smoke_longmemeval),
o as (select 'smoke_longmemeval' ref_table, f ref_field, k record_key, x ref_value, strftime(i, '%Y-%m') period, case when v.session_id is null or g then 'missing' else 'later' end reason from r left join v on v.session_id = x where x is not null and (v.session_id is null or g or c > i)),
pf as (select rel_path, min(scanned_at) m from pages group by 1), pc as (select concept, min(scanned_at) m, bool_or(removed_at is not null) g from pages group by 1),
l as (select distinct rel_path, unnest(links) x from pages),
t as (select rel_path, x, lower(trim(replace(replace(regexp_replace(regexp_replace(trim(regexp_replace(trim(x), '#.*$', '')), '^.*/', ''), '(?i)\\.md$', ''), '_', ' '), '-', ' '))) t from l where x is not null and trim(x) <> '' and not regexp_matches(lower(trim(x)), '^(https?://|mailto:|tel:|#)')),
o2 as (select 'pages' ref_table, 'links' ref_field, t.rel_path record_key, x ref_value, strftime(pf.m, '%Y-%m') period, case when pc.concept is null or g then 'missing' else 'later' end reason from t join pf using (rel_path) left join pc on pc.concept = t where pc.concept is null or g or pc.m > pf.m),
every as (select * from o union all select * from o2)
"""

ORACLES = {
    "p3_found": f"with {_ORPHANS} select ref_table, ref_field, record_key, ref_value from every",
    "p3_report": f"with {_ORPHANS} select ref_table, ref_field, period, reason, count(*) orphans from every group by 1, 2, 3, 4",
}
