from datetime import datetime

from pyspark.sql import functions as F

from memloom.operators.orphans import link_concept, page_link_orphans, session_reference_orphans

PAGES = "rel_path string, concept string, links array<string>, scanned_at timestamp, removed_at timestamp, reason string"
QUESTIONS = "question_id string, answer_session_ids array<string>, haystack_session_ids array<string>, ingested_at timestamp, period string"
SESSIONS = "session_id string, created_at timestamp, deleted_at timestamp"


def day(n):
    return datetime(2024, 1, n)


def test_sessions(spark):
    sessions = [("a", day(1), None), ("b", day(1), None), ("b", day(1), day(2)), ("late", day(9), None), (None, day(1), None), ("a", day(1), None)]
    asked = [("q1", ["a", "b", None, "gone", "gone"], ["late", "a"], day(5), "x"), ("q1", ["a", "b", None, "gone", "gone"], ["late", "a"], day(5), "x"), ("q2", None, [], day(5), None), ("q3", ["late", "none"], None, None, None)]
    found = session_reference_orphans(spark.createDataFrame(asked, QUESTIONS), spark.createDataFrame(sessions, SESSIONS)).collect()
    assert sorted((r.ref_field, r.record_key, r.ref_value, r.reason) for r in found) == [
        ("answer_session_ids", "q1", "b", "missing"), ("answer_session_ids", "q1", "gone", "missing"), ("answer_session_ids", "q3", "none", "missing"),
        ("haystack_session_ids", "q1", "late", "later"),
    ]
    assert {r.period for r in found if r.record_key == "q1"} == {"2024-01"}


def test_pages(spark):
    links = ["docs/B-Page.md#top", " c_page ", "", None, "https://x.org/b.md", "#here", "mailto:a@b.c", "gone", "later page", "B page"]
    rows = [("a.md", "a page", links, day(3), None, "x"), ("b.md", "b page", None, day(1), None, None), ("c.md", "c page", [], day(1), day(2), None), ("l.md", "later page", [], day(8), None, None), ("l.md", "later page", [], day(9), None, None)]
    found = page_link_orphans(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.ref_value, r.reason) for r in found) == [(" c_page ", "missing"), ("gone", "missing"), ("later page", "later")]


def test_empty_tables(spark):
    assert page_link_orphans(spark.createDataFrame([], PAGES)).count() == 0
    assert session_reference_orphans(spark.createDataFrame([], QUESTIONS), spark.createDataFrame([], SESSIONS)).count() == 0
    asked = spark.createDataFrame([("q", ["a"], None, day(1), None)], QUESTIONS)
    assert session_reference_orphans(asked, spark.createDataFrame([], SESSIONS)).count() == 1


def test_many_against_brute_force(spark):
    sessions = spark.range(0, 5000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"), F.lit(day(1)).alias("created_at"), F.when(F.col("id") % 7 == 0, F.lit(day(2))).alias("deleted_at"))
    asked = spark.range(0, 400).select(
        F.col("id").cast("string").alias("question_id"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.lit("s"), (F.col("id") * 20 + i).cast("string"))).alias("answer_session_ids"),
        F.array().cast("array<string>").alias("haystack_session_ids"), F.lit(day(3)).alias("ingested_at"),
    )
    found = {r.ref_value for r in session_reference_orphans(asked, sessions).collect()}
    assert found == {f"s{k}" for k in range(8000) if k >= 5000 or k % 7 == 0}


def test_link_concept(spark):
    cases = {"docs/channels/discord.md#setup": "discord", "http://a.b": None, "MAILTO:x@y.z": None, "Group-Messages": "group messages", "../a/My_Page.MD": "my page", "tel:1": None, " ": None}
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", link_concept(F.col("l")).alias("c"))
    assert {r.l: r.c for r in df.collect()} == cases
