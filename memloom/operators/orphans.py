"""References to records that do not exist.

A Bloom filter over the live parent keys is built by a distributed aggregate and
used as a scalar subquery, so that it reaches every task as a few megabytes at
most, whatever the number of parents (``BLOOM_BITS`` bounds it).  A reference
whose key isn't in the filter is a definite orphan and never shuffles; only the
others are joined exactly with their parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bits of the filter (8 MiB).  Beyond 6.7 million live keys it gets less selective, never wrong: about 4 % of
#: the orphans pass at 10 million keys, 40 % at 30 million, nearly all at 100 million; these are found by the join.
BLOOM_BITS = 1 << 26
#: Bits wanted for each parent key (about 1 % false positives).
BITS_PER_KEY = 10


def might_contain(keys: DataFrame, key: str, probe: Column, expected: int) -> Column:
    """Condition that is false only for values of ``probe`` that no row of ``keys`` has in ``key``."""
    from pyspark.sql.classic.column import Column as Classic

    jvm = keys.sparkSession._jvm
    catalyst, util = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.classic.ExpressionUtils
    bits = max(1 << 13, min(BLOOM_BITS, expected * BITS_PER_KEY))
    expr = lambda c: util.expression(c._jc)
    agg = catalyst.aggregate.BloomFilterAggregate(
        expr(F.xxhash64(F.col(key))), expr(F.lit(max(expected, 1)).cast("long")), expr(F.lit(bits).cast("long"))
    )
    filter_ = keys.where(F.col(key).isNotNull()).agg(Classic(util.column(agg.toAggregateExpression())).alias("bits"))
    return F.coalesce(Classic(util.column(catalyst.BloomFilterMightContain(expr(filter_.scalar()), expr(F.xxhash64(probe))))), F.lit(False))


def orphan_references(
    refs: DataFrame, parents: DataFrame, *, ref_key: str, parent_key: str, ref_time: str, parent_time: str, expected: int
) -> DataFrame:
    """Rows of ``refs`` whose key has no parent alive at the time of the reference.

    ``parents`` has one row a live key (``parent_key``) with its first time; a
    parent whose time is after ``ref_time`` came later and doesn't count.  A null
    parent time counts as always there, a null reference time as never (only the
    existence of the parent matters then).  A null ref_key is not a reference and
    gives no row.  All columns of ``refs`` stay, with ``reason`` (``missing`` or
    ``later``) added.
    """
    probe = refs.where(F.col(ref_key).isNotNull()).withColumn("_maybe", might_contain(parents, parent_key, F.col(ref_key), expected))
    definite = probe.where(~F.col("_maybe")).drop("_maybe").withColumn("reason", F.lit("missing"))
    right = parents.select(F.col(parent_key).alias("_parent"), F.col(parent_time).alias("_since"))
    checked = probe.where(F.col("_maybe")).drop("_maybe").join(right, F.col(ref_key) == F.col("_parent"), "left")
    verified = checked.where(F.col("_parent").isNull() | (F.col("_since") > F.col(ref_time))).withColumn(
        "reason", F.when(F.col("_parent").isNull(), F.lit("missing")).otherwise(F.lit("later"))
    )
    return definite.unionByName(verified.drop("_parent", "_since"))


def link_concept(link: Column) -> Column:
    """Concept that a page link points to; null where the link is no reference.

    Null, empty, ``http(s)://``, ``mailto:``, ``tel:`` and ``#`` links are none.
    """
    plain = F.trim(link)
    outside = (plain == "") | F.lower(plain).rlike(r"^(?:https?://|mailto:|tel:|#)")
    base = F.regexp_replace(plain, r"(?s)#.*$", "")
    base = F.regexp_replace(F.regexp_replace(F.trim(base), r"(?s)^.*[/\\]", ""), r"(?i)\.md$", "")
    return F.when(~outside, F.lower(F.trim(F.translate(base, "_-", "  "))))


def session_reference_orphans(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Orphans of answer_session_ids and haystack_session_ids, with ``period`` (month of ingested_at).

    Null arrays and null elements are no references; repeated questions and ids
    give one row; a question without a time only misses sessions that don't exist.
    """
    live = (
        sessions.groupBy("session_id")
        .agg(F.max(F.col("deleted_at").isNotNull()).alias("gone"), F.min("created_at").alias("since"))
        .where(~F.col("gone") & F.col("session_id").isNotNull())
        .select("session_id", "since")
    )
    fields = ("answer_session_ids", "haystack_session_ids")
    tagged = lambda f: F.transform(
        F.coalesce(F.col(f), F.array().cast("array<string>")), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    )
    refs = (
        questions.select(
            "question_id",
            "ingested_at",
            F.explode(F.concat(*[tagged(f) for f in fields])).alias("ref"),
        )
        .where(F.col("ref.value").isNotNull())
        .groupBy("question_id", F.col("ref.field").alias("ref_field"), F.col("ref.value").alias("ref_value"))
        .agg(F.min("ingested_at").alias("at"), F.date_format(F.min("ingested_at"), "yyyy-MM").alias("period"))
    )
    found = orphan_references(
        refs, live, ref_key="ref_value", parent_key="session_id", ref_time="at", parent_time="since", expected=max(sessions.count(), 1)
    )
    return found.select(F.lit("smoke_longmemeval").alias("ref_table"), "ref_field", F.col("question_id").alias("record_key"), "ref_value", "period", "reason")


def page_link_orphans(pages: DataFrame) -> DataFrame:
    """Orphans of pages.links, with ``period`` (month of the linking page's first scan).

    A page is alive if none of its rows has removed_at; its first scan is its time.
    """
    by_page = pages.groupBy("rel_path").agg(F.min("scanned_at").alias("since"))
    live = (
        pages.groupBy("concept", "rel_path")
        .agg(F.max(F.col("removed_at").isNotNull()).alias("gone"), F.min("scanned_at").alias("since"))
        .where(~F.col("gone") & F.col("concept").isNotNull())
        .groupBy("concept")
        .agg(F.min("since").alias("since"))
    )
    refs = (
        pages.select("rel_path", F.explode("links").alias("ref_value"))
        .dropDuplicates()
        .withColumn("target", link_concept(F.col("ref_value")))
        .where(F.col("target").isNotNull())
        .join(by_page.withColumnRenamed("since", "at"), "rel_path")
        .withColumn("period", F.date_format("at", "yyyy-MM"))
    )
    found = orphan_references(refs, live, ref_key="target", parent_key="concept", ref_time="at", parent_time="since", expected=max(pages.count(), 1))
    return found.select(F.lit("pages").alias("ref_table"), F.lit("links").alias("ref_field"), F.col("rel_path").alias("record_key"), "ref_value", "period", "reason")
