"""Temporal facts and chunk versions: SCD2 histories, as-of queries and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.ordered import with_next
from memloom.functions.sizing import within


def norm(c: Column) -> Column:
    """Comparison form of a fact's part: trimmed, lower case, single spaces."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " "))


def versioned(claims: DataFrame, contiguous: bool = False) -> DataFrame:
    """Versions of facts from claims (subject, predicate, object, day, doc_id).

    Claims are taken in order of day (null first) and doc_id.  Runs of the same
    object are one version whose valid_from is that of the run's last claim (with
    ``contiguous`` its first, which leaves no gap); valid_to is the first day of
    the next version; the last one is the latest.
    """
    key = [norm(F.col("subject")), norm(F.col("predicate"))]
    order = Window.partitionBy("_s", "_p").orderBy(F.asc_nulls_first("day"), "doc_id")
    rows = claims.withColumn("_s", key[0]).withColumn("_p", key[1]).withColumn("_v", norm(F.col("object")))
    changed = F.coalesce((F.lag("_v").over(order) != F.col("_v")).cast("int"), F.lit(0))
    runs = rows.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(order)).withColumn("_o", F.struct(F.coalesce("day", F.lit("0001-01-01").cast("date")), "doc_id"))
    one = runs.groupBy("_s", "_p", "_run").agg(
        F.max_by("object", "_o").alias("object"), F.max_by("doc_id", "_o").alias("doc_id"), F.min("day").alias("_first"),
        (F.min("day") if contiguous else F.max_by("day", "_o")).alias("valid_from"), F.min_by("day", "_o").alias("_start"),
    )
    by_run = Window.partitionBy("_s", "_p").orderBy("_run")
    return one.select(
        F.col("_s").alias("subject"), F.col("_p").alias("predicate"), (F.col("_run") + 1).cast("int").alias("version"), "object", "valid_from",
        F.lead("_start").over(by_run).alias("valid_to"), F.lead("_run").over(by_run).isNull().alias("is_latest"), "doc_id",
    )


#: Days up to which an as-of query sends them to every task.
FEW_DAYS = 10_000


def as_of(facts: DataFrame, days: DataFrame, few: int = FEW_DAYS) -> DataFrame:
    """Facts active on each day of ``days`` (day): from valid_from, before valid_to.

    At most ``few`` days are sent to every task.  More are joined by month: a fact
    gives a row for each of its months between the first and the last of the days.
    """
    own = days.where(F.col("day").isNotNull()).select(F.col("day").alias("as_of"))
    active = (F.col("valid_from") <= F.col("as_of")) & (F.col("valid_to").isNull() | (F.col("as_of") < F.col("valid_to")))
    if within(own, few):
        return facts.join(F.broadcast(own), active).select("as_of", *facts.columns)
    ends = own.agg(F.min("as_of").alias("_a"), F.max("as_of").alias("_b"))  # one row
    start, end = F.greatest("valid_from", "_a"), F.least(F.coalesce("valid_to", "_b"), "_b")
    months = F.when(start <= end, F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    spread = facts.where(F.col("valid_from").isNotNull()).join(F.broadcast(ends)).select(*facts.columns, F.explode(months).alias("_month"))
    return spread.join(own.withColumn("_month", F.trunc("as_of", "month")), "_month").where(active).select("as_of", *facts.columns)


def subject_timeline(facts: DataFrame, subjects: DataFrame) -> DataFrame:
    """(position and) facts of each of ``subjects`` (subject) in order of valid_from, valid_to and predicate, nulls first."""
    wanted = subjects.select(norm(F.col("subject")).alias("_s")).distinct()
    rows = facts.withColumn("_s", norm(F.col("subject"))).join(wanted, "_s")
    order = Window.partitionBy("_s").orderBy(F.asc_nulls_first("valid_from"), F.asc_nulls_first("valid_to"), "predicate", "doc_id")
    return rows.withColumn("position", F.row_number().over(order)).drop("_s")


def between(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Facts that begin in the closed range, whichever bound comes first."""
    a, b = F.lit(min(start, end)).cast("date"), F.lit(max(start, end)).cast("date")
    return facts.where(F.col("valid_from").between(a, b))


ORDER = ["valid_from", "subject", "predicate", "doc_id"]


def window_around(facts: DataFrame, anchor: str, before: int, after: int) -> DataFrame:
    """The event nearest to ``anchor`` (the first on a tie) with ``before`` and ``after`` neighbours: three bounded sorts."""
    events = facts.where(F.col("valid_from").isNotNull())
    key = F.struct(*ORDER)
    near = events.orderBy(F.abs(F.datediff("valid_from", F.lit(anchor).cast("date"))), *ORDER).limit(1).select(key.alias("_at"))
    at = events.join(F.broadcast(near))
    early = at.where(key <= F.col("_at")).orderBy(*[F.desc(c) for c in ORDER]).limit(before + 1)
    late = at.where(key > F.col("_at")).orderBy(*ORDER).limit(after)
    return early.unionByName(late).drop("_at")


def adjacent_pairs(facts: DataFrame, start: str, end: str, max_gap: int | None = None) -> DataFrame:
    """Each event of the range with the next one, if at most ``max_gap`` days later."""
    pairs = with_next(between(facts, start, end), ORDER, ["valid_from", "subject"])
    gap = F.datediff("next_valid_from", "valid_from")
    out = pairs.where(F.col("next_valid_from").isNotNull()).withColumn("gap_days", gap)
    return out.where(F.col("gap_days") <= max_gap) if max_gap is not None else out


def chunk_versions(chunks: DataFrame) -> DataFrame:
    """Versions of chunks (doc_id, lineage, chunk_id, at) by lineage in order of arrival; a chunk seen again keeps its version."""
    first = chunks.groupBy("doc_id", "lineage", "chunk_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    order = Window.partitionBy("doc_id", "lineage").orderBy("first_at", "chunk_id")
    latest = Window.partitionBy("doc_id", "lineage").orderBy(F.desc("last_at"), F.desc("first_at"), F.desc("chunk_id"))
    return (
        first.withColumn("version", F.row_number().over(order))
        .withColumn("supersedes", F.lag("chunk_id").over(order))
        .withColumn("is_latest", F.row_number().over(latest) == 1)
    )


def lifecycle(versions: DataFrame) -> DataFrame:
    """A row a document: its highest version and its latest chunks."""
    return versions.groupBy("doc_id").agg(F.max("version").alias("version"), F.array_sort(F.collect_list(F.when(F.col("is_latest"), F.col("chunk_id")))).alias("latest_chunks"))
