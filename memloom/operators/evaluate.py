"""Retrieval measures, set similarity and aggregate answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.questions import with_digits


def retrieval_metrics(results: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """A row a query with recall@k, recall_any@k, the reciprocal rank and NDCG@10 of (query_id, item, rank) against (query_id, item).

    Only the first rank of an item counts; queries without relevant items are left out.
    """
    gold = relevant.where(F.col("item").isNotNull()).distinct()
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("_n"))
    hits = results.groupBy("query_id", "item").agg(F.min("rank").alias("rank")).join(gold, ["query_id", "item"], "left_semi")
    r = F.col("rank")
    per = hits.groupBy("query_id").agg(
        *[F.count(F.when(r <= k, 1)).alias(f"_h{k}") for k in cuts], F.min("rank").alias("_first"), F.sum(F.when(r <= 10, 1 / F.log2(r + 1.0))).alias("_dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sizes.join(per, "query_id", "left").select(
        "query_id", *[(zero(F.col(f"_h{k}")) / F.col("_n")).alias(f"recall_{k}") for k in cuts], *[(zero(F.col(f"_h{k}")) > 0).cast("double").alias(f"any_{k}") for k in cuts],
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"), (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg_10"),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; two empty arrays are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def count_answer(results: DataFrame, k: int) -> DataFrame:
    """Distinct groups (or documents without one) among the first ``k`` results."""
    group = F.coalesce(F.col("group_id"), F.col("doc_id").cast("string"))
    return results.where(F.col("rank") <= k).groupBy("query_id").agg(F.countDistinct(group).alias("answer"))


def sum_answer(results: DataFrame, k: int, text: str = "text", number_words: bool = False) -> DataFrame:
    """Sum of all numbers in the first result of each group, with ``number_words`` those in words too; null unless above zero."""
    group = F.coalesce(F.col("group_id"), F.col("doc_id").cast("string"))
    first = results.where(F.col("rank") <= k).withColumn("_g", group).withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_g").orderBy("rank"))).where("_r = 1")
    if number_words:
        first = first.withColumn(text, with_digits(F.col(text)))
    numbers = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return first.groupBy("query_id").agg(F.sum(total).alias("s")).select("query_id", F.when(F.col("s") > 0, F.col("s")).alias("answer"))


def fact_score(text: Column, facts: list[list[str]]) -> Column:
    """How many facts a text names; a fact is any of its spellings, without regard to case, asterisks and backticks."""
    plain = F.lower(F.regexp_replace(text, "[*`_]", ""))
    found = F.lit(0)
    for spellings in facts:
        hit = F.lit(False)
        for s in spellings:
            hit = hit | F.contains(plain, F.lit(s.lower()))
        found = found + hit.cast("int")
    return found


def preferred_documents(documents: DataFrame, sessions: int | None = 5) -> DataFrame:
    """The document of each session (session_id, kind, at, rank) to show, by kind, then time.

    Of each ranked result list (query_id, where there is one) the first ``sessions`` in result order; all with None.
    """
    lists = [c for c in ("query_id",) if c in documents.columns]
    priority = F.when(F.col("kind") == "summary", 3).when(F.col("kind") == "checkpoint", 2).when(F.col("kind") == "outcome", 1).otherwise(0)
    best = documents.groupBy(*lists, "session_id").agg(F.max_by("doc_id", F.struct(priority, "at", "doc_id")).alias("doc_id"), F.min("rank").alias("rank"))
    if sessions is None:
        return best
    if not lists:
        return best.orderBy("rank", "session_id").limit(sessions)
    order = Window.partitionBy(*lists).orderBy("rank", "session_id")
    return best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sessions).drop("_n")


def excerpts(texts: DataFrame, key: str, text: str, terms: Column, keep: int = 3, otherwise: int = 2) -> DataFrame:
    """The lines that name most terms (else the first ones), in their order."""
    rows = texts.select(key, terms.alias("_t"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    scored = rows.withColumn("n", F.size(F.filter("_t", lambda t: F.contains(F.lower("line"), t))))
    any_hit = F.max("n").over(Window.partitionBy(key)) > 0
    best = scored.withColumn("_any", any_hit).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "pos")))
    kept = best.where(F.when(F.col("_any"), (F.col("n") > 0) & (F.col("_r") <= keep)).otherwise(F.col("_r") <= otherwise))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("line")))), lambda x: x["line"]), "\n").alias("excerpt"))


def mean_metrics(metrics: DataFrame, types: DataFrame) -> DataFrame:
    """Macro means of ``retrieval_metrics`` over all queries (question_type ``all``) and by type; types: query_id, question_type."""
    names = [c for c in metrics.columns if c != "query_id"]
    rows = metrics.join(types.select("query_id", "question_type").dropDuplicates(["query_id"]), "query_id", "left").withColumn("question_type", F.coalesce("question_type", F.lit("unknown")))
    # One reading of the rows for the types and all; a type is never null.
    means = rows.rollup("question_type").agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in names])
    return means.withColumn("question_type", F.coalesce("question_type", F.lit("all")))


def answers(intents: DataFrame, counts: DataFrame, sums: DataFrame, k: int) -> DataFrame:
    """(query_id, intent, limit, text, reasoning) of aggregate questions; intents: query_id, intent (count or sum)."""
    own = intents.where(F.col("intent").isin("count", "sum")).select("query_id", "intent")
    both = own.join(counts.select("query_id", F.col("answer").cast("double").alias("_c")), "query_id", "left").join(sums.select("query_id", F.col("answer").alias("_s")), "query_id", "left")
    value = F.when(F.col("intent") == "count", F.coalesce("_c", F.lit(0.0))).otherwise(F.col("_s"))
    text = F.when(value.isNull(), "unknown").when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(F.format_string("%.2f", value))
    why = F.when(F.col("intent") == "count", F.lit(f"distinct groups among the first {k} results")).otherwise(F.lit(f"numbers of the first result of each group among the first {k}"))
    return both.select("query_id", "intent", F.lit(k).alias("limit"), text.alias("text"), why.alias("reasoning"))


def shared_terms(selected: DataFrame, terms: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, terms): the first ``most`` terms that two or more of a query's selected sessions share.

    selected: query_id, session; terms: session, term.
    """
    held = selected.select("query_id", "session").distinct().join(terms.select("session", "term").distinct(), "session")
    twice = held.groupBy("query_id", "term").agg(F.count("*").alias("n")).where("n >= 2")
    first = twice.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("term"))).where(F.col("_r") <= most)
    return first.groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
