"""Retrieval: postings, multi-field BM25 and the hybrid ranker over batches of queries.

The ranker is a plan over rows (query_id, doc_id, component, delta): every source
of evidence only adds rows, one aggregation sums them, and the later stages read
ranks that are fixed before them.  No side is hinted: adaptive execution sends
the query side to all tasks where its measured size allows, and shuffles it
where a batch is larger.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.ordered import cut_lineage
from memloom.functions.sizing import BROADCAST_ROWS, within

if TYPE_CHECKING:
    from memloom.operators.index import Index

K1, B = 1.2, 0.75
POSTINGS_CAP = 500
PER_GROUP = 2
#: Documents of a query that are grouped.
KEPT = 200
BOOSTS = {"content": 1.0, "headings": 1.4, "terms": 2.0, "entities": 2.4, "temporal": 1.1}


def best_postings(chunk_scores: DataFrame) -> DataFrame:
    """(key, doc_id, score): the best score of a key in a document's chunks, for every document."""
    return chunk_scores.groupBy("key", "doc_id").agg(F.max("score").alias("score"))


def capped_postings(chunk_scores: DataFrame, cap: int = POSTINGS_CAP) -> DataFrame:
    """(key, doc_id, score) of the ``cap`` best documents of a key, ties by doc_id."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "doc_id")
    return best_postings(chunk_scores).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).drop("rank")


def prefix_keys(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """(term, key, exact): the key equal to a term, else the smallest key that a term of four or more bytes begins."""
    wanted, own = terms.select("term").distinct(), keys.select("key").distinct()
    exact = wanted.join(own, F.col("term") == F.col("key")).select("term", "key", F.lit(True).alias("exact"))
    missing = wanted.join(own, F.col("term") == F.col("key"), "left_anti").where(F.octet_length("term") >= 4)
    # Both sides share their first four bytes, so this is an equi-join with a rest.
    head = lambda c: F.substring(F.col(c), 1, 4)
    near = (
        missing.withColumn("_h", head("term"))
        .join(own.withColumn("_h", head("key")), "_h")
        .where(F.startswith(F.col("key"), F.col("term")))
        .groupBy("term")
        .agg(F.min("key").alias("key"))
    )
    return exact.unionByName(near.select("term", "key", F.lit(False).alias("exact")))


def field_tokens(docs: DataFrame, fields: dict[str, Column], key: str = "doc_id") -> DataFrame:
    """(doc_id, field, token, tf, len) from array columns of tokens; one explode over all fields."""
    every = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(c, F.array().cast("array<string>")).alias("w")) for f, c in fields.items()])
    rows = docs.select(F.col(key).alias("doc_id"), F.explode(every).alias("f")).select("doc_id", "f.field", F.size("f.w").alias("len"), F.explode("f.w").alias("token"))
    return rows.groupBy("doc_id", "field", "token", "len").agg(F.count("*").alias("tf"))


def field_lengths(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, avg_len) over the documents that have the field; read from the arrays, so one row a field and task is shuffled."""
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0))
    rows = docs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), size(c).alias("len")) for f, c in fields.items()])).alias("f")).select("f.*")
    return rows.where("len > 0").groupBy("field").agg((F.sum("len") / F.count("*")).alias("avg_len"))


def bm25(tokens: DataFrame, queries: DataFrame, n_docs: DataFrame, boosts: dict[str, float] | None = None, k1: float = K1, b: float = B, lengths: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a token with a query.

    ``queries`` has distinct (query_id, token); ``n_docs`` one row (n); ``lengths``
    is that of ``field_lengths``, else read from the tokens.  ``pairs``: the distinct
    (query_id, doc_id) to score; the statistics stay those of all documents.
    """
    weights = F.create_map(*[F.lit(x) for f, w in (boosts or BOOSTS).items() for x in (f, w)])
    stats = lengths if lengths is not None else tokens.select("doc_id", "field", "len").distinct().groupBy("field").agg((F.sum("len") / F.count("*")).alias("avg_len"))  # a row a field
    wanted = queries.select("query_id", "token")
    # A batch of few query words goes to every task; a larger one is shuffled by word.
    sent = F.broadcast if within(wanted, BROADCAST_ROWS) else (lambda df: df)
    hits = tokens.join(sent(wanted.select("token").distinct()), "token", "left_semi")
    df = hits.groupBy("field", "token").agg(F.count("*").alias("df"))  # at most a row a field and query word
    n = F.col("n")
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    weighted = (
        hits.join(sent(df), ["field", "token"])
        .join(F.broadcast(stats), "field")
        .join(F.broadcast(n_docs))
        .select("doc_id", "token", (F.try_element_at(weights, F.col("field")) * idf * F.col("tf") * (k1 + 1) / norm).alias("part"))
        # Dealt out by document: the pairs of query and document, as many as both together, are summed where they arise.
        .repartition("doc_id")
        .groupBy("doc_id", "token")
        .agg(F.sum("part").alias("part"))
    )
    if pairs is not None:
        weighted = weighted.join(pairs.select("query_id", "doc_id"), "doc_id")
        return weighted.join(sent(wanted), ["query_id", "token"]).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return weighted.join(sent(wanted), "token").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def top(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The best ``k`` documents of each query, ties by doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cap_groups(ranked: DataFrame, k: int, per_group: int = PER_GROUP, group_score: str | None = None) -> DataFrame:
    """At most ``per_group`` documents of a group (documents without one are alone), groups by their score."""
    group = F.coalesce(F.col("group_id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    own = Window.partitionBy("query_id", "_g").orderBy(F.desc("score"), "doc_id")
    # The best of a group is always kept, so its score is read after the cut, which each task makes before the shuffle.
    of_group = F.col(group_score) if group_score else F.max("score").over(Window.partitionBy("query_id", "_g"))
    kept = ranked.withColumn("_g", group).withColumn("_in", F.row_number().over(own)).where(F.col("_in") <= per_group).withColumn("_gs", of_group)
    order = Window.partitionBy("query_id").orderBy(F.desc("_gs"), "_g", "_in")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_g", "_in", "_gs")


def matches_filters(filters: Column, wanted: dict[str, str]) -> Column:
    """Every wanted key has exactly the wanted value; a missing key is no match, no wanted key no restriction."""
    ok = F.lit(True)
    for k, v in wanted.items():
        ok = ok & F.coalesce(F.try_element_at(filters, F.lit(k)) == v, F.lit(False))
    return ok


def group_score(rows: DataFrame, count_query: Column) -> DataFrame:
    """(query_id, group, group_score) of (query_id, group, doc_id, score, q, norm, matched_entities, matched_terms, day).

    The best, decayed support and coverage, with bonuses for exact and all matched entities, terms, support and days close together (O-097).
    """
    own = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "doc_id")
    ranked = rows.withColumn("_r", F.row_number().over(own)).withColumn("_top", F.first("score").over(own)).withColumn("_count", count_query)

    def decays(values: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.greatest(F.col("_r") - 1, F.lit(1)))

    decay = F.when(F.col("_count"), decays([0.45, 0.28, 0.16, 0.08])).otherwise(decays([0.30, 0.18, 0.10, 0.05]))
    support = F.when(F.col("_r").between(2, 5), decay * F.col("score")).otherwise(F.lit(0.0))
    backing = (F.col("_r") >= 2) & (F.col("score") >= F.greatest(F.col("_top") * 0.35, F.lit(0.15)))
    exact = F.array_intersect("matched_entities", F.array_append("q", F.col("norm")))
    distinct = lambda c, n: F.least(F.size(F.array_distinct(F.flatten(F.collect_list(c)))), F.lit(n))
    counts, span = F.max("_count"), F.datediff(F.max("day"), F.min("day"))
    supporting = F.col("score") >= F.greatest(F.col("_top") * 0.35, F.lit(0.15))
    close = F.when(F.count("day") < 2, 0.0).when(span <= 7, F.when(counts, 0.12).otherwise(0.08)).when(span <= 30, F.when(counts, 0.06).otherwise(0.04)).otherwise(0.0)
    bonus = (
        0.10 * F.least(F.count(F.when(F.size("_exact") > 0, 1)), F.lit(3)) + 0.08 * distinct("_exact", 3) + 0.04 * distinct("matched_entities", 4)
        + 0.015 * distinct("matched_terms", 6) + F.when(counts, 0.06).otherwise(0.03) * F.least(F.count(F.when(supporting, 1)), F.lit(4)) + close
    )
    return (
        ranked.withColumn("_exact", exact).withColumn("_decay", F.when(F.col("_r") <= 5, support).otherwise(F.lit(0.0)))
        .groupBy("query_id", "group")
        .agg(
            (F.max("_top") * F.when(F.max("_count"), F.lit(0.75)).otherwise(F.lit(1.0)) + F.sum("_decay")
             + F.least(F.count(F.when(backing, 1)), F.lit(4)) * F.when(F.max("_count"), F.lit(0.08)).otherwise(F.lit(0.05)) + bonus).alias("group_score")
        )
    )


#: Related words of a term, and the least confidence of a one-way relation.
RELATED, RELATED_CONFIDENCE = 3, 0.82


def expand(terms: DataFrame, lexicon: DataFrame, most: int = RELATED) -> DataFrame:
    """(query_id, related, confidence): up to ``most`` related words of each query term (query_id, term) that the query lacks.

    lexicon: term, related, relation, confidence.  Synonyms and similar words count
    both ways, other relations one way and only from RELATED_CONFIDENCE on.
    """
    both = F.col("relation").isin("synonym", "similar")
    back = lexicon.where(both).select(F.col("related").alias("term"), F.col("term").alias("related"), "relation", "confidence")
    pairs = lexicon.where(both | (F.col("confidence") >= RELATED_CONFIDENCE)).select("term", "related", "relation", "confidence").unionByName(back)
    pairs = pairs.where(F.col("term") != F.col("related")).groupBy("term", "related").agg(F.max("confidence").alias("confidence"))
    own = terms.select("query_id", "term").distinct()
    new = own.join(pairs, "term").join(own.select("query_id", F.col("term").alias("related")), ["query_id", "related"], "left_anti")
    order = Window.partitionBy("query_id", "term").orderBy(F.desc("confidence"), "related")
    kept = new.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return kept.groupBy("query_id", "related").agg(F.max("confidence").alias("confidence"))


def temporal_filter(results: DataFrame, start: Column | None = None, end: Column | None = None, target: Column | None = None, window_days: int = 7) -> DataFrame:
    """Results whose ``day`` lies in the closed range and within ``window_days`` of the target; bounds that are null don't restrict, a null day only passes if none does."""
    day, ok = F.col("day"), F.lit(True)
    for bound, inside in ((start, lambda b: day >= b), (end, lambda b: day <= b), (target, lambda b: F.abs(F.datediff(day, b)) <= window_days)):
        if bound is not None:
            ok = ok & (bound.isNull() | F.coalesce(inside(bound), F.lit(False)))
    return results.where(ok)


def diversified(candidates: DataFrame, terms: DataFrame, k: int, per_term: float = 0.16, new_segment: float = 0.28) -> DataFrame:
    """Greedy top ``k`` of each query: score plus a gain for each query term and the segment that no pick before has.

    candidates: query_id, doc_id, segment_id, score (bounded a query, as 200 best); terms: query_id, doc_id, term.
    Each round is one aggregation over the candidates of all queries.
    """
    rows = cut_lineage(candidates.select("query_id", "doc_id", "segment_id", "score"))
    held = cut_lineage(terms.select("query_id", "doc_id", "term").distinct())
    picked = None
    for n in range(1, k + 1):
        left, news, fresh = rows, held, F.lit(1)
        if picked is not None:
            left = rows.join(picked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
            covered = held.join(picked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").select("query_id", "term").distinct()
            news = held.join(covered, ["query_id", "term"], "left_anti")
            used = picked.select("query_id", "segment_id", F.lit(0).alias("_seen")).distinct()
            left, fresh = left.join(used, ["query_id", "segment_id"], "left"), F.coalesce("_seen", F.lit(1))
        gains = news.groupBy("query_id", "doc_id").agg(F.count("*").alias("_n"))
        gain = F.col("score") + per_term * F.coalesce("_n", F.lit(0)) + new_segment * fresh
        scored = left.join(gains, ["query_id", "doc_id"], "left").withColumn("gain", gain)
        order = Window.partitionBy("query_id").orderBy(F.desc("gain"), F.desc("score"), "doc_id")
        best = scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query_id", "doc_id", "segment_id", "score", "gain", F.lit(n).alias("pick"))
        picked = cut_lineage(best if picked is None else picked.unionByName(best))
    return picked


@dataclass
class Options:
    """Of the hybrid ranker; ``as_of`` stands for today."""

    top_k: int = 10
    boosts: dict[str, float] = field(default_factory=lambda: dict(BOOSTS))
    prefix_weight: float = 0.25
    bigrams: bool = False
    prefilter: bool = False
    window_days: int = 7
    as_of: str | None = None


def hybrid(queries: DataFrame, index: Index, options: Options | None = None, allowed: DataFrame | None = None, expansions: DataFrame | None = None) -> DataFrame:
    """Ranked documents of each query with their component scores.

    queries: query_id, norm, terms (array), intent (null, count, sum, sequence), target (date or null).
    index: the tables of ``operators.index``.  allowed: query_id, doc_id, applied after BM25's budget unless ``prefilter``.
    expansions: term, related, confidence (see ``expand``).

    The scores of all candidates are written to the checkpoint folder without any
    text or array of the documents; later stages read what they need of the few that
    are left: times and entities of KEPT a query, texts of thirty.
    """
    o = options or Options()
    inner = max(o.top_k * 5, 20)
    terms = queries.select("query_id", F.explode("terms").alias("term"))
    toks, total, lengths = index.tokens, index.size, index.lengths
    if allowed is not None and o.prefilter:  # the statistics are those of the allowed documents
        toks = toks.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
        total = index.documents.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*").alias("n"))
        lengths = None
    postings, entity_postings, links = index.postings, index.entity_postings, index.links
    none = F.lit(None).cast("string")
    # At most ``inner * 5`` documents a query.
    lexical = cut_lineage(top(bm25(toks, terms.select("query_id", F.col("term").alias("token")).distinct(), total, o.boosts, lengths=lengths), inner * 5).select("query_id", "doc_id", "score"))
    # What each query asks of the two kinds of postings.
    asked = [queries.select(F.lit("entity").alias("source"), F.col("norm").alias("key"), "query_id", F.lit("entity").alias("component"), F.lit(1.5 * 1.25).alias("factor"), F.col("norm").alias("entity"), none.alias("term"))]
    for source, name, weight in ((entity_postings, "entity", 1.2), (postings, "term", 0.8)):
        factor = F.lit(weight) * F.when(F.col("exact"), F.lit(1.4 if name == "entity" else 1.0)).otherwise(F.lit(o.prefix_weight))
        shown = [(F.col("key") if name == c else none).alias(c) for c in ("entity", "term")]
        asked.append(terms.join(prefix_keys(terms, source), "term").select(F.lit(name).alias("source"), "key", "query_id", F.lit(name).alias("component"), factor.alias("factor"), *shown))
    if expansions is not None:
        wide = expand(terms, expansions)
        for name, weight in (("entity", 0.45), ("term", 0.35)):
            asked.append(wide.select(F.lit(name).alias("source"), F.col("related").alias("key"), "query_id", F.lit("expanded").alias("component"), F.lit(weight).alias("factor"), none.alias("entity"), none.alias("term")))
    asks = cut_lineage(reduce(DataFrame.unionByName, asked))
    # A batch of few asks goes to every task; a larger one is shuffled by key.
    sent = F.broadcast if within(asks, BROADCAST_ROWS) else (lambda df: df)
    every_posting = postings.select(F.lit("term").alias("source"), "key", "doc_id", "score").unionByName(entity_postings.select(F.lit("entity").alias("source"), "key", "doc_id", "score"))
    parts = ("bm25", "entity", "term", "expanded")
    meta = index.documents.select("doc_id", "topic_tokens", "type_tokens", F.col("day").isNotNull().alias("day"), "entities", "temporal")
    q = queries.select("query_id", "norm", F.col("terms").alias("q"), "intent", "target")
    both = lambda a: F.size(F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), F.col("q")))
    semantic = (
        F.when(F.col("intent") == "count", 0.24 * both(F.col("temporal")) + 0.35 * both(F.col("entities")) + 0.05 * F.col("day").cast("int"))
        .when(F.col("intent") == "sum", 0.20 * both(F.col("temporal")) + 0.12 * both(F.col("entities")))
        .when(F.col("intent") == "sequence", 0.20 * both(F.col("temporal")) + 0.12 * both(F.col("entities")) + 0.28 * F.col("day").cast("int"))
        .otherwise(F.lit(0.0))
    )
    base = F.col("bm25") + F.col("entity") + F.col("term") + F.col("expanded") + F.col("semantic") + F.col("metadata")

    def scored_by_evidence(only: DataFrame | None = None) -> DataFrame:
        """Component scores of all candidates, or of ``only`` (query_id, doc_id); postings and BM25 meet by document, where their pairs are summed."""
        hits = every_posting.join(sent(asks.select("source", "key").distinct()), ["source", "key"], "left_semi").repartition("doc_id").join(sent(asks), ["source", "key"])
        rows = hits.select("query_id", "doc_id", "component", (F.col("factor") * F.col("score")).alias("delta"), F.col("entity").alias("_e"), F.col("term").alias("_t"))
        words = lexical.repartition("doc_id").select("query_id", "doc_id", F.lit("bm25").alias("component"), F.col("score").alias("delta"), none.alias("_e"), none.alias("_t"))
        every = rows.unionByName(words)
        for scope in (allowed, only):
            if scope is not None:
                every = every.join(scope.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
        found = every.groupBy("query_id", "doc_id").agg(
            *[F.coalesce(F.sum(F.when(F.col("component") == c, F.col("delta"))), F.lit(0.0)).alias(c) for c in parts],
            F.array_sort(F.collect_set("_e")).alias("matched_entities"), F.array_sort(F.collect_set("_t")).alias("matched_terms"),
        )
        cand = found.join(meta, "doc_id").join(asker, "query_id")
        cand = cand.withColumn("semantic", F.least(semantic, F.lit(0.85))).withColumn(
            "metadata", 0.35 * both(F.col("topic_tokens")) + 0.25 * both(F.col("type_tokens")) + 0.05 * F.col("day").cast("int")
        )
        return cand.withColumn("base", base).select("query_id", "doc_id", *parts, "semantic", "metadata", "base", "matched_entities", "matched_terms")

    asker = (F.broadcast if within(queries, BROADCAST_ROWS) else (lambda df: df))(q.select("query_id", "q", "intent"))
    order = Window.partitionBy("query_id").orderBy(F.desc("base"), "doc_id")
    held = index.documents.select("doc_id", "group_id", "day", "entities")
    # Each task cuts its own candidates before the shuffle.
    best = scored_by_evidence().withColumn("rank0", F.row_number().over(order)).where(F.col("rank0") <= KEPT)
    first = cut_lineage(best.join(q, "query_id").join(held, "doc_id"))  # read by four later stages
    graph_ok = ~F.coalesce(F.col("intent").isin("count", "sum"), F.lit(False))
    anchors = first.where((F.col("rank0") <= 5) & graph_ok)
    linked = (
        anchors.select("query_id", F.col("doc_id").alias("src"), (F.col("base") / (1 + F.col("base"))).alias("w"))
        .join(links, "src")
        .groupBy("query_id", F.col("dst").alias("doc_id"))
        .agg(F.least(F.lit(0.6), F.sum(0.22 * F.col("w"))).alias("links"))
    )
    around = anchors.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("entities"))).alias("_around"))  # five documents a query
    # Only the links of the first five can lift a document over 200 others: those are scored once more by themselves.
    beyond = cut_lineage(linked.select("query_id", "doc_id").join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"))
    lifted = scored_by_evidence(beyond).withColumn("rank0", F.lit(KEPT + 1)).join(q, "query_id").join(held, "doc_id")
    scored = first.unionByName(lifted).join(linked, ["query_id", "doc_id"], "left").join(around, "query_id", "left")
    shared = F.size(F.array_intersect("entities", F.coalesce("_around", F.array().cast("array<string>"))))
    pairs = lambda a: F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.concat_ws(" ", F.element_at(a, i), F.element_at(a, i + 1)))).otherwise(F.array().cast("array<string>"))
    overlap = F.size(F.filter("q", lambda t: F.array_contains("rerank", t))) / F.greatest(F.size("q"), F.lit(1))
    bigram = F.size(F.array_intersect(pairs(F.col("q")), pairs(F.col("rerank")))) / F.greatest(F.size("q") - 1, F.lit(1)) if o.bigrams else F.lit(0.0)
    # Whole pages are read only for the thirty first candidates of a query, and only their overlap goes on.
    near_top = first.where((F.col("rank0") <= 30) & F.col("intent").isNull()).select("query_id", "doc_id", "q").join(index.rerank, "doc_id")
    scored = scored.join(near_top.select("query_id", "doc_id", (0.08 * overlap + 0.08 * bigram).alias("overlap")), ["query_id", "doc_id"], "left")
    final = (
        scored.withColumn("links", F.coalesce("links", F.lit(0.0)))
        .withColumn("graph", F.when(graph_ok & (F.col("rank0") <= 100), F.least(F.lit(0.6), 0.08 * shared)).otherwise(F.lit(0.0)))
        .withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
        .withColumn("score", F.col("base") + F.col("links") + F.col("graph") + F.col("overlap"))
        .where(F.col("score") > 0)
    )
    bounded = top(final.drop("rank"), KEPT).withColumn("group", F.coalesce("group_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))))
    groups = group_score(bounded, F.coalesce(F.col("intent") == "count", F.lit(False)))
    # A query with a target day orders all it has kept of each group again, with the time added; the others keep the order of groups.
    ranked = cap_groups(bounded.drop("rank").join(groups, ["query_id", "group"]), KEPT, group_score="group_score")
    near = F.abs(F.datediff("day", "target"))
    timed = F.when(F.col("target").isNotNull() & F.col("day").isNotNull() & (near <= o.window_days), 0.45 * (1 - near / F.lit(float(o.window_days)))).otherwise(F.lit(0.0))
    added = ranked.withColumn("time", timed).withColumn("score", F.col("score") + F.col("time"))
    again = Window.partitionBy("query_id").orderBy(F.when(F.col("target").isNotNull(), F.col("score")).desc_nulls_last(), "rank")
    out = added.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= o.top_k)
    return out.select("query_id", "doc_id", "group_id", "rank", "score", *parts, "semantic", "metadata", "links", "graph", "overlap", "time", "matched_entities", "matched_terms")


def chunk_context(chunks: DataFrame, results: DataFrame, queries: DataFrame, k: int = 8, chars: int = 1200) -> DataFrame:
    """The best chunks of the ranked documents: terms and headings that match, plus a quarter of the document's score."""
    own = chunks.join(results.select("query_id", "doc_id", F.col("score").alias("doc_score")), "doc_id").join(queries.select("query_id", F.col("terms").alias("q")), "query_id")
    hits = F.size(F.filter("q", lambda t: F.contains(F.lower("content"), t)))
    heads = F.size(F.filter("q", lambda t: F.contains(F.lower(F.coalesce("heading", F.lit(""))), t)))
    scored = own.withColumn("score", hits + 0.4 * heads + 0.25 * F.col("doc_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "doc_id", "score", F.substring("content", 1, chars).alias("text"))
