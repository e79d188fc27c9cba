"""Routing of queries to segments by sparse profiles.

A profile is four weighted term lists (terms, entities, topics, local memory).
In long form (segment_id, kind, term, weight) every router is a join of the query
terms with the profiles and one aggregation by (query, segment).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.ordered import keep
from memloom.functions.sizing import BROADCAST_ROWS, within

KINDS = ("terms", "entities", "topics", "local_memory")
SMOOTHING = 1e-6


def long_profiles(profiles: DataFrame) -> DataFrame:
    """(segment_id, kind, term, weight), each kind of a segment summing to 1; weights not above zero don't count."""
    rows = profiles.where(F.col("segment_id").isNotNull()).select(
        "segment_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("m")) for k in KINDS])).alias("p")
    )
    term = F.regexp_replace(F.lower(F.trim(F.translate("term", "_-", "  "))), r"^\s+|\s+$", "")
    raw = rows.select("segment_id", "p.kind", F.explode("p.m").alias("term", "weight")).where("weight > 0").select("segment_id", "kind", term.alias("term"), F.col("weight").cast("double").alias("weight"))
    own = raw.where("term <> ''").groupBy("segment_id", "kind", "term").agg(F.max("weight").alias("weight"))
    return own.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("segment_id", "kind")))


def segment_idf(profiles: DataFrame) -> DataFrame:
    """(term, segments, idf) with idf = ln((N + 1) / (segments + 1)) + 1 over all four kinds."""
    total = profiles.agg(F.countDistinct("segment_id").alias("n"))
    df = profiles.groupBy("term").agg(F.countDistinct("segment_id").alias("segments"))
    return df.join(F.broadcast(total)).select("term", "segments", (F.ln((F.col("n") + 1.0) / (F.col("segments") + 1.0)) + 1.0).alias("idf"))


def wide_terms(profiles: DataFrame) -> DataFrame:
    """(segment_id, term) with the weight of each kind, 0 where it has none."""
    return profiles.groupBy("segment_id", "term").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("weight"))), F.lit(0.0)).alias(k) for k in KINDS])


def local_weight() -> Column:
    return F.col("terms") + 1.8 * F.col("entities") + 1.2 * F.col("topics") + 1.5 * F.col("local_memory")


def evidence() -> Column:
    has = lambda c: (F.col(c) > 0).cast("double")
    return 1.0 + 0.45 * has("entities") + 0.35 * has("local_memory") + 0.15 * has("topics")


def route(queries: DataFrame, profiles: DataFrame, strategy: str) -> DataFrame:
    """(query_id, segment_id, score, covered) of the segments that share a term with a query.

    ``queries``: distinct (query_id, term).  Strategies: ``sparse``, ``local``,
    ``coverage``, ``kl`` (for ``kl`` the missing terms count with the floor).
    """
    q = queries.select("query_id", "term").distinct()
    sizes = q.groupBy("query_id").agg(F.count("*").alias("_q"))
    hits = q.join(wide_terms(profiles), "term")
    if strategy == "sparse":
        return hits.groupBy("query_id", "segment_id").agg(F.sum(F.col("terms") + 1.3 * F.col("entities") + 0.7 * F.col("topics")).alias("score"), F.count("*").alias("covered"))
    if strategy == "kl":
        # Weights of each kind sum to 1, so the joint total is that of the kinds a segment has.
        share = F.create_map(*[F.lit(x) for p in zip(KINDS, (1.0, 1.3, 0.7, 0.5), strict=True) for x in p])
        mass = profiles.select("segment_id", "kind").distinct().groupBy("segment_id").agg(F.sum(F.try_element_at(share, F.col("kind"))).alias("_mass"))
        joint = F.col("terms") + 1.3 * F.col("entities") + 0.7 * F.col("topics") + 0.5 * F.col("local_memory")
        p = 1.0 / F.col("_q")
        own = hits.join(mass, "segment_id").join(sizes, "query_id")
        part = own.groupBy("query_id", "segment_id", "_q").agg(F.sum(p * F.ln(p / F.greatest(joint / F.col("_mass"), F.lit(SMOOTHING)))).alias("_s"), F.count("*").alias("covered"))
        rest = (F.col("_q") - F.col("covered")) * p * F.ln(p / F.lit(SMOOTHING))
        return part.select("query_id", "segment_id", (-(F.col("_s") + rest)).alias("score"), "covered")
    idf = segment_idf(profiles)
    n = profiles.agg(F.countDistinct("segment_id").alias("n"))
    known = hits.join(idf.select("term", "idf"), "term")
    if strategy == "local":
        return known.groupBy("query_id", "segment_id").agg(F.sum(local_weight() * F.col("idf")).alias("score"), F.count("*").alias("covered"))
    # Terms that no segment holds count with the idf of zero segments.
    total = q.join(idf, "term", "left").join(F.broadcast(n)).groupBy("query_id").agg(F.sum(F.coalesce("idf", F.ln(F.col("n") + 1.0) + 1.0)).alias("_idf"), F.count("*").alias("_q"))
    sums = known.groupBy("query_id", "segment_id").agg(F.sum(local_weight() * F.col("idf") * evidence()).alias("_w"), F.sum("idf").alias("_c"), F.count("*").alias("covered"))
    rare = F.col("_c") / F.col("_idf")
    score = F.col("_w") * (1 + rare) + 2 * rare + F.col("covered") / F.col("_q") + 0.75 * F.sqrt((F.col("covered") - 1).cast("double"))
    return sums.join(total, "query_id").select("query_id", "segment_id", score.alias("score"), "covered")


def best_routes(routes: DataFrame, n: int = 3) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "segment_id")
    return routes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def route_report(routes: DataFrame, gold: DataFrame, n: int = 3) -> DataFrame:
    """For each gold segment of a query (query_id, segment_id): its rank among all routes and its bucket."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "segment_id")
    ranked = routes.withColumn("rank", F.row_number().over(order)).select("query_id", "segment_id", "rank", "score")
    r = F.col("rank")
    bucket = F.when(r.isNull(), "not_routed").when(r <= 5, "top_5").when(r <= 10, "6-10").when(r <= 20, "11-20").otherwise(">20")
    return gold.distinct().join(ranked, ["query_id", "segment_id"], "left").withColumn("bucket", bucket).withColumn("missed", r.isNull() | (r > n))


def differentiators(profiles: DataFrame, keep: int = 8) -> DataFrame:
    """The terms of each segment that set it apart: local weight times idf."""
    rows = wide_terms(profiles).join(segment_idf(profiles).select("term", "idf"), "term").withColumn("score", local_weight() * F.col("idf"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc("score"), "term"))).where(F.col("rank") <= keep).select("segment_id", "rank", "term", "score")


def enrichment(queries: DataFrame, routes: DataFrame, profiles: DataFrame, keep: int = 6) -> DataFrame:
    """Up to ``keep`` terms of the routed segments that a query lacks, by weighted evidence."""
    weights = F.create_map(*[F.lit(x) for p in (("local_memory", 1.6), ("entities", 1.4), ("topics", 1.1), ("terms", 0.8)) for x in p])
    rows = routes.select("query_id", "segment_id").join(profiles, "segment_id").groupBy("query_id", "term").agg(F.round(F.sum(F.col("weight") * F.try_element_at(weights, F.col("kind"))), 9).alias("weight"))
    new = rows.join(queries.select("query_id", "term").distinct(), ["query_id", "term"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def team(queries: DataFrame, profiles: DataFrame, n: int = 3, pool: int | None = None) -> DataFrame:
    """Greedy teams: base scores in Spark, then ``n`` rounds that each add the segment of the largest new coverage.

    The candidates are cut to ``pool`` best routes a query, as the method has it;
    each round is one aggregation over them, for all queries at once.
    """
    pool = pool or max(8, 3 * (n + 1))
    q = queries.select("query_id", "term").distinct()
    cand = best_routes(route(q, profiles, "coverage"), pool).select("query_id", "segment_id", F.col("score").alias("base"))
    idf = segment_idf(profiles).select("term", "idf")
    rows = cand.join(q, "query_id").join(wide_terms(profiles), ["segment_id", "term"]).join(idf, "term")
    rows = keep(rows.select("query_id", "segment_id", "term", "base", (local_weight() * F.col("idf") * evidence()).alias("gain"), "idf"))
    sizes = q.groupBy("query_id").agg(F.count("*").alias("_q"))
    total = q.join(idf, "term").groupBy("query_id").agg(F.sum("idf").alias("_idf"))
    chosen = None
    for k in range(n):
        left = rows
        if chosen is not None:
            covered = rows.join(chosen.select("query_id", "segment_id"), ["query_id", "segment_id"], "left_semi").select("query_id", "term").distinct()
            left = rows.join(covered, ["query_id", "term"], "left_anti").join(chosen.select("query_id", "segment_id"), ["query_id", "segment_id"], "left_anti")
        sums = left.groupBy("query_id", "segment_id").agg(F.sum("gain").alias("_g"), F.sum("idf").alias("_c"), F.count("*").alias("_n"), F.max("base").alias("base"))
        rare = F.col("_c") / F.col("_idf")
        scored = sums.join(sizes, "query_id").join(total, "query_id").withColumn("score", F.col("_g") * (1 + rare) + 2.5 * rare + F.col("_n") / F.col("_q") + 2 * F.col("base"))
        step = best_routes(scored, 1).select("query_id", "segment_id", F.lit(k + 1).alias("pick"), "score")
        chosen = step if chosen is None else chosen.unionByName(step)
    return chosen


def local_memory(turns: list[list[tuple[str, str]]], decay: float = 0.82, prune: float = 0.015, base: float = 0.04, again: float = 0.08) -> dict[str, float]:
    """Decaying memory over the turns of one document: (kind, term) rows a turn, kinds weigh 1.0, 1.4 and 0.8."""
    weight = {"term": 1.0, "entity": 1.4, "topic": 0.8}
    memory: dict[str, float] = {}
    for turn in turns:
        memory = {t: w * decay for t, w in memory.items() if w * decay >= prune}
        for kind, term in turn:
            memory[term] = memory.get(term, 0.0) + weight[kind] * (again if term in memory else base)
    total = sum(memory.values())
    return {t: w / total for t, w in memory.items()} if total > 0 and math.isfinite(total) else {}


def session_scores(results: DataFrame) -> DataFrame:
    """(query_id, session, score) of segment results (score, terms, entities arrays, graph): the best, support and evidence counts."""
    own = Window.partitionBy("query_id", "session").orderBy(F.desc("score"), "doc_id")
    ranked = results.withColumn("_r", F.row_number().over(own))
    n = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    return ranked.groupBy("query_id", "session").agg(
        (F.max("score") + 0.35 * F.coalesce(F.sum(F.when(F.col("_r").between(2, 5), F.col("score"))), F.lit(0.0)) + 0.025 * F.least(n("terms"), F.lit(8))
         + 0.05 * F.least(n("entities"), F.lit(6)) + 0.04 * F.least(F.countDistinct("doc_id"), F.lit(4)) + 0.20 * F.least(F.sum("graph"), F.lit(1.5))).alias("score")
    )


def temporal_boost(routes: DataFrame, days: DataFrame, queries: DataFrame, window: int = 7) -> DataFrame:
    """Routes with up to 2.0 more for records (segment_id, day) near a query's target day."""
    near = F.abs(F.datediff("day", "target"))
    part = F.when(F.col("target").isNull(), F.lit(0.05)).when(near <= window, 1.25 * (1 - near / F.lit(float(window)))).otherwise(F.lit(0.0))
    boost = routes.select("query_id", "segment_id").join(queries.select("query_id", "target"), "query_id").join(days.where("day is not null"), "segment_id").groupBy("query_id", "segment_id").agg(F.least(F.sum(part), F.lit(2.0)).alias("boost"))
    out = routes.join(boost, ["query_id", "segment_id"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return out.withColumn("score", F.col("score") + F.col("boost"))


# How a record's memory fades and grows.
DECAY, PRUNE, BASE, AGAIN = 0.82, 0.015, 0.04, 0.08
KIND_WEIGHTS = {"term": 1.0, "entity": 1.4, "topic": 0.8}
#: Terms kept of a record and of a profile.
PER_RECORD, PER_PROFILE = 24, 96


def rolling_memory(mentions: DataFrame) -> DataFrame:
    """(doc_id, term, weight) from mentions (doc_id, turn, pos, kind, term): ``local_memory`` for all documents at once.

    A term's weight depends on its own mentions only, so each (document, term) is
    folded by itself, over one entry a turn; the weights of a document sum to 1.
    """
    weight = F.try_element_at(F.create_map(*[F.lit(x) for p in KIND_WEIGHTS.items() for x in p]), F.col("kind"))
    last = mentions.groupBy("doc_id").agg(F.max("turn").alias("_last"))
    turns = mentions.withColumn("_w", weight).where(F.col("_w").isNotNull() & F.col("term").isNotNull()).groupBy("doc_id", "term", "turn").agg(F.min_by("_w", "pos").alias("first"), F.sum("_w").alias("all"))
    seen = turns.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list(F.struct("turn", "first", "all"))).alias("s"))

    def faded(state: Column, turn: Column) -> Column:
        now = state["m"] * F.pow(F.lit(DECAY), turn - state["t"])
        return F.when(turn == state["t"], state["m"]).when(now >= PRUNE, now).otherwise(F.lit(0.0))

    def step(state: Column, x: Column) -> Column:
        kept = faded(state, x["turn"])
        more = F.when(kept > 0, AGAIN * x["all"]).otherwise(BASE * x["first"] + AGAIN * (x["all"] - x["first"]))
        return F.struct((kept + more).alias("m"), x["turn"].alias("t"))

    start = F.struct(F.lit(0.0).alias("m"), F.get("s", F.lit(0))["turn"].alias("t"))
    folded = seen.join(last, "doc_id").withColumn("_s", F.aggregate("s", start, step)).select("doc_id", "term", faded(F.col("_s"), F.col("_last")).alias("m")).where("m > 0")
    return folded.select("doc_id", "term", (F.col("m") / F.sum("m").over(Window.partitionBy("doc_id"))).alias("weight"))


def build_profiles(records: DataFrame, per_record: int = PER_RECORD, per_profile: int = PER_PROFILE) -> DataFrame:
    """(segment_id, kind, term, weight) from weighted terms of records (segment_id, doc_id, kind, term, weight), each kind of a segment summing to 1.

    The heaviest ``per_record`` terms of a record and kind count, then the heaviest
    ``per_profile`` of a segment and kind are kept; ties by term.
    """
    own = records.where("weight > 0").groupBy("segment_id", "doc_id", "kind", "term").agg(F.sum("weight").alias("weight"))
    of_record = Window.partitionBy("segment_id", "doc_id", "kind").orderBy(F.desc("weight"), "term")
    best = own.withColumn("_r", F.row_number().over(of_record)).where(F.col("_r") <= per_record)
    summed = best.groupBy("segment_id", "kind", "term").agg(F.sum("weight").alias("weight"))
    of_profile = Window.partitionBy("segment_id", "kind").orderBy(F.desc("weight"), "term")
    kept = summed.withColumn("_r", F.row_number().over(of_profile)).where(F.col("_r") <= per_profile).drop("_r")
    return kept.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("segment_id", "kind")))


def scope(queries: DataFrame, routes: DataFrame, n: int = 3, min_score: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The segments each query is scoped to, and why.

    routes: query_id, segment_id, score.  The ``n`` best segments over ``min_score``
    are taken; a query without one is searched everywhere.  Gives (query_id,
    segment_id) and (query_id, segments, reason) with reason ``scoped``,
    ``no_route`` or ``weak_routes``.
    """
    own = queries.select("query_id").distinct()
    strong = keep(best_routes(routes.where(F.col("score") > min_score), n).select("query_id", "segment_id"))  # n rows a query, read several times
    counts = strong.groupBy("query_id").agg(F.count("*").cast("int").alias("segments"))
    any_route = routes.select("query_id", F.lit(True).alias("_any")).distinct()
    why = F.when(F.col("segments") > 0, "scoped").when(F.col("_any"), "weak_routes").otherwise("no_route")
    told = own.join(counts, "query_id", "left").join(any_route, "query_id", "left").select("query_id", F.coalesce("segments", F.lit(0)).alias("segments"), why.alias("reason"))
    return strong, told


def scoped_search(scores: DataFrame, scoped: DataFrame, members: DataFrame) -> DataFrame:
    """``scores`` (query_id, doc_id, ...) of a global search inside the segments of ``scope``, with segment_id; queries without a segment keep all theirs."""
    # The pairs of query and document stay where they are if the scopes are few.
    sent = F.broadcast if within(scoped, BROADCAST_ROWS) else (lambda df: df)
    routed = scoped.select("query_id", F.lit(True).alias("_routed")).distinct()
    placed = scores.join(members.select("doc_id", "segment_id").distinct(), "doc_id")
    kept = placed.join(sent(scoped.withColumn("_in", F.lit(True))), ["query_id", "segment_id"], "left").join(sent(routed), "query_id", "left")
    return kept.where(F.col("_in") | F.col("_routed").isNull()).drop("_in", "_routed")


# Weights of typed evidence (most that counts, weight) and of pairs.
TYPED = {"people": (3, 1.4), "subjects": (4, 0.75), "times": (2, 1.0), "actions": (3, 0.7), "objects": (4, 0.55)}
PAIRS = {("people", "subjects"): 1.0, ("people", "actions"): 1.0, ("times", "subjects"): 0.8, ("times", "actions"): 0.8, ("subjects", "actions"): 0.75, ("subjects", "objects"): 0.55, ("actions", "objects"): 0.9}


def typed_overlap(query: dict[str, Column], segment: dict[str, Column]) -> Column:
    """Evidence of shared people, subjects, times, actions and objects (arrays by name): 0 unless two kinds are shared and make a pair."""
    shared = {k: F.size(F.array_intersect(query[k], segment[k])) for k in TYPED}
    kinds = sum(((n > 0).cast("int") for n in shared.values()), F.lit(0))
    pairs = sum((F.when((shared[a] > 0) & (shared[b] > 0), F.lit(w)).otherwise(F.lit(0.0)) for (a, b), w in PAIRS.items()), F.lit(0.0))
    own = sum((F.lit(w) * F.least(shared[k], F.lit(most)) for k, (most, w) in TYPED.items()), F.lit(0.0))
    return F.when((kinds >= 2) & (pairs > 0), own + pairs + 0.35 * (kinds - 1)).otherwise(F.lit(0.0))


def temporal_paths(anchors: DataFrame, days: DataFrame, direction: str = "near", window_days: int = 7) -> DataFrame:
    """(query_id, segment_id, score): segments with a day near, before or after one of a query's anchor days.

    anchors: query_id, day; days: segment_id, day.  Near is within the window, before
    and after within four; days are joined by buckets of four windows and their
    neighbours, so nothing is compared with all.
    """
    reach = 4 * window_days
    bucket = lambda c: F.floor(F.unix_date(F.col(c)) / F.lit(reach))
    a = anchors.where("day is not null").select("query_id", F.col("day").alias("_a")).distinct().withColumn("_b", F.explode(F.array(bucket("_a") - 1, bucket("_a"), bucket("_a") + 1)))
    b = days.where("day is not null").select("segment_id", F.col("day").alias("_d")).distinct().withColumn("_b", bucket("_d"))
    gap = F.datediff("_d", "_a")
    fits = {"near": F.abs(gap) <= window_days, "before": gap.between(-reach, -1), "after": gap.between(1, reach)}[direction]
    score = 1.5 * (1 - F.least(F.abs(gap), F.lit(reach)) / F.lit(float(reach))) + (1.0 if direction == "near" else 0.65)
    return a.join(b, "_b").where(fits).groupBy("query_id", "segment_id").agg(F.max(score).alias("score"))


def route_aware(result: Column, route: Column, query_matches: Column, enriched_matches: Column, local: Column, temporal: Column) -> Column:
    """Score of a result in a routed segment from its normalised scores and counts of matches."""
    nothing = (query_matches == 0) & (enriched_matches == 0) & (local == 0)
    return result + 0.35 * route + 0.18 * query_matches + 0.14 * enriched_matches + 0.12 * F.least(local, F.lit(3)) + 0.10 * temporal - F.when(nothing, F.lit(0.18)).otherwise(F.lit(0.0))
