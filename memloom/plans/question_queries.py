"""Queries of question analysis, session scores and front matter, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import features as X
from memloom.operators import intake as I
from memloom.operators import questions as Q
from memloom.operators import segments as S
from memloom.plans.graph_queries import _MENT, co_occurrence
from memloom.plans.memory_queries import _RANK, scoped_ranking, turns
from memloom.plans.rank_queries import _TOK, words
from memloom.sources import markdown as D
from memloom.sources.tables import table


def analysis(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "smoke_longmemeval").select("question_id", "question", F.to_date("ingested_at").alias("today")).distinct()
    done = q.withColumn("a", Q.analyse(F.col("question"), F.col("today")))
    intent = X.aggregate_intent(F.col("question"))
    return done.select("question_id", "a.*", Q.time_hint(F.col("question")).alias("hint"), Q.routing_intent(F.col("question"), intent).alias("intent"))


def session_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of the sessions among a question's best turns: matched words as terms, names in them as entities, shared names as graph."""
    q = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), words("question").alias("q")).dropDuplicates(["query_id"])
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"), F.lit(0)))
    hits = scoped_ranking(s, d).drop("q").join(q, "query_id").select("query_id", "session", "doc_id", "score", F.array_intersect("q", words("text")).alias("terms"), named.alias("entities"), (0.08 * F.least(F.size(named), F.lit(5))).alias("graph"))
    return S.session_scores(hits).select("query_id", "session", F.round("score", 6).alias("score"))


def front_matter(s: SparkSession, d: str) -> DataFrame:
    meta = D.front_matter(F.col("content"))
    p = table(s, d, "pages").where("content is not null").select("rel_path", meta.alias("m")).withColumn("n", F.size("m"))
    return p.where("n > 0").select("rel_path", F.coalesce(D.author(F.col("m")), F.lit("")).alias("author"), F.coalesce(F.try_element_at("m", F.lit("topic")), F.lit("")).alias("topic")).distinct()


def text_headings(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pages").where("content is not null").select("rel_path", "content").distinct()
    return p.select("rel_path", F.size(D.headings(F.col("content"))).alias("headings"), F.size(D.link_targets(F.col("content"))).alias("links")).where("headings > 0 or links > 0")


def validation(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "messages")
    fault = I.problems(F.col("request_id"), F.col("user_id"), F.lower(F.trim("role")), F.col("content"))
    return m.groupBy(F.coalesce(fault, F.lit("none")).alias("problem")).agg(F.count("*").alias("messages"))


def scoped_pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").where(I.in_scope(F.col("rel_path"), ["/archive/", "channels"], "docs/")).select("rel_path").distinct()


def store_sync(s: SparkSession, d: str) -> DataFrame:
    """Sessions whose latest row differs from their first in status, deletion or events."""
    t = table(s, d, "sessions").select("session_id", "status", "event_count", "deleted_at", "created_at").distinct()
    order = F.struct(F.coalesce("deleted_at", "created_at"), "event_count", "status")
    pick = lambda f: t.groupBy("session_id").agg(*[f(c, order).alias(c) for c in ("status", "event_count", "deleted_at")])
    return I.changed(pick(F.min_by), pick(F.max_by), "session_id", ["status", "event_count", "deleted_at"]).select("session_id")


def lexicon(s: SparkSession, d: str) -> DataFrame:
    pairs = co_occurrence(s, d).select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("weight").alias("confidence"))
    both = pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"), "confidence"))
    return I.top_relations(both).select("source", "target", "confidence", "rank")


def memories(s: SparkSession, d: str) -> DataFrame:
    return I.memories(table(s, d, "hook_inputs"), "prompt", "received_at").select("hook_id", "session_id", "preview")


def bounded(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "hook_inputs").where("tool_input is not null").select("hook_id", "tool_input").distinct()
    return h.select("hook_id", I.bounded_json(F.col("tool_input")).alias("tool_input"))


def common_runs(s: SparkSession, d: str) -> DataFrame:
    """Questions against each turn of their haystack by longest common word run."""
    q = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), words("question").alias("q")).dropDuplicates(["query_id"])
    return turns(s, d).distinct().join(q, "query_id").select("query_id", "doc_id", F.round(I.common_run(F.col("q"), words("text")), 6).alias("ratio")).where("ratio > 0")


QUERIES = {
    "input_validation": validation, "scoped_pages": scoped_pages, "store_sync": store_sync, "lexicon_top": lexicon, "list_memories": memories, "bounded_json": bounded, "common_runs": common_runs,
    "query_analysis": analysis, "session_scores": session_scores, "front_matter": front_matter, "text_headings": text_headings,
}

ORACLES = {
    "session_scores": f"""with {_RANK}, e as (select rk.*, qq.q qs, list_distinct(regexp_extract_all("text", '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b')) ent, row_number() over (partition by query_id, session order by score desc, doc_id) r from rk join qq using (query_id) where rank <= 10),
 t as (select query_id, session, count(distinct x) n from (select query_id, session, unnest(list_intersect(qs, {_TOK.format('"text"')})) x from e) group by 1, 2), n as (select query_id, session, count(distinct x) n from (select query_id, session, unnest(ent) x from e) group by 1, 2),
 s as (select query_id, session, max(score) + 0.35::double * coalesce(sum(score) filter (r between 2 and 5), 0) + 0.04::double * least(count(distinct doc_id), 4) + 0.20::double * least(sum(0.08::double * least(len(ent), 5)), 1.5::double) sc from e group by 1, 2)
 select query_id, session, round(sc + 0.025::double * least(coalesce(t.n, 0), 8) + 0.05::double * least(coalesce(n.n, 0), 6), 6) score from s left join t using (query_id, session) left join n using (query_id, session)""",
    "input_validation": """select case when user_id is null or trim(user_id) = '' or strlen(user_id) > 256 then 'user_id' when request_id is null or trim(request_id) = '' or strlen(request_id) > 256 then 'request_id'
 when coalesce(lower(trim(role)), '') not in ('user', 'assistant') then 'role' when coalesce(trim(content), '') = '' then 'content' else 'none' end problem, count(*) messages from messages group by 1""",
    "scoped_pages": "select distinct rel_path from pages where starts_with(rel_path, 'docs/') and not contains(rel_path, '/archive/') and not contains(rel_path, 'channels')",
    "store_sync": """with t as (select distinct session_id, status, event_count, deleted_at, coalesce(deleted_at, created_at) o from sessions),
 a as (select *, row_number() over (partition by session_id order by o, event_count, status) f, row_number() over (partition by session_id order by o desc, event_count desc, status desc) l from t)
 select x.session_id from a x join a y on x.session_id = y.session_id and x.f = 1 and y.l = 1 where x.status is distinct from y.status or x.event_count is distinct from y.event_count or x.deleted_at is distinct from y.deleted_at""",
    "lexicon_top": f"""with {_MENT}, b as (select a source, b target, weight confidence from pair union all select b, a, weight from pair)
 select source, target, confidence, row_number() over (partition by source order by confidence desc, target)::int rank from b qualify rank <= 12""",
    "list_memories": """select hook_id, session_id, substr(prompt, 1, 2000) preview from (select distinct hook_id, session_id, prompt, received_at from hook_inputs where trim(prompt) <> '') order by received_at desc, hook_id desc limit 50""",
    "front_matter": """with b as (select distinct rel_path, regexp_extract(content, '(?s)^---\\r?\\n(.*?)\\r?\\n---', 1) b from pages where content like '---%'),
 l as (select rel_path, unnest(regexp_split_to_array(b, '\\r?\\n')) l from b), k as (select rel_path, lower(trim(split_part(l, ':', 1))) k, trim(substr(l, position(':' in l) + 1)) v from l where contains(l, ':'))
 select rel_path, coalesce(max(v) filter (k = 'author'), max(v) filter (k = 'agent'), max(v) filter (k = 'author_agent'), max(v) filter (k = 'created_by'), '') author, coalesce(max(v) filter (k = 'topic'), '') topic from k group by 1""",
    "text_headings": """select * from (select rel_path, len(regexp_extract_all(content, '(?m)^#{1,6}[ \\t]+(.*?)[ \\t]*$'))::int headings, (len(regexp_extract_all(content, '\\[\\[([^\\]|]+)')) + len(regexp_extract_all(content, '\\[[^\\]]*\\]\\(([^)\\s]+)')))::int links
 from (select distinct rel_path, content from pages where content is not null)) where headings > 0 or links > 0""",
}
