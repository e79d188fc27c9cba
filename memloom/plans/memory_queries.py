"""Queries of segments, measures, answers, the store and session events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.operators import evaluate as E
from memloom.operators import rank as R
from memloom.operators import segments as S
from memloom.operators import store as M
from memloom.plans.rank_queries import _STOP_SQL, _TOK, words
from memloom.sources.tables import table
from memloom.streaming.sessions import daily


def profiles(s: SparkSession, d: str) -> DataFrame:
    return S.long_profiles(table(s, d, "segment_profiles"))


def segment_queries(s: SparkSession, d: str) -> DataFrame:
    """Runs of the questions' words up to the longest term of the profiles, so that every term can be met."""
    longest = profiles(s, d).agg(F.coalesce(F.max(F.size(F.split("term", " "))), F.lit(1)).alias("_longest"))  # one row
    q = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), words("question").alias("_w")).join(F.broadcast(longest))
    upto = lambda n: F.sequence(F.lit(1), n)
    runs = lambda n: F.transform(upto(F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))
    every = F.when(F.size("_w") > 0, F.flatten(F.transform(upto(F.least(F.col("_longest"), F.size("_w"))), runs))).otherwise(F.array().cast("array<string>"))
    return q.select("query_id", F.explode(F.array_distinct(every)).alias("term")).distinct()


def segment_idf(s: SparkSession, d: str) -> DataFrame:
    return S.segment_idf(profiles(s, d)).select("term", "segments", F.round("idf", 6).alias("idf"))


def router(strategy: str):  # noqa: ANN201
    def run(s: SparkSession, d: str) -> DataFrame:
        routes = S.route(segment_queries(s, d), profiles(s, d), strategy)
        return routes.select("query_id", "segment_id", F.round("score", 6).alias("score"), "covered")

    return run


def differentiators(s: SparkSession, d: str) -> DataFrame:
    return S.differentiators(profiles(s, d).withColumn("weight", F.round("weight", 12))).select("segment_id", "rank", "term", F.round("score", 6).alias("score"))


def enriched(s: SparkSession, d: str) -> DataFrame:
    q, p = segment_queries(s, d), profiles(s, d)
    return S.enrichment(q, S.best_routes(S.route(q, p, "local").withColumn("score", F.round("score", 9))), p).select("query_id", "rank", "term", F.round("weight", 6).alias("weight"))


def team(s: SparkSession, d: str) -> DataFrame:
    return S.team(segment_queries(s, d), profiles(s, d)).select("query_id", "segment_id", "pick", F.round("score", 6).alias("score"))


def session_routes(s: SparkSession, d: str) -> DataFrame:
    """Every question's routes among the sessions of its own haystack, whose profiles are built from their turns."""
    t = turns(s, d).distinct()
    own = t.select(F.col("session").alias("segment_id"), "doc_id", F.lit("terms").alias("kind"), F.explode(F.array_distinct(words("text"))).alias("term"), F.lit(1.0).alias("weight")).distinct()
    q = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), F.explode(words("question")).alias("term")).distinct()
    found = S.route(q, S.build_profiles(own), "sparse").withColumn("score", F.round("score", 6))
    return found.join(t.select("query_id", F.col("session").alias("segment_id")).distinct(), ["query_id", "segment_id"], "left_semi")


def router_misses(s: SparkSession, d: str) -> DataFrame:
    """Answer sessions of the questions that have two or more, by where the router ranks them."""
    gold = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), F.explode("answer_session_ids").alias("segment_id")).where("segment_id is not null").distinct()
    many = gold.groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 2")
    report = S.route_report(session_routes(s, d), gold.join(many, "query_id", "left_semi"))
    return report.groupBy("bucket").agg(F.count("*").alias("segments"), F.count(F.when(F.col("missed"), 1)).alias("missed"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def turns(s: SparkSession, d: str) -> DataFrame:
    """Turns of the questions' haystacks: query_id, session, doc_id ``session::turnN``, text."""
    q = table(s, d, "smoke_longmemeval").dropDuplicates(["question_id"])
    one = q.select(F.col("question_id").alias("query_id"), F.explode(F.arrays_zip(F.col("haystack_session_ids").alias("session"), F.col("haystack_sessions").alias("turns"))).alias("h"))
    flat = one.select("query_id", "h.session", F.posexplode("h.turns").alias("n", "t"))
    return flat.select("query_id", "session", F.concat(F.col("session"), F.lit("::turn"), F.col("n").cast("string")).alias("doc_id"), F.concat(F.col("t.role"), F.lit(": "), F.col("t.content")).alias("text")).where("session is not null")


def scoped_ranking(s: SparkSession, d: str) -> DataFrame:
    """Haystack turns of each question by the number of question words they hold, at most two a session."""
    q = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), words("question").alias("q")).dropDuplicates(["query_id"])
    hit = turns(s, d).distinct().join(q, "query_id").withColumn("score", F.size(F.array_intersect("q", words("text"))).cast("double"))
    return R.cap_groups(hit.withColumn("group_id", F.col("session")), 10)


def retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    gold = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), F.explode("answer_session_ids").alias("item")).distinct()
    m = E.retrieval_metrics(scoped_ranking(s, d).select("query_id", F.col("session").alias("item"), "rank"), gold)
    return m.withColumns({c: F.round(c, 6) for c, k in m.dtypes if k == "double"})


def jaccard(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "smoke_longmemeval").select("question_id", "answer_session_ids", "haystack_session_ids").distinct()
    none = F.array().cast("array<string>")
    return q.select("question_id", F.round(E.jaccard(F.coalesce("answer_session_ids", none), F.coalesce("haystack_session_ids", none)), 6).alias("jaccard"))


def count_answer(s: SparkSession, d: str) -> DataFrame:
    return E.count_answer(scoped_ranking(s, d), 10)


def sum_answer(s: SparkSession, d: str) -> DataFrame:
    return E.sum_answer(scoped_ranking(s, d), 10)


def fact_scores(s: SparkSession, d: str) -> DataFrame:
    facts = [["posting list", "postings"], ["token budget"], ["retention window", "retention"]]
    docs = table(s, d, "documents").where("text is not null")
    return docs.select("doc_id", E.fact_score(F.col("text"), facts).alias("found")).where("found > 0")


def preferred(s: SparkSession, d: str) -> DataFrame:
    """The preferred message of every session."""
    m = table(s, d, "messages").where("role is not null").select(
        F.col("msg_id").alias("doc_id"), F.concat_ws("/", "user_id", "session_id").alias("session_id"), F.when(F.lower(F.trim("role")) == "assistant", "summary").otherwise("other").alias("kind"), F.col("ingested_at").alias("at"), F.col("msg_id").alias("rank")
    )
    return E.preferred_documents(m, None)


def excerpt_lines(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text is not null and concept is not null").select("doc_id", "text", F.split("concept", " ").alias("t"))
    return E.excerpts(docs, "doc_id", "text", F.col("t")).select("doc_id", F.md5("excerpt").alias("digest"))


def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    """Sessions: creations, then deletions as later versions; deleted ones are removed."""
    t = table(s, d, "sessions").select("session_id", "status", "event_count", F.coalesce("deleted_at", "created_at").alias("at"), F.col("deleted_at").isNotNull().alias("gone"))
    gone = t.where("gone").select("session_id")
    latest = M.upsert(t.limit(0), t.where("not gone").select(*t.columns), "session_id", "at", gone)
    return latest.select("session_id", "at")


def redacted(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "hook_inputs").where("tool_input is not null").select("hook_id", "tool_input").distinct()
    return M.redact_lines(h, "hook_id", "tool_input").select("hook_id", "secret_lines", F.md5("redacted").alias("digest"))


def credentials(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "messages").where("content is not null")
    return m.groupBy(M.has_credentials(F.col("content")).alias("credentials")).agg(F.count("*").alias("messages"))


def session_sequence(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "hook_inputs").select("hook_id", "session_id", "received_at").distinct()
    return M.sequence_events(h).select("hook_id", "session_id", "sequence")


def interrupted(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "hook_inputs").select("cwd", "session_id", "received_at").where("received_at is not null")
    return M.interrupted(h, "cwd", "session_id", "received_at").select("cwd", "session_id", "started", "last")


def event_kinds(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "hook_inputs").groupBy(M.event_kind(F.col("hook_event_name")).alias("kind")).agg(F.count("*").alias("events"))


def promoted(s: SparkSession, d: str) -> DataFrame:
    """Session events as documents, without starts and ends."""
    h = table(s, d, "hook_inputs").withColumn("kind", M.event_kind(F.col("hook_event_name"))).where("kind not in ('session_start', 'session_end')")
    text = F.coalesce("prompt", "tool_response", "tool_input")
    return h.where(text.isNotNull()).select(F.concat(F.col("session_id"), F.lit("::"), F.col("hook_id").cast("string")).alias("doc_id"), "kind", F.octet_length(text).alias("doc_length")).distinct()


def fingerprint(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pages").select(F.col("rel_path").alias("path"), F.octet_length("content").alias("length"), F.sha2("content", 256).alias("content_hash")).distinct()
    return M.fingerprint(p)


def redacted_export(s: SparkSession, d: str) -> DataFrame:
    """Documents without their content."""
    return table(s, d, "documents").select("doc_id", "source", "concept", "group_id", F.octet_length("text").alias("doc_length"))


def content_blocks(s: SparkSession, d: str) -> DataFrame:
    """Text of the text blocks of tool responses that are lists of blocks."""
    blocks = F.from_json("tool_response", "array<struct<type: string, text: string>>")
    h = table(s, d, "hook_inputs").where(F.startswith("tool_response", F.lit("[{"))).select("hook_id", blocks.alias("b")).distinct()
    return h.select("hook_id", F.array_join(F.transform(F.filter("b", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n").alias("text")).where("text <> ''").select("hook_id", F.md5("text").alias("digest"))


def daily_events(s: SparkSession, d: str) -> DataFrame:
    return daily(table(s, d, "events"))


def inspection(s: SparkSession, d: str) -> DataFrame:
    """Rows of each profile kind."""
    return profiles(s, d).groupBy("kind").agg(F.count("*").alias("entries"), F.countDistinct("segment_id").alias("segments"))


QUERIES = {
    "segment_idf": segment_idf, "route_sparse": router("sparse"), "route_local": router("local"), "route_coverage_local": router("coverage"), "route_kl": router("kl"),
    "differentiators": differentiators, "query_enrichment": enriched, "team_coverage": team, "router_misses": router_misses, "profile_inspection": inspection,
    "recall_mrr_ndcg": retrieval_metrics, "jaccard": jaccard, "count_answer": count_answer, "sum_answer": sum_answer, "fact_scores": fact_scores,
    "preferred_per_session": preferred, "excerpt_lines": excerpt_lines, "upsert_latest": upsert_latest, "redact_lines": redacted, "credential_flags": credentials,
    "session_sequence": session_sequence, "interrupted_sessions": interrupted, "event_kind": event_kinds, "promoted_events": promoted, "corpus_fingerprint": fingerprint,
    "redacted_export": redacted_export, "content_blocks": content_blocks, "daily_tumbling_events": daily_events,
}

_PROF = """
raw as (select segment_id, kind, lower(trim(replace(replace(k, '_', ' '), '-', ' '))) term, w from (
 select segment_id, 'terms' kind, unnest(map_keys(terms)) k, unnest(map_values(terms)) w from segment_profiles union all select segment_id, 'entities', unnest(map_keys(entities)), unnest(map_values(entities)) from segment_profiles
 union all select segment_id, 'topics', unnest(map_keys(topics)), unnest(map_values(topics)) from segment_profiles union all select segment_id, 'local_memory', unnest(map_keys(local_memory)), unnest(map_values(local_memory)) from segment_profiles) where w > 0),
own as (select segment_id, kind, term, max(w) w from raw where term <> '' and segment_id is not null group by 1, 2, 3),
prof as (select segment_id, kind, term, w / sum(w) over (partition by segment_id, kind) weight from own),
n as (select count(distinct segment_id) n from prof),
idf as (select term, count(distinct segment_id) segments, ln((any_value(n) + 1.0::double) / (count(distinct segment_id) + 1.0::double)) + 1 idf from prof, n group by 1),
wide as (select segment_id, term, coalesce(max(weight) filter (kind = 'terms'), 0) t, coalesce(max(weight) filter (kind = 'entities'), 0) e, coalesce(max(weight) filter (kind = 'topics'), 0) p, coalesce(max(weight) filter (kind = 'local_memory'), 0) m from prof group by 1, 2)
"""
_Q = f"""
qw as (select question_id query_id, {_TOK.format('question')} w from smoke_longmemeval),
longest as (select max(len(string_split(term, ' '))) n from prof),
runs as (select query_id, w, unnest(range(1, least(n, len(w)) + 1)) k from qw, longest),
q as (select distinct query_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) term from runs),
hit as (select * from q join wide using (term))
"""
_RANK = f"""
qq as (select question_id query_id, any_value({_TOK.format('question')}) q from smoke_longmemeval group by 1),
hay as (select question_id query_id, unnest(haystack_session_ids) session, unnest(haystack_sessions) ts from (select question_id, any_value(haystack_session_ids) haystack_session_ids, any_value(haystack_sessions) haystack_sessions from smoke_longmemeval group by 1)),
tn as (select distinct query_id, session, session || '::turn' || n doc_id, t.role || ': ' || t.content as "text" from (select query_id, session, unnest(ts) t, generate_subscripts(ts, 1) - 1 n from hay) where session is not null),
sc as (select tn.*, len(list_intersect(q, {_TOK.format('"text"')}))::double score from tn join qq using (query_id)),
gr as (select *, row_number() over (partition by query_id, session order by score desc, doc_id) k, max(score) over (partition by query_id, session) gs from sc),
rk as (select *, row_number() over (partition by query_id order by gs desc, session, k) rank from gr where k <= 2 qualify rank <= 10)
"""
_SECRET = " or ".join(f"contains(lower(line), '{m}')" for m in M.SECRET_MARKERS)
_CRED = """(contains({0}, '-----BEGIN ') or contains({0}, 'Bearer ') or len(list_filter(regexp_split_to_array({0}, '[\\s"'',;=:()\\[\\]{{}}<>]+'), lambda t: regexp_matches(t, '^(?:""" + "|".join(p.replace(".", "[.]") for p in M.CREDENTIALS) + """).{{8,}}') or (strlen(t) >= 40 and regexp_full_match(t, '[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+')))) > 0)"""
_KIND = "case hook_event_name " + " ".join(f"when '{a}' then '{b}'" for a, b in M.EVENT_KINDS.items()) + " else 'provider_event' end"
_LOCAL = "(t + 1.8::double * e + 1.2::double * p + 1.5::double * m)"
_EV = "(1.0::double + 0.45::double * (e > 0)::int + 0.35::double * (m > 0)::int + 0.15::double * (p > 0)::int)"

ORACLES = {
    "segment_idf": f"with {_PROF} select term, segments, round(idf, 6) idf from idf",
    "route_sparse": f"with {_PROF}, {_Q} select query_id, segment_id, round(sum(t + 1.3::double * e + 0.7::double * p), 6) score, count(*) covered from hit group by 1, 2",
    "route_local": f"with {_PROF}, {_Q} select query_id, segment_id, round(sum({_LOCAL} * idf), 6) score, count(*) covered from hit join idf using (term) group by 1, 2",
    "route_coverage_local": f"""with {_PROF}, {_Q}, tot as (select query_id, sum(coalesce(idf, ln((select n from n) + 1.0::double) + 1)) ti, count(*) nq from q left join idf using (term) group by 1),
 s as (select query_id, segment_id, sum({_LOCAL} * idf * {_EV}) w, sum(idf) c, count(*) covered from hit join idf using (term) group by 1, 2)
 select query_id, segment_id, round(w * (1 + c / ti) + 2 * (c / ti) + covered / nq + 0.75::double * sqrt(covered - 1), 6) score, covered from s join tot using (query_id)""",
    "route_kl": f"""with {_PROF}, {_Q}, nq as (select query_id, count(*) nq from q group by 1),
 mass as (select segment_id, sum(case kind when 'terms' then 1.0::double when 'entities' then 1.3::double when 'topics' then 0.7::double else 0.5::double end) mass from (select distinct segment_id, kind from prof) group by 1),
 s as (select query_id, segment_id, nq, sum((1.0::double / nq) * ln((1.0::double / nq) / greatest((t + 1.3::double * e + 0.7::double * p + 0.5::double * m) / mass, 1e-6::double))) s, count(*) covered from hit join mass using (segment_id) join nq using (query_id) group by 1, 2, 3)
 select query_id, segment_id, round(-(s + (nq - covered) * (1.0::double / nq) * ln((1.0::double / nq) / 1e-6::double)), 6) score, covered from s""",
    "differentiators": f"""with {_PROF}, pr as (select segment_id, kind, term, round(weight, 12) weight from prof),
 wd as (select segment_id, term, coalesce(max(weight) filter (kind = 'terms'), 0) t, coalesce(max(weight) filter (kind = 'entities'), 0) e, coalesce(max(weight) filter (kind = 'topics'), 0) p, coalesce(max(weight) filter (kind = 'local_memory'), 0) m from pr group by 1, 2),
 sc as (select segment_id, term, {_LOCAL} * idf score from wd join idf using (term)) select segment_id, row_number() over (partition by segment_id order by score desc, term)::int rank, term, round(score, 6) score from sc qualify rank <= 8""",
    "query_enrichment": f"""with {_PROF}, {_Q}, rt as (select query_id, segment_id, sum({_LOCAL} * idf) score from hit join idf using (term) group by 1, 2), br as (select query_id, segment_id from rt qualify row_number() over (partition by query_id order by round(score, 9) desc, segment_id) <= 3),
 w as (select query_id, term, round(sum(weight * case kind when 'local_memory' then 1.6::double when 'entities' then 1.4::double when 'topics' then 1.1::double else 0.8::double end), 9) weight from br join prof using (segment_id) group by 1, 2)
 select query_id, row_number() over (partition by query_id order by weight desc, term)::int rank, term, round(weight, 6) weight from w where (query_id, term) not in (select query_id, term from q) qualify rank <= 6""",
    "router_misses": f"""with {_RANK[: _RANK.index("sc as (")]} rec as (select distinct session segment_id, doc_id, unnest(list_distinct({_TOK.format('"text"')})) term from tn), r24 as (select * from rec qualify row_number() over (partition by segment_id, doc_id order by term) <= 24),
 s96 as (select segment_id, term, count(*)::double w from r24 group by 1, 2 qualify row_number() over (partition by segment_id order by count(*) desc, term) <= 96), built as (select segment_id, term, w / sum(w) over (partition by segment_id) weight from s96),
 qx as (select distinct question_id query_id, unnest({_TOK.format('question')}) term from smoke_longmemeval), rt as (select query_id, segment_id, round(sum(weight), 6) score from qx join built using (term) where (query_id, segment_id) in (select query_id, session from tn) group by 1, 2),
 rr as (select *, row_number() over (partition by query_id order by score desc, segment_id) rank from rt), gold as (select distinct question_id query_id, unnest(answer_session_ids) segment_id from smoke_longmemeval), g as (select * from gold where segment_id is not null qualify count(*) over (partition by query_id) >= 2)
 select case when rank is null then 'not_routed' when rank <= 5 then 'top_5' when rank <= 10 then '6-10' when rank <= 20 then '11-20' else '>20' end bucket, count(*) segments, count(*) filter (rank is null or rank > 3) missed, round(avg(rank), 6) mean_rank from g left join rr using (query_id, segment_id) group by 1""",
    "corpus_fingerprint": """with p as (select distinct rel_path path, strlen(content) l, sha256(content) h from pages), r as (select path, sha256(concat_ws('|', path, l::varchar, h)) h from p), b as (select substr(sha256(path), 1, 3) b, sha256(string_agg(h, '' order by path, h)) h from r group by 1)
 select sha256(string_agg(h, '' order by b)) fingerprint from b""",
    "content_blocks": """with h as (select distinct hook_id, tool_response j from hook_inputs where starts_with(tool_response, '[{') and json_valid(tool_response)), e as (select hook_id, unnest(from_json(j, '["json"]')) x, generate_subscripts(from_json(j, '["json"]'), 1) i from h)
 select hook_id, md5(string_agg(x->>'text', chr(10) order by i)) digest from e where x->>'type' = 'text' and x->>'text' is not null group by 1 having string_agg(x->>'text', chr(10)) <> ''""",
    "profile_inspection": f"with {_PROF} select kind, count(*) entries, count(distinct segment_id) segments from prof group by 1",
    "recall_mrr_ndcg": f"""with {_RANK}, gold as (select distinct question_id query_id, unnest(answer_session_ids) item from smoke_longmemeval), g as (select * from gold where item is not null), n as (select query_id, count(*) n from g group by 1),
 f as (select query_id, session item, min(rank) rank from rk group by 1, 2), h as (select f.* from f join g using (query_id, item)),
 p as (select query_id, count(*) filter (rank <= 5) h5, count(*) filter (rank <= 10) h10, count(*) filter (rank <= 20) h20, min(rank) fr, sum(1 / log2(rank + 1.0::double)) dcg from h group by 1)
 select query_id, round(coalesce(h5, 0) / n, 6) recall_5, round(coalesce(h10, 0) / n, 6) recall_10, round(coalesce(h20, 0) / n, 6) recall_20, (coalesce(h5, 0) > 0)::int::double any_5, (coalesce(h10, 0) > 0)::int::double any_10, (coalesce(h20, 0) > 0)::int::double any_20,
 round(coalesce(1.0::double / fr, 0), 6) mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0::double))), 6) ndcg_10 from n left join p using (query_id)""",
    "jaccard": """select distinct question_id, round(case when len(list_distinct(list_concat(a, h))) = 0 then 1.0::double else len(list_intersect(a, h)) / len(list_distinct(list_concat(a, h))) end, 6) jaccard
 from (select question_id, coalesce(answer_session_ids, []) a, coalesce(haystack_session_ids, []) h from smoke_longmemeval)""",
    "count_answer": f"with {_RANK} select query_id, count(distinct session) answer from rk where rank <= 10 group by 1",
    "sum_answer": f"""with {_RANK}, f as (select * from rk qualify row_number() over (partition by query_id, session order by rank) = 1)
 select query_id, nullif(sum(coalesce(list_sum(list_transform(regexp_extract_all("text", '\\d+(?:\\.\\d+)?'), lambda x: x::double)), 0)), 0) answer from f group by 1""",
    "fact_scores": """select * from (select doc_id, (contains(t, 'posting list') or contains(t, 'postings'))::int + contains(t, 'token budget')::int + (contains(t, 'retention window') or contains(t, 'retention'))::int found
 from (select doc_id, lower(regexp_replace(text, '[*`_]', '', 'g')) t from documents where text is not null)) where found > 0""",
    "preferred_per_session": """with m as (select msg_id doc_id, concat_ws('/', user_id, session_id) session_id, case when lower(trim(role)) = 'assistant' then 3 else 0 end pr, ingested_at t from messages where role is not null)
 select session_id, arg_max(doc_id, (pr, t, doc_id)) doc_id, min(doc_id) rank from m group by 1""",
    "excerpt_lines": """with l as (select doc_id, string_split(concept, ' ') t, unnest(ls) line, generate_subscripts(ls, 1) pos from (select doc_id, concept, regexp_split_to_array(text, '\\r?\\n') ls from documents where text is not null and concept is not null)),
 s as (select doc_id, pos, trim(line) line, len(list_filter(t, lambda x: contains(lower(line), x))) n from l where trim(line) <> ''),
 r as (select *, max(n) over (partition by doc_id) > 0 hit, row_number() over (partition by doc_id order by n desc, pos) r from s)
 select doc_id, md5(string_agg(line, chr(10) order by pos)) digest from r where case when hit then n > 0 and r <= 3 else r <= 2 end group by 1""",
    "upsert_latest": """select session_id, max(created_at) "at" from sessions where deleted_at is null and session_id not in (select session_id from sessions where deleted_at is not null) group by 1""",
    "redact_lines": f"""with l as (select hook_id, unnest(ls) line, generate_subscripts(ls, 1) pos from (select distinct hook_id, string_split(tool_input, chr(10)) ls from hook_inputs where tool_input is not null)),
 s as (select *, {_SECRET} or {_CRED.format('line')} secret from l)
 select hook_id, sum(secret::int)::bigint secret_lines, md5(string_agg(case when secret then '[REDACTED]' else line end, chr(10) order by pos)) digest from s group by 1""",
    "credential_flags": f"select {_CRED.format('content')} credentials, count(*) messages from messages where content is not null group by 1",
    "session_sequence": "select hook_id, session_id, row_number() over (partition by session_id order by received_at, hook_id)::int sequence from (select distinct hook_id, session_id, received_at from hook_inputs)",
    "interrupted_sessions": """with s as (select cwd, session_id, min(received_at) started, max(received_at) "last" from hook_inputs where received_at is not null group by 1, 2)
 select a.* from s a where exists (select 1 from s b where b.cwd is not distinct from a.cwd and b.started >= a."last" + interval 30 minutes)""",
    "event_kind": f"select {_KIND} kind, count(*) events from hook_inputs group by 1",
    "promoted_events": f"""select distinct session_id || '::' || hook_id doc_id, {_KIND} kind, strlen(coalesce(prompt, tool_response, tool_input))::int doc_length from hook_inputs where {_KIND} not in ('session_start', 'session_end') and coalesce(prompt, tool_response, tool_input) is not null""",
    "redacted_export": "select doc_id, source, concept, group_id, strlen(text)::int doc_length from documents",
    "daily_tumbling_events": """select ts::date "day", event_type, count(*) events, round(sum("value"), 4) "value" from events group by 1, 2""",
}
