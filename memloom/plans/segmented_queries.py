"""Queries of built profiles, scoped search, measures of the ranking and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import evaluate as E
from memloom.operators import facts as A
from memloom.operators import features as X
from memloom.operators import graph as G
from memloom.operators import rank as R
from memloom.operators import segments as S
from memloom.plans.feature_queries import ORACLES as _FEATURE_SQL
from memloom.plans.graph_queries import _EDGES, _FACTS, _MENT, co_occurrence, cross_references, facts, page_links, strong_components
from memloom.plans.memory_queries import _RANK, count_answer, scoped_ranking, turns
from memloom.plans.rank_queries import _TOK, words
from memloom.sources.tables import table

TOP_SEGMENTS = 2


def one_page(s: SparkSession, d: str) -> DataFrame:
    """A row a page with its segment, the first directory."""
    p = table(s, d, "pages").where("rel_path is not null").groupBy(F.col("rel_path").alias("doc_id"))
    rows = p.agg(F.coalesce(F.max("content"), F.lit("")).alias("content"), F.max("concept").alias("concept"), F.min("scanned_at").alias("scanned_at"))
    return rows.withColumn("segment_id", F.split("doc_id", "/")[0])


def records(s: SparkSession, d: str) -> DataFrame:
    """Weighted terms of the pages: every word once, the words of the concept as topics, the concept as entity."""
    p = one_page(s, d)
    kinds = F.array(
        F.struct(F.lit("terms").alias("kind"), F.array_distinct(words("content")).alias("t")),
        F.struct(F.lit("topics").alias("kind"), F.array_distinct(words("concept")).alias("t")),
        F.struct(F.lit("entities").alias("kind"), F.array(F.lower("concept")).alias("t")),
    )
    rows = p.select("segment_id", "doc_id", F.explode(kinds).alias("k")).select("segment_id", "doc_id", "k.kind", F.explode("k.t").alias("term"))
    return rows.where("term is not null").withColumn("weight", F.lit(1.0))


def profiles_built(s: SparkSession, d: str) -> DataFrame:
    built = S.build_profiles(records(s, d))
    return built.select("segment_id", "kind", "term", F.round("weight", 6).alias("weight"))


def question_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), F.explode(words("question")).alias("term")).distinct()


def page_scores(s: SparkSession, d: str) -> DataFrame:
    p, fields = one_page(s, d), {"content": words("content")}
    q = question_words(s, d).withColumnRenamed("term", "token")
    return R.bm25(R.field_tokens(p, fields), q, p.agg(F.count("*").alias("n")), {"content": 1.0}, lengths=R.field_lengths(p, fields)).withColumn("score", F.round("score", 6))


def routes(s: SparkSession, d: str) -> DataFrame:
    found = S.route(question_words(s, d), S.build_profiles(records(s, d)), "sparse")
    return found.withColumn("score", F.round("score", 6))


def segmented_query(s: SparkSession, d: str) -> DataFrame:
    """Ten best pages of each question inside its two best segments; everywhere if it has none."""
    scoped, _ = S.scope(question_words(s, d), routes(s, d), TOP_SEGMENTS)
    inside = S.scoped_search(page_scores(s, d), scoped, one_page(s, d))
    return R.top(inside, 10).select("query_id", "doc_id", "segment_id", "rank", "score")


def segment_scopes(s: SparkSession, d: str) -> DataFrame:
    """How many segments each question is scoped to, and why."""
    return S.scope(question_words(s, d), routes(s, d), TOP_SEGMENTS)[1]


def rolling_memory(s: SparkSession, d: str) -> DataFrame:
    """The fading memory of every page over its chunks: the words of headings as topics, known concepts as entities, words as terms."""
    c = table(s, d, "chunk_nodes").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("doc_rel_path").alias("doc_id"), F.max("heading").alias("heading"), F.max("content").alias("content"))
    turn = F.try_element_at(F.split("chunk_id", "::"), F.lit(-1)).try_cast("int").alias("turn")
    kinds = F.array(F.struct(F.lit("topic").alias("kind"), F.lit(0).alias("pos"), F.array_distinct(words("heading")).alias("t")), F.struct(F.lit("term").alias("kind"), F.lit(1).alias("pos"), F.array_distinct(words("content")).alias("t")))
    rows = c.select("doc_id", turn, F.explode(kinds).alias("k")).select("doc_id", "turn", "k.kind", "k.pos", F.explode("k.t").alias("term")).where("turn is not null")
    return S.rolling_memory(rows).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def haystack_scores(s: SparkSession, d: str) -> DataFrame:
    """BM25 of the turns of each question's own haystack; the statistics are those of all turns."""
    t = turns(s, d).distinct()
    docs = t.groupBy("doc_id").agg(F.max("text").alias("text"))
    fields, q = {"content": words("text")}, question_words(s, d).withColumnRenamed("term", "token")
    allowed = t.select("query_id", "doc_id", F.col("session").alias("group_id")).distinct()
    # Only the pairs of a haystack are formed, as many as there are turns.
    scores = R.bm25(R.field_tokens(docs, fields), q, docs.agg(F.count("*").alias("n")), {"content": 1.0}, lengths=R.field_lengths(docs, fields), pairs=allowed.select("query_id", "doc_id").distinct())
    return scores.withColumn("score", F.round("score", 6)).join(allowed, ["query_id", "doc_id"])


def engine_metrics(s: SparkSession, d: str) -> DataFrame:
    """Measures of the BM25 ranking of sessions, each in its question's haystack."""
    ranked = R.cap_groups(haystack_scores(s, d), 20)
    gold = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), F.explode("answer_session_ids").alias("item")).distinct()
    m = E.retrieval_metrics(ranked.select("query_id", F.col("group_id").alias("item"), "rank"), gold)
    return m.withColumns({c: F.round(c, 6) for c, k in m.dtypes if k == "double"})


def engine_metrics_by_type(s: SparkSession, d: str) -> DataFrame:
    types = table(s, d, "smoke_longmemeval").groupBy(F.col("question_id").alias("query_id")).agg(F.max("question_type").alias("question_type"))
    m = E.mean_metrics(engine_metrics(s, d), types)
    return m.withColumns({c: F.round(c, 5) for c, k in m.dtypes if k == "double"})


def aggregate_answers(s: SparkSession, d: str) -> DataFrame:
    """Intent, limit, text and reasoning of every count and sum question."""
    q = table(s, d, "smoke_longmemeval").groupBy(F.col("question_id").alias("query_id")).agg(F.max("question").alias("question"))
    intents = q.select("query_id", X.aggregate_intent(F.col("question")).alias("intent"))
    return E.answers(intents, count_answer(s, d), E.sum_answer(scoped_ranking(s, d), 10), 10)


def shared_session_terms(s: SparkSession, d: str) -> DataFrame:
    """Words that two or more of a question's ten best sessions share."""
    t = turns(s, d).select("session", F.explode(F.array_distinct(words("text"))).alias("term"))
    shared = E.shared_terms(R.cap_groups(haystack_scores(s, d), 10).select("query_id", F.col("group_id").alias("session")), t)
    return shared.select("query_id", F.array_join("terms", ",").alias("terms"))


def subject_timeline(s: SparkSession, d: str) -> DataFrame:
    subjects = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("subject"))
    return A.subject_timeline(facts(s, d), subjects).select("subject", "predicate", "position", "object", "valid_from", "valid_to")


def severities(s: SparkSession, d: str) -> DataFrame:
    edges = page_links(s, d)
    return G.cross_reference_severity(cross_references(s, d).select("rel_path", "target").distinct(), edges, G.page_nodes(table(s, d, "pages")), strong_components(s, d))


def graph_json(s: SparkSession, d: str) -> DataFrame:
    return G.export_json(G.page_nodes(table(s, d, "pages")), page_links(s, d))


def graph_html(s: SparkSession, d: str) -> DataFrame:
    return G.export_html(G.page_nodes(table(s, d, "pages")).select(F.col("rel_path").alias("node")), page_links(s, d))


def temporal_hard_filter(s: SparkSession, d: str) -> DataFrame:
    """Pages scanned in the month before each question came in."""
    q = table(s, d, "smoke_longmemeval").where("ingested_at is not null").groupBy(F.col("question_id").alias("query_id")).agg(F.to_date(F.min("ingested_at")).alias("target"))
    rows = page_scores(s, d).join(one_page(s, d).select("doc_id", F.to_date("scanned_at").alias("day")), "doc_id").join(q, "query_id")
    near = R.temporal_filter(rows, start=F.date_sub("target", 30), end=F.col("target"), target=F.col("target"), window_days=30)
    return near.groupBy("query_id").agg(F.count("*").alias("documents"), F.round(F.max("score"), 6).alias("best"))


def query_expansion(s: SparkSession, d: str) -> DataFrame:
    """Related concepts of the questions' words, from concepts of the same chunk."""
    pairs = co_occurrence(s, d)
    lexicon = pairs.select(F.col("a").alias("term"), F.col("b").alias("related"), F.lit("similar").alias("relation"), (F.col("weight") / (F.col("weight") + 5.0)).alias("confidence"))
    return R.expand(question_words(s, d), lexicon).select("query_id", "related", F.round("confidence", 6).alias("confidence"))


def temporal_paths(s: SparkSession, d: str) -> DataFrame:
    """Segments with a page scanned after the day a question came in, within four weeks."""
    q = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), F.to_date("ingested_at").alias("day"))
    days = one_page(s, d).select("segment_id", F.to_date("scanned_at").alias("day"))
    found = [S.temporal_paths(q, days, how).select("query_id", "segment_id", F.lit(how).alias("direction"), F.round("score", 6).alias("score")) for how in ("near", "before", "after")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def tier0_index(s: SparkSession, d: str) -> DataFrame:
    """Records by id as JSON: the first of equal ids by its JSON."""
    t = table(s, d, "tier0_records").where("id is not null").select("id", F.to_json(F.struct("id", "source", "author_agent", "doc_length")).alias("record"))
    return t.groupBy("id").agg(F.min("record").alias("record"))


QUERIES = {
    "segment_profiles_built": profiles_built, "segmented_query": segmented_query, "segment_scopes": segment_scopes, "rolling_memory": rolling_memory, "engine_metrics": engine_metrics, "engine_metrics_by_type": engine_metrics_by_type,
    "aggregate_answers": aggregate_answers, "shared_session_terms": shared_session_terms, "subject_timeline": subject_timeline, "cross_ref_severity": severities, "graph_json": graph_json, "graph_html": graph_html,
    "temporal_hard_filter": temporal_hard_filter, "query_expansion": query_expansion, "temporal_paths": temporal_paths, "tier0_index": tier0_index,
}

_PAGE = "pg as (select rel_path doc_id, string_split(rel_path, '/')[1] segment_id, coalesce(max(content), '') content, max(concept) concept, min(scanned_at) scanned_at from pages where rel_path is not null group by 1, 2)"
_BUILT = f"""{_PAGE},
rec as (select segment_id, doc_id, 'terms' kind, unnest(list_distinct({_TOK.format('content')})) term from pg union all select segment_id, doc_id, 'topics', unnest(list_distinct({_TOK.format('concept')})) from pg union all select segment_id, doc_id, 'entities', lower(concept) from pg where concept is not null),
r24 as (select * from rec qualify row_number() over (partition by segment_id, doc_id, kind order by term) <= 24),
s96 as (select segment_id, kind, term, count(*)::double w from r24 group by 1, 2, 3 qualify row_number() over (partition by segment_id, kind order by count(*) desc, term) <= 96),
built as (select segment_id, kind, term, w / sum(w) over (partition by segment_id, kind) weight from s96)
"""
_QW = f"qw as (select distinct question_id query_id, unnest({_TOK.format('question')}) term from smoke_longmemeval)"
_ROUTES = """rt as (select query_id, segment_id, round(sum(case kind when 'terms' then weight when 'entities' then 1.3::double * weight else 0.7::double * weight end), 6) score from qw join built using (term) group by 1, 2),
st as (select query_id, segment_id from rt where score > 0 qualify row_number() over (partition by query_id order by score desc, segment_id) <= 2)"""
_SCORES = """n as (select count(*) n from pg), pw as (select doc_id, {0} w from pg), pt as (select doc_id, len(w) ln, unnest(w) term from pw), tf as (select doc_id, ln, term, count(*) tf from pt group by all),
al as (select avg(len(w)) al from pw where len(w) > 0), df as (select term, count(*) df from tf group by 1),
ps as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * ln / al))), 6) score from qw join tf using (term) join df using (term), n, al group by 1, 2)""".format(_TOK.format("content"))
_TURNS = _RANK[: _RANK.index("sc as (")].rstrip().rstrip(",")
_HAY = f"""{_QW}, {_TURNS}, pg as (select doc_id, max("text") content from tn group by 1), {_SCORES},
al2 as (select distinct query_id, doc_id, session from tn), hs as (select query_id, doc_id, session, score from ps join al2 using (query_id, doc_id)),
gr as (select *, row_number() over (partition by query_id, session order by score desc, doc_id) k, max(score) over (partition by query_id, session) gs from hs),
rk as (select *, row_number() over (partition by query_id order by gs desc, session, k) rank from gr where k <= 2 qualify rank <= 20)"""
_METRICS = """gold as (select distinct question_id query_id, unnest(answer_session_ids) item from smoke_longmemeval), g as (select * from gold where item is not null), gn as (select query_id, count(*) n from g group by 1),
 f as (select query_id, session item, min(rank) rank from rk group by 1, 2), h as (select f.* from f join g using (query_id, item)),
 p as (select query_id, count(*) filter (rank <= 5) h5, count(*) filter (rank <= 10) h10, count(*) filter (rank <= 20) h20, min(rank) fr, sum(1 / log2(rank + 1.0::double)) filter (rank <= 10) dcg from h group by 1),
 me as (select query_id, round(coalesce(h5, 0) / n, 6) recall_5, round(coalesce(h10, 0) / n, 6) recall_10, round(coalesce(h20, 0) / n, 6) recall_20, (coalesce(h5, 0) > 0)::int::double any_5, (coalesce(h10, 0) > 0)::int::double any_10, (coalesce(h20, 0) > 0)::int::double any_20,
 round(coalesce(1.0::double / fr, 0), 6) mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0::double))), 6) ndcg_10 from gn left join p using (query_id))"""
_MEANS = "count(*) queries, " + ", ".join(f"round(avg({c}), 5) {c}" for c in ("recall_5", "recall_10", "recall_20", "any_5", "any_10", "any_20", "mrr", "ndcg_10"))
_PATH = "select query_id, segment_id, '{0}' direction, round(max(1.5::double * (1 - least(abs(gap), 28) / 28.0::double) + {1}), 6) score from g where {2} group by 1, 2"

ORACLES = {
    "segment_profiles_built": f"with {_BUILT} select segment_id, kind, term, round(weight, 6) weight from built",
    "segmented_query": f"""with {_BUILT}, {_QW}, {_ROUTES}, {_SCORES}, pl as (select ps.*, segment_id from ps join pg using (doc_id)),
 k as (select * from pl where (query_id, segment_id) in (select query_id, segment_id from st) or query_id not in (select query_id from st))
 select query_id, doc_id, segment_id, row_number() over (partition by query_id order by score desc, doc_id)::int rank, score from k qualify rank <= 10""",
    "segment_scopes": f"""with {_BUILT}, {_QW}, {_ROUTES} select query_id, count(st.segment_id)::int segments, case when count(st.segment_id) > 0 then 'scoped' when query_id in (select query_id from rt) then 'weak_routes' else 'no_route' end reason
 from (select distinct query_id from qw) left join st using (query_id) group by 1""",
    "engine_metrics": f"with {_HAY}, {_METRICS} select * from me",
    "engine_metrics_by_type": f"""with {_HAY}, {_METRICS}, ty as (select question_id query_id, max(question_type) question_type from smoke_longmemeval group by 1), j as (select me.*, coalesce(question_type, 'unknown') question_type from me left join ty using (query_id))
 select question_type, {_MEANS} from j group by 1 union all select 'all', {_MEANS} from j""",
    "aggregate_answers": f"""with {_RANK}, it as ({_FEATURE_SQL['aggregate_intents']}), ca as (select query_id, count(distinct session)::double c from rk where rank <= 10 group by 1),
 f as (select * from rk qualify row_number() over (partition by query_id, session order by rank) = 1), sa as (select query_id, nullif(sum(coalesce(list_sum(list_transform(regexp_extract_all("text", '\\d+(?:\\.\\d+)?'), lambda x: x::double)), 0)), 0) s from f group by 1),
 v as (select question_id query_id, intent, case intent when 'count' then coalesce(c, 0) else s end v from it left join ca on ca.query_id = question_id left join sa on sa.query_id = question_id where intent <> 'none')
 select query_id, intent, 10 "limit", case when v is null then 'unknown' when v = floor(v) then printf('%.0f', v) else printf('%.2f', v) end "text", case intent when 'count' then 'distinct groups among the first 10 results' else 'numbers of the first result of each group among the first 10' end reasoning from v""",
    "shared_session_terms": f"""with {_HAY}, top as (select distinct query_id, session from rk where rank <= 10), w as (select distinct session, unnest({_TOK.format('"text"')}) term from tn),
 t as (select query_id, term from top join w using (session) group by 1, 2 having count(*) >= 2), x as (select * from t qualify row_number() over (partition by query_id order by term) <= 20) select query_id, string_agg(term, ',' order by term) terms from x group by 1""",
    "subject_timeline": f"""with {_FACTS} select subject, predicate, row_number() over (partition by subject order by valid_from nulls first, valid_to nulls first, predicate, doc_id)::int "position", object, valid_from, valid_to from facts where subject in (select c_custkey::varchar from customer)""",
    "graph_json": f"""with {_EDGES} select '{{"kind":"node","rel_path":' || to_json(rel_path) || case when concept is null then '' else ',"concept":' || to_json(concept) end || '}}' "value" from node
 union all select '{{"kind":"edge","src":' || to_json(src) || ',"dst":' || to_json(dst) || '}}' from edge""",
    "temporal_hard_filter": f"""with {_PAGE}, {_QW}, {_SCORES}, q as (select question_id query_id, min(ingested_at)::date target from smoke_longmemeval where ingested_at is not null group by 1)
 select query_id, count(*) documents, round(max(score), 6) best from ps join (select doc_id, scanned_at::date dy from pg) using (doc_id) join q using (query_id) where dy between target - 30 and target group by 1""",
    "query_expansion": f"""with {_MENT}, {_QW}, lx as (select a term, b related, weight / (weight + 5.0::double) c from pair union all select b, a, weight / (weight + 5.0::double) from pair), m as (select term, related, max(c) c from lx where term <> related group by 1, 2),
 e as (select query_id, term, related, c from qw join m using (term) where (query_id, related) not in (select query_id, term from qw) qualify row_number() over (partition by query_id, term order by c desc, related) <= 3)
 select query_id, related, round(max(c), 6) confidence from e group by 1, 2""",
    "tier0_index": """select id, min('{"id":' || to_json(id) || case when source is null then '' else ',"source":' || to_json(source) end || case when author_agent is null then '' else ',"author_agent":' || to_json(author_agent) end || case when doc_length is null then '' else ',"doc_length":' || doc_length end || '}') record from tier0_records where id is not null group by 1""",
    "temporal_paths": f"""with {_PAGE}, a as (select distinct question_id query_id, ingested_at::date x from smoke_longmemeval where ingested_at is not null), b as (select distinct segment_id, scanned_at::date y from pg where scanned_at is not null), g as (select query_id, segment_id, (y - x)::int gap from a, b)
 {_PATH.format('near', '1.0::double', 'abs(gap) <= 7')} union all {_PATH.format('before', '0.65::double', 'gap between -28 and -1')} union all {_PATH.format('after', '0.65::double', 'gap between 1 and 28')}""",
}
