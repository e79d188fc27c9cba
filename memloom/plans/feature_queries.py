"""Queries of tokens, ranked terms, chunks, types and claims, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.operators import features as X
from memloom.sources.tables import table

_STOP = "'" + "','".join(T.RANKER_STOP_WORDS) + "'"
_NOISE = "'" + "','".join(T.NOISE_CONCEPTS) + "'"
_WORDS = "list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_-]{{{1},}}'), lambda x: lower(x))"


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")


def token_counts(s: SparkSession, d: str) -> DataFrame:
    w = T.tokens(F.col("text"))
    kept = F.size(F.filter(w, lambda t: ~t.isin(T.ROUTING_STOP_WORDS)))
    return documents(s, d).select("doc_id", F.size(w).cast("long").alias("tokens"), F.size(F.array_distinct(w)).cast("long").alias("distinct_tokens"), kept.cast("long").alias("kept"))


def token_df_idf(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d)
    per_doc = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    total = docs.agg(F.count("*").alias("n"))  # one row
    idf = F.ln((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1
    return per_doc.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("term", "df", F.round(idf, 6).alias("idf"))


def yake(s: SparkSession, d: str) -> DataFrame:
    return X.yake_terms(documents(s, d)).select("doc_id", "term", F.round("score", 6).alias("score"))


def rake(s: SparkSession, d: str) -> DataFrame:
    return X.rake_terms(documents(s, d)).select("doc_id", "term", F.round("score", 6).alias("score"))


def cvalue(s: SparkSession, d: str) -> DataFrame:
    return X.cvalue_terms(documents(s, d)).select("doc_id", "term", F.round("score", 6).alias("score"))


def textrank(s: SparkSession, d: str) -> DataFrame:
    return X.textrank_terms(documents(s, d)).select("doc_id", "term", F.round("score", 6).alias("score"), "rank")


def line_chunks(s: SparkSession, d: str) -> DataFrame:
    return X.line_chunks(documents(s, d), 8, 2).select("doc_id", "start_line", "end_line", F.md5("content").alias("digest"))


def heading_chunks(s: SparkSession, d: str) -> DataFrame:
    return X.chunk_by_headings(documents(s, d))


def hybrid_chunks(s: SparkSession, d: str) -> DataFrame:
    return X.hybrid_chunks(documents(s, d))


def heading_buckets(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunk_nodes").dropDuplicates(["chunk_id"])
    return chunks.groupBy(X.heading_bucket(F.col("heading")).alias("bucket")).agg(F.count("*").alias("chunks"))


def doc_types(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages").select("rel_path", "headings", "content").distinct()
    kind = F.coalesce(X.doc_type(F.col("headings"), F.col("content")), F.lit("none"))
    return pages.select("rel_path", kind.alias("doc_type")).distinct()


def topics(s: SparkSession, d: str) -> DataFrame:
    """First heading, else the first ranked term."""
    pages = table(s, d, "pages").where(F.col("content").isNotNull()).groupBy("rel_path").agg(F.max("content").alias("text"), F.max("headings").alias("headings"))
    first = F.get(F.filter("headings", lambda h: F.trim(h) != ""), 0)
    best = X.yake_terms(pages, "rel_path").where("rank = 1").select("rel_path", "term")
    return pages.join(best, "rel_path", "left").select("rel_path", F.coalesce(first, F.col("term")).alias("topic"))


def intents(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "smoke_longmemeval").select("question_id", "question").distinct()
    return q.select("question_id", F.coalesce(X.aggregate_intent(F.col("question")), F.lit("none")).alias("intent"))


def strict_dates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "messages").select("msg_id", X.strict_date(F.col("timestamp")).alias("day")).where("day is not null").distinct()


def temporal(s: SparkSession, d: str) -> DataFrame:
    terms = documents(s, d).select("doc_id", X.temporal_terms(F.col("text")).alias("terms"))
    return terms.where(F.size("terms") > 0).select("doc_id", F.array_join("terms", ";").alias("terms"))


def noise(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "documents").where(F.col("concept").isNotNull()).select("concept").distinct()
    return c.select("concept", T.is_noise(F.col("concept")).alias("noise"))


def concepts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("rel_path", T.concept_key(F.col("raw_concept")).alias("concept")).distinct()


def chunk_features(s: SparkSession, d: str) -> DataFrame:
    """Chunks with the entities (here the page concepts they name) and ranked terms found in them."""
    chunks = table(s, d, "chunk_nodes").where(F.col("content").isNotNull()).groupBy("chunk_id").agg(
        F.max("doc_rel_path").alias("rel_path"), F.max("heading").alias("heading"), F.max("content").alias("content")
    )
    pages = table(s, d, "pages").where(F.col("content").isNotNull()).groupBy("rel_path").agg(F.max("content").alias("text"), F.max("concept").alias("concept"))
    terms = X.yake_terms(pages, "rel_path").groupBy("rel_path").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    own = chunks.join(terms, "rel_path").join(pages.select("rel_path", "concept"), "rel_path")
    inside = F.filter("terms", lambda t: F.contains(F.lower("content"), t))
    return own.withColumn("terms", inside).withColumn("entities", F.when(F.contains(F.lower("content"), F.lower("concept")), F.array("concept")).otherwise(F.array().cast("array<string>")))


def chunk_enrichment(s: SparkSession, d: str) -> DataFrame:
    return chunk_features(s, d).select("chunk_id", F.array_join("terms", ",").alias("terms"), F.array_join("entities", ",").alias("entities"))


def claim_rows(s: SparkSession, d: str) -> DataFrame:
    own = chunk_features(s, d).select(F.col("rel_path").alias("doc_id"), "heading", "content", F.lit(None).cast("string").alias("ts"), F.col("concept").alias("topic"), "entities", "terms")
    return X.claims(own)


def entities(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text", "concept")
    return X.key_entities(docs).select("doc_id", "entity", "label", F.round("score", 6).alias("score"))


def stems(s: SparkSession, d: str) -> DataFrame:
    """Distinct words of the corpus with their index form."""
    words = documents(s, d).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", T.index_forms(F.col("word")).alias("stem"))


def stable_ids(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunk_nodes").select("chunk_id", "doc_rel_path", "heading", "content").distinct()
    return chunks.select("chunk_id", T.stable_id("chunk", F.col("doc_rel_path"), F.col("heading"), F.col("content")).alias("stable_id"))


QUERIES = {
    "token_counts": token_counts, "token_df_idf": token_df_idf, "yake_terms": yake, "rake_terms": rake, "cvalue_terms": cvalue, "textrank_terms": textrank,
    "line_chunks": line_chunks, "heading_chunks": heading_chunks, "hybrid_chunks": hybrid_chunks, "heading_buckets": heading_buckets, "doc_type_guess": doc_types,
    "probable_topic": topics, "aggregate_intents": intents, "strict_dates": strict_dates, "temporal_terms": temporal, "noise_concepts": noise, "concept_keys": concepts,
    "chunk_enrichment": chunk_enrichment, "claims": claim_rows, "key_entities": entities, "index_stems": stems, "stable_ids": stable_ids,
}

_YAKE = """
tok as (select k, w, len(w) total from (select k, {words} w from src)),
pos as (select k, total, unnest(w) term, generate_subscripts(w, 1) - 1 pos from tok),
sent as (select k, unnest(string_split_regex(text, '[.!?]')) s from src),
ns as (select k, greatest(count(*) filter (trim(regexp_replace(s, '\\s', ' ', 'g')) <> ''), 1) sentences from sent group by k),
hits as (select k, term, count(*) h from (select distinct k, s_id, unnest({words_s}) term from (select k, s, row_number() over () s_id from sent)) group by 1, 2),
f as (select k, term, count(*) n, min(pos) first_pos, any_value(total) total from pos where term not in ({stop}) group by 1, 2),
sc as (select f.k, f.term, (n / total) * (2 - first_pos / total) * (1 + coalesce(h, 1) / sentences) * 100 score from f join ns using (k) left join hits using (k, term)),
yake as (select k, term, round(score, 6) score, row_number() over (partition by k order by score desc, term) rank from sc qualify rank <= 12)
""".format(words=_WORDS.format("text", 2), words_s=_WORDS.format("s", 2), stop=_STOP)

_BUCKET = """case when h is null or h in ('', '(unscoped)', '(untitled section)') then 'unscoped' when contains(h, 'related') then 'related' when contains(h, 'troubleshoot') then 'troubleshooting'
 when contains(h, 'setup') or contains(h, 'quickstart') or contains(h, 'quick start') then 'setup' when contains(h, 'config') then 'configuration'
 when contains(h, 'overview') or contains(h, 'what it is') or contains(h, 'history') then 'overview' when contains(h, 'security') or contains(h, 'access control') or contains(h, 'auth') then 'security'
 when contains(h, 'routing') or contains(h, 'session') then 'routing' else h end"""

_CHUNKS = f"""
src as (select rel_path k, max(content) "text", max(concept) concept from pages where content is not null group by 1), {_YAKE},
ch as (select chunk_id, max(doc_rel_path) k, max(heading) heading, max(content) content from chunk_nodes where content is not null group by 1),
terms as (select k, list_sort(list(term)) terms from yake group by 1),
feat as (select ch.*, concept, list_filter(terms, lambda t: contains(lower(content), t)) terms, case when contains(lower(content), lower(concept)) then [concept] else []::varchar[] end entities from ch join terms using (k) join src using (k))
"""

ORACLES = {
    "token_counts": f"""with t as (select doc_id, {_WORDS.format('text', 2)} w from documents where text is not null)
 select doc_id, len(w)::bigint tokens, len(list_distinct(w))::bigint distinct_tokens, len(list_filter(w, lambda x: x not in ('{"','".join(T.ROUTING_STOP_WORDS)}')))::bigint kept from t""",
    "token_df_idf": f"""with t as (select doc_id, unnest(list_distinct({_WORDS.format('text', 2)})) term from documents where text is not null), n as (select count(*) n from documents where text is not null)
 select term, count(*) df, round(ln((any_value(n) + 1.0::double) / (count(*) + 1.0::double)) + 1, 6) idf from t, n group by term""",
    "yake_terms": f'with src as (select doc_id k, text from documents where text is not null), {_YAKE} select k doc_id, term, score from yake',
    "rake_terms": f"""with tok as (select doc_id, unnest(w) t, generate_subscripts(w, 1) pos from (select doc_id, {_WORDS.format('text', 1)} w from documents where text is not null)),
 isl as (select *, t in ({_STOP}) st, sum((t in ({_STOP}))::int) over (partition by doc_id order by pos rows unbounded preceding) ph from tok),
 k as (select *, count(*) over (partition by doc_id, ph) ln from isl where not st qualify ln <= 5),
 ws as (select doc_id, t, (sum(ln - 1) + count(*)) / count(*) ws from k group by 1, 2),
 p as (select doc_id, ph, string_agg(t, ' ' order by pos) term, sum(ws) ps from k join ws using (doc_id, t) group by 1, 2),
 s as (select doc_id, term, sum(ps) score from p where strlen(term) >= 4 group by 1, 2)
 select doc_id, term, round(score, 6) score from s qualify row_number() over (partition by doc_id order by score desc, term) <= 12""",
    "cvalue_terms": f"""with tok as (select doc_id, {_WORDS.format('text', 2)} w from documents where text is not null),
 g as (select doc_id, array_to_string(w[i:i + n - 1], ' ') term from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from tok, (values (2), (3), (4)) v(n))),
 f as (select doc_id, term, count(*) n, string_split(term, ' ') p from g group by 1, 2),
 r as (select distinct doc_id, term longer, n ln, right(p[i], 3) k1, left(p[i + 1], 3) k2 from (select *, unnest(range(1, len(p))) i from f)),
 nest as (select distinct f.doc_id, f.term, longer, ln from f join r on f.doc_id = r.doc_id and right(p[1], 3) = k1 and left(p[2], 3) = k2 where strlen(longer) > strlen(f.term) and contains(longer, f.term)),
 m as (select doc_id, term, avg(ln) mean from nest group by 1, 2),
 s as (select f.doc_id, f.term, log2(len(p)) * greatest(n - coalesce(mean, 0), 0) score from f left join m using (doc_id, term))
 select doc_id, term, round(score, 6) score from s where score > 0 qualify row_number() over (partition by doc_id order by score desc, term) <= 12""",
    "line_chunks": """with l as (select doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(10) || '$', ''), chr(10)) ls from documents where text is not null),
 c as (select doc_id, ls, len(ls) n, unnest(range(0, (case when len(ls) <= 8 then 0 else ceil((len(ls) - 8) / 6)::int * 6 end) + 1, 6)) st from l),
 b as (select doc_id, st, least(st + 8, n) e, regexp_replace(regexp_replace(array_to_string(ls[st + 1:st + 8], chr(10)), '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') body from c)
 select doc_id, (st + 1)::int start_line, e::int end_line, md5(body) digest from b where body <> ''""",
    "heading_buckets": f"select {_BUCKET} bucket, count(*) chunks from (select chunk_id, lower(trim(any_value(heading))) h from chunk_nodes group by 1) group by 1",
    "doc_type_guess": """select distinct rel_path, case when contains(h, 'incident') or contains(c, 'postmortem') then 'incident' when contains(h, 'runbook') or contains(c, 'playbook') then 'runbook'
 when contains(h, 'changelog') or contains(c, 'release notes') then 'changelog' when contains(h, 'reference') then 'reference' when contains(h, 'tutorial') or contains(h, 'quick start') then 'tutorial'
 when contains(h, 'decision') or contains(c, 'adr') then 'decision' else 'none' end doc_type
 from (select rel_path, coalesce(lower(array_to_string(headings, ' ')), '') h, coalesce(lower(content), '') c from pages)""",
    "probable_topic": f"""with src as (select rel_path k, max(content) "text", max(headings) hs from pages where content is not null group by 1), {_YAKE}
 select src.k rel_path, coalesce(list_filter(hs, lambda h: trim(h) <> '')[1], term) topic from src left join (select * from yake where rank = 1) y on y.k = src.k""",
    "aggregate_intents": """select distinct question_id, case when contains(q, 'how many') or q like 'count %' or contains(q, ' number of') or contains(q, 'count the ') or contains(q, 'times did i') then 'count'
 when contains(q, 'how much') or contains(q, ' total ') or q like 'total %' or contains(q, 'combined') or contains(q, 'in all') or contains(q, 'sum ') then 'sum' else 'none' end intent
 from (select question_id, lower(question) q from smoke_longmemeval)""",
    "strict_dates": """select distinct msg_id, try_cast(substr(timestamp, 1, 10) as date) "day" from messages
 where regexp_full_match(timestamp, '\\d{4}-\\d{2}-\\d{2}(T([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d(\\.\\d+)?)?') and try_cast(substr(timestamp, 1, 10) as date) is not null""",
    "stable_ids": """with c as (select distinct chunk_id, coalesce(doc_rel_path, '') a, lower(trim(regexp_replace(coalesce(heading, ''), '\\s+', ' ', 'g'))) b, lower(trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g'))) d from chunk_nodes),
 h as (select chunk_id, hex(encode(a)) || 'FF' || hex(encode(b)) || 'FF' || hex(encode(d)) || 'FF' x from c), y as (select chunk_id, list_transform(range(1, len(x)::bigint, 2), lambda i: ('0x' || substr(x, i, 2))::hugeint) v from h)
 select chunk_id, 'chunk:' || lpad(lower(hex(list_reduce(v, lambda s, b: (xor(s, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint, 14695981039346656037::hugeint)::ubigint)), 16, '0') stable_id from y""",
    "noise_concepts": f"select distinct concept, strlen(concept) < 3 or regexp_full_match(concept, '[0-9]+') or concept in ({_NOISE}) noise from documents where concept is not null",
    "concept_keys": "select distinct rel_path, lower(replace(replace(trim(raw_concept), '_', ' '), '-', ' ')) concept from pages",
    "chunk_enrichment": f"with {_CHUNKS} select chunk_id, array_to_string(terms, ',') terms, array_to_string(entities, ',') entities from feat",
    "claims": f"""with {_CHUNKS}, c as (
 select k doc_id, concept subject, 'mentions' predicate, heading object, 0.55::double confidence from feat where trim(concept) <> '' and (contains(lower(coalesce(heading, '')), lower(concept)) or contains(lower(content), lower(concept)))
 union all select k, heading, 'mentions_entity', unnest(entities), 0.45::double from feat union all select k, heading, 'important_term', unnest(terms), 0.4::double from feat)
 select doc_id, subject, predicate, object, min(confidence) confidence from c where trim(subject) <> '' and trim(object) <> '' group by 1, 2, 3, 4""",
}
