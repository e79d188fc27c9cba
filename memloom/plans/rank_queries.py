"""Queries of postings, BM25, filters and the hybrid ranker, with their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.functions.ordered import keep
from memloom.operators import features as X
from memloom.operators import index as I
from memloom.operators import questions as Q
from memloom.operators import rank as R
from memloom.sources.tables import table

_STOP = T.ROUTING_STOP_WORDS + T.RANKER_STOP_WORDS
_STOP_SQL = "'" + "','".join(sorted(set(_STOP))) + "'"
_TOK = "list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda x: lower(x)), lambda x: x not in (" + _STOP_SQL + "))"


def words(c: str):  # noqa: ANN201
    return F.filter(T.tokens(F.col(c)), lambda t: ~t.isin(_STOP))


def item_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(words("text"))).alias("token"))


def bm25_scores(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where(F.col("text").isNotNull())
    fields = {"content": words("text")}
    return R.bm25(R.field_tokens(docs, fields), item_tokens(s, d), docs.agg(F.count("*").alias("n")), {"content": 1.0}, lengths=R.field_lengths(docs, fields))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """Ten best documents of every test item."""
    ranked = R.top(bm25_scores(s, d).withColumn("score", F.round("score", 6)), 10)
    return ranked.select("query_id", "doc_id", "rank", "score")


def bm25_grouped(s: SparkSession, d: str) -> DataFrame:
    """The same with at most two documents of a source, taken from all scored documents."""
    groups = table(s, d, "documents").select("doc_id", F.col("source").alias("group_id"))
    scored = bm25_scores(s, d).withColumn("score", F.round("score", 6)).join(groups, "doc_id")
    return R.cap_groups(scored, 10).select("query_id", "doc_id", "group_id", "rank", "score")


def bm25_fields(s: SparkSession, d: str) -> DataFrame:
    """BM25 over two fields of pages, content and headings, for the questions."""
    pages = table(s, d, "pages").groupBy("rel_path").agg(F.max("content").alias("content"), F.max("concept").alias("concept"))
    pages = pages.withColumn("content", F.coalesce("content", F.lit("")))
    toks = R.field_tokens(pages, {"content": words("content"), "headings": words("concept")}, "rel_path")
    q = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), F.explode(words("question")).alias("token")).distinct()
    scores = R.bm25(toks, q, pages.agg(F.count("*").alias("n")), {"content": 1.0, "headings": 1.4})
    return R.top(scores.withColumn("score", F.round("score", 6)), 10).select("query_id", "doc_id", "rank", "score")


def chunk_terms(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunk_nodes").where(F.col("content").isNotNull()).select("chunk_id", F.col("doc_rel_path").alias("doc_id"), "heading", "content").distinct()
    body = chunks.select("doc_id", "chunk_id", F.explode(F.array_distinct(words("content"))).alias("key"), F.lit(0.8).alias("score"))
    head = chunks.select("doc_id", "chunk_id", F.explode(F.array_distinct(words("heading"))).alias("key"), F.lit(0.4).alias("score"))
    return body.unionByName(head)


def postings(s: SparkSession, d: str) -> DataFrame:
    return R.capped_postings(chunk_terms(s, d).select("key", "doc_id", "score"))


def prefix_lookup(s: SparkSession, d: str) -> DataFrame:
    """Words of the questions against the words of the chunks' headings."""
    terms = table(s, d, "smoke_longmemeval").select(F.explode(words("question")).alias("term"))
    keys = table(s, d, "chunk_nodes").select(F.explode(words("heading")).alias("key"))
    return R.prefix_keys(terms, keys)


def map_filter(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "tier0_records").where(R.matches_filters(F.col("metadata"), {"file_ext": "md", "outbound_link_count": "0"}))
    return t.groupBy("author_agent").agg(F.countDistinct("id").alias("records"))


def multi_query_filter(s: SparkSession, d: str) -> DataFrame:
    """Hits of the questions' words in all pages of runbooks, scoped by one semi-join for all queries; no cap of postings."""
    allowed = table(s, d, "pages").where(F.startswith("rel_path", F.lit("runbooks/"))).select(F.col("rel_path").alias("doc_id")).distinct()
    q = table(s, d, "smoke_longmemeval").select(F.col("question_id").alias("query_id"), F.explode(words("question")).alias("key")).distinct()
    every = chunk_terms(s, d).select("key", "doc_id", "score").join(allowed, "doc_id", "left_semi")
    hits = R.best_postings(every).join(q, "key")
    return hits.groupBy("query_id").agg(F.countDistinct("doc_id").alias("docs"), F.round(F.sum("score"), 6).alias("score"))


def corpus(s: SparkSession, d: str, kept: Callable[[DataFrame], DataFrame] = keep) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Normalised corpus of pages with term and entity postings and links; ``kept`` holds it for the reads that make the tables."""
    pages = (
        table(s, d, "pages")
        .where(F.col("content").isNotNull())
        .groupBy(F.col("rel_path").alias("doc_id"))
        .agg(F.max("content").alias("text"), F.max("concept").alias("concept"), F.max("headings").alias("headings"), F.min("scanned_at").alias("at"))
    )
    heads = F.array_join(F.filter("headings", lambda h: h.isNotNull()), " ")
    normal = pages.select(
        "doc_id", "text", "concept", F.split("doc_id", "/")[0].alias("group_id"), F.to_date("at").alias("day"),
        F.split(T.index_forms(F.col("text")), " ").alias("tokens"), T.tokens(F.coalesce(heads, F.lit(""))).alias("heading_tokens"),
        T.index_forms(F.col("concept")).alias("entity"), X.doc_type(F.col("headings"), F.col("text")).alias("kind"), X.temporal_terms(F.col("text")).alias("temporal"),
    )
    terms = X.yake_terms(pages, "doc_id").select("doc_id", "term").groupBy("doc_id").agg(F.collect_set("term").alias("raw"))
    stems = normal.join(terms, "doc_id", "left").withColumn("terms", F.split(T.index_forms(F.array_join(F.coalesce("raw", F.array().cast("array<string>")), " ")), " "))
    # The overlap reads headings, topic, kind and times as index forms, like the page itself.
    more = F.split(T.index_forms(F.concat_ws(" ", F.array_join("heading_tokens", " "), "concept", "kind", F.array_join("temporal", " "))), " ")
    # Every word is held once: the texts of the overlap are put together when they are read.
    held = kept(stems.select(
        "doc_id", "group_id", "day", "tokens", "heading_tokens", "terms", F.array("entity").alias("entities"), "temporal", T.tokens(F.col("concept")).alias("topic_tokens"),
        T.tokens(F.coalesce("kind", F.lit(""))).alias("type_tokens"), more.alias("_more"),
    ))
    full = held.withColumn("rerank", F.array_remove(F.concat("_more", "terms", "tokens"), "")).drop("_more")
    post = full.select("doc_id", F.explode("terms").alias("key"), F.lit(0.8).alias("score")).unionByName(full.select("doc_id", F.explode("heading_tokens").alias("key"), F.lit(0.4).alias("score")))
    ents = full.select("doc_id", F.explode("entities").alias("key"), F.lit(0.9).alias("score"))
    from memloom.operators.orphans import link_concept

    by_concept = pages.select(F.col("concept"), F.col("doc_id").alias("dst"))
    links = (
        table(s, d, "pages").select(F.col("rel_path").alias("src"), F.explode("links").alias("l")).select("src", link_concept(F.col("l")).alias("concept")).where("concept is not null").distinct().join(by_concept, "concept").select("src", "dst").distinct()
    )
    return full, R.best_postings(post), R.best_postings(ents), links


def questions(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "smoke_longmemeval").groupBy(F.col("question_id").alias("query_id"), "question").agg(F.to_date(F.min("ingested_at")).alias("today"))
    q = q.withColumn("norm", T.index_forms(F.col("question"))).withColumn("target", Q.analyse(F.col("question"), F.col("today"))["target"])
    return q.select("query_id", "norm", T.query_terms(F.col("norm")).alias("terms"), X.aggregate_intent(F.col("question")).alias("intent"), "target")


def index(s: SparkSession, d: str) -> I.Index:
    """The index of the pages, read if it was built from the same files, else built and written to the shared folder."""
    root = s.conf.get("spark.memloom.index.dir", None) or s.conf.get("spark.checkpoint.dir", None) or (tempfile.gettempdir() if s.sparkContext.master.startswith("local") else None)
    if root is None:
        raise ValueError("set spark.memloom.index.dir or spark.checkpoint.dir to a folder that all executors share")
    print_of = I.file_fingerprint(table(s, d, "pages"))
    folder = f"{root.rstrip('/')}/memloom-index-{print_of[:24]}"
    known = I.read(s, folder, print_of)
    if known is None:

        def written(df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{folder}/corpus")
            return s.read.parquet(f"{folder}/corpus")

        I.write(I.of_corpus(*corpus(s, d, written)), folder, print_of)
        known = I.read(s, folder, print_of)
    return known


def index_build(s: SparkSession, d: str) -> DataFrame:
    """Rows of each table of the index."""
    built = index(s, d)
    parts = [getattr(built, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in I.TABLES]
    return reduce(DataFrame.unionByName, parts)


def hybrid(s: SparkSession, d: str) -> DataFrame:
    best = R.hybrid(questions(s, d), index(s, d))
    return best.withColumns({c: F.round(c, 6) for c, k in best.dtypes if k == "double"})


def llm_context(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunk_nodes").where(F.col("content").isNotNull()).select("chunk_id", F.col("doc_rel_path").alias("doc_id"), "heading", "content").dropDuplicates(["chunk_id"])
    q = questions(s, d)
    return R.chunk_context(chunks, R.hybrid(q, index(s, d)), q)


QUERIES = {
    "bm25_topk": bm25_topk, "bm25_grouped_cap": bm25_grouped, "bm25_fields": bm25_fields, "postings_cap": postings, "prefix_lookup_min": prefix_lookup,
    "map_filter_and": map_filter, "multi_query_semi": multi_query_filter, "index_build": index_build, "hybrid_rank": hybrid, "llm_context": llm_context,
}

_BM25 = f"""
doc as (select doc_id, {_TOK.format('text')} w from documents where text is not null), n as (select count(*) n from doc), a as (select avg(len(w)) al from doc where len(w) > 0),
tf as (select doc_id, len(w) ln, unnest(w) token from doc), t as (select doc_id, ln, token, count(*) tf from tf group by all), df as (select token, count(*) df from t group by 1),
q as (select distinct item_id query_id, unnest({_TOK.format('text')}) token from eval_items),
sc as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * ln / al))), 6) score from q join t using (token) join df using (token), n, a group by 1, 2)
"""
_POST = f"""
c as (select distinct chunk_id, doc_rel_path doc_id, heading, content from chunk_nodes where content is not null),
p as (select doc_id, unnest({_TOK.format('content')}) "key", 0.8::double score from c union all select doc_id, unnest({_TOK.format('heading')}), 0.4::double from c),
best as (select "key", doc_id, max(score) score from p group by 1, 2),
post as (select * from best qualify row_number() over (partition by "key" order by score desc, doc_id) <= 500)
"""

ORACLES = {
    "bm25_topk": f"with {_BM25} select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id)::int rank, score from sc qualify rank <= 10",
    "bm25_grouped_cap": f"""with {_BM25}, g as (select sc.*, coalesce(source, 'doc:' || doc_id) g, source from sc join documents using (doc_id)),
 i as (select *, row_number() over (partition by query_id, g order by score desc, doc_id) k, max(score) over (partition by query_id, g) gs from g)
 select query_id, doc_id, source group_id, row_number() over (partition by query_id order by gs desc, g, k)::int rank, score from i where k <= 2 qualify rank <= 10""",
    "bm25_fields": f"""with p as (select rel_path, coalesce(max(content), '') content, max(concept) concept from pages group by 1), n as (select count(*) n from p),
 f as (select rel_path doc_id, 'content' fld, 1.0::double w, {_TOK.format('content')} x from p union all select rel_path, 'headings', 1.4::double, {_TOK.format('concept')} from p),
 t as (select doc_id, fld, w, ln, token, count(*) tf from (select doc_id, fld, w, len(x) ln, unnest(x) token from f) group by all), a as (select fld, avg(len(x)) al from f where len(x) > 0 group by 1), df as (select fld, token, count(*) df from t group by 1, 2),
 q as (select distinct question_id query_id, unnest({_TOK.format('question')}) token from smoke_longmemeval),
 sc as (select query_id, doc_id, round(sum(w * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * ln / al))), 6) score from q join t using (token) join df using (fld, token) join a using (fld), n group by 1, 2)
 select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id)::int rank, score from sc qualify rank <= 10""",
    "postings_cap": f'with {_POST} select "key", doc_id, score from post',
    "prefix_lookup_min": f"""with t as (select distinct unnest({_TOK.format('question')}) term from smoke_longmemeval), k as (select distinct unnest({_TOK.format('heading')}) "key" from chunk_nodes)
 select term, "key", true exact from t join k on term = "key" union all select term, min("key"), false from t join k on starts_with("key", term) where strlen(term) >= 4 and term not in (select "key" from k) group by 1""",
    "map_filter_and": "select author_agent, count(distinct id) records from tier0_records where metadata['file_ext'] = 'md' and metadata['outbound_link_count'] = '0' group by 1",
    "multi_query_semi": f"""with {_POST}, q as (select distinct question_id query_id, unnest({_TOK.format('question')}) "key" from smoke_longmemeval)
 select query_id, count(distinct doc_id) docs, round(sum(score), 6) score from best join q using ("key") where starts_with(doc_id, 'runbooks/') and doc_id in (select rel_path from pages) group by 1""",
}
