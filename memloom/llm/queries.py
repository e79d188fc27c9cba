"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import conversations, leaks, markup, pii, spam, split, terms, tokens
from memloom.sources.tables import table


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.segment_terms(table(spark, d, "segment_profiles")).unionByName(terms.page_words(table(spark, d, "pages")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that two to eight records of a kind hold. Scores (``p1_scores``) have no say in it, so none are computed."""
    segments = terms.segment_terms(table(spark, d, "segment_profiles")).drop("n")
    return terms.held_terms(segments.unionByName(terms.page_terms(table(spark, d, "pages"))), 2, 8)


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every term of every record."""
    return terms.distinctive_terms(term_counts(spark, d)).withColumn("llr", F.round("llr", 3))


def split_records(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(
        F.lit("page").alias("record_kind"), F.col("rel_path").alias("record_key"), "content", F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line")
    )
    chunks = table(spark, d, "chunk_nodes").select(
        F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_key"), "content", "start_line", "end_line"
    )
    return pages.unionByName(chunks)


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of the oversized pages and chunks."""
    return split.split_oversized(split_records(spark, d), table(spark, d, "split_limits"), oversized_only=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where((F.col("pieces") > 1) & (F.col("piece_no") == 0)).select("record_kind", "record_key").distinct()


def pii_records(spark: SparkSession, d: str) -> DataFrame:
    """record_kind, record_id, text and is_json of every text that may hold personal information."""
    hooks, messages = table(spark, d, "hook_inputs"), table(spark, d, "messages")

    def part(df: DataFrame, kind: str, key: str, text: str, is_json: bool) -> DataFrame:
        return df.where(F.col(text).isNotNull()).select(
            F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), F.col(text).alias("text"), F.lit(is_json).alias("is_json")
        )

    return (
        part(hooks, "hook_prompt", "hook_id", "prompt", False)
        .unionByName(part(hooks, "hook_tool_response", "hook_id", "tool_response", True))
        .unionByName(part(messages, "message", "msg_id", "content", False))
    )


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with placeholders in place of personal information."""
    done = pii.redact(pii_records(spark, d), table(spark, d, "name_lexicon"))
    return done.select("record_kind", "record_id", "redacted", F.size("found").alias("found"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    done = pii.redact(pii_records(spark, d), table(spark, d, "name_lexicon"))
    return done.select("record_kind", "record_id", F.inline("found")).distinct()


def _blocks(kind: str) -> Column:
    return F.size(F.filter("blocks", lambda b: b["kind"] == kind))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = markup.page_markup(table(spark, d, "pages"))
    return found.select("rel_path", "field", F.split("mark", ":")[0].alias("markup")).distinct()


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every page and its number of blocks by kind."""
    done = markup.clean_pages(table(spark, d, "pages"))
    kinds = [_blocks(k).alias(f"{k}_blocks") for k in ("heading", "list", "code", "formula")]
    return done.select("rel_path", "clean", *kinds)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.turns(table(spark, d, "messages")).select("user_id", "session_id", "turn_no", "msg_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids differ from the text (none), beside the number of documents."""
    documents = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tokens.decode_corpus(tokens.encode_corpus(documents)).withColumnRenamed("text", "decoded")
    same = documents.join(back, "doc_id", "left").select((F.col("text") == F.col("decoded")).alias("same"))
    return same.groupBy(F.coalesce("same", F.lit(False)).alias("same")).agg(F.count("*").alias("documents"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items of every document with their longest run."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, d, "documents")).select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_scores": p1_scores, "p2_found": p2_found, "p2_pieces": p2_pieces,
    "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_clean": p5_clean, "p7_found": p7_found, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip,
    "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found,
}

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"

ORACLES = {
    "p1_found": """with s as (select distinct segment_id key, lower(trim(replace(replace(k, '_', ' '), '-', ' '))) term from (select segment_id, unnest(map_keys(terms)) k, unnest(map_values(terms)) w from segment_profiles) where w > 0),
 p as (select distinct rel_path key, term from (select rel_path, unnest(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+')) term from pages) where regexp_full_match(term, '[a-z]{6,}')),
 a as (select 'segment' record_kind, key, term from s where term <> '' union all select 'page', key, term from p)
 select record_kind, key record_key, term from a qualify count(*) over (partition by record_kind, term) between 2 and 8""",
    "p1_scores": """with s0 as (select segment_id key, lower(trim(replace(replace(k, '_', ' '), '-', ' '))) term, w from (select segment_id, unnest(map_keys(terms)) k, unnest(map_values(terms)) w from segment_profiles) where w > 0 and segment_id is not null),
 s as (select 'segment' k, key, term, max(w)::double n from s0 where term <> '' group by 2, 3), pc as (select distinct rel_path key, content from pages where rel_path is not null),
 p as (select 'page' k, key, term, count(*)::double n from (select key, unnest(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+')) term from pc) where regexp_full_match(term, '[a-z]{6,}') group by 2, 3), a as (select * from s union all select * from p),
 w as (select *, sum(n) over (partition by k) tot, sum(n) over (partition by k, key) r, sum(n) over (partition by k, term) t, count(*) over (partition by k, term) records from a),
 c as (select *, n x11, r - n x12, t - n x21, tot - r - (t - n) x22 from w),
 g as (select *, 2 * (case when x11 > 1e-9 then x11 * ln(x11 * tot / (r * t)) else 0 end + case when x12 > 1e-9 then x12 * ln(x12 * tot / (r * (tot - t))) else 0 end + case when x21 > 1e-9 then x21 * ln(x21 * tot / ((tot - r) * t)) else 0 end + case when x22 > 1e-9 then x22 * ln(x22 * tot / ((tot - r) * (tot - t))) else 0 end) g2 from c)
 select k record_kind, key record_key, term, n, records, round(case when tot - r <= 1e-9 then 0 else (case when x11 * (tot - r) >= x21 * r then 1 else -1 end) * greatest(g2, 0) end, 3) llr from g""",
    "p2_found": """select distinct 'page' record_kind, rel_path record_key from pages, split_limits where record_kind = 'page' and length(content) > max_chars
 union all select distinct 'chunk', chunk_id from chunk_nodes, split_limits where record_kind = 'chunk' and length(content) > max_chars""",
    "p9_leaks": f"""with d as (select distinct doc_id, {_WORDS} w from documents), i as (select item_id, {_WORDS} w from eval_items),
 dg as (select doc_id, w dw, k dp, array_to_string(w[k:k + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d)),
 ig as (select item_id, k ip, array_to_string(w[k:k + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) k from i)),
 h as (select distinct doc_id, item_id, dp, ip from dg join ig using (g)), z as (select *, dp - row_number() over (partition by doc_id, item_id, dp - ip order by dp) grp from h),
 r as (select doc_id, item_id, (count(*) + 11)::int n from z group by doc_id, item_id, dp - ip, grp) select doc_id, item_id, max(n) run from r group by 1, 2""",
    "p9_found": f"""with d as (select doc_id, {_WORDS} w from documents), i as (select item_id, {_WORDS} w from eval_items),
 dg as (select doc_id, array_to_string(w[k:k + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d)),
 ig as (select distinct item_id, array_to_string(w[k:k + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) k from i))
 select distinct doc_id, item_id from dg join ig using (g)""",
}
