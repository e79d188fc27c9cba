"""Queries of facts, versions and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import NOISE_CONCEPTS
from memloom.functions.times import with_utc_micros
from memloom.operators import facts as A
from memloom.operators import graph as G
from memloom.sources.tables import table


def event_claims(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("subject"), F.lit("last_event").alias("predicate"), F.col("event_type").alias("object"), F.to_date("ts").alias("day"), F.col("event_id").alias("doc_id"))


def facts(s: SparkSession, d: str) -> DataFrame:
    return A.versioned(event_claims(s, d))


def facts_as_of(s: SparkSession, d: str) -> DataFrame:
    days = s.createDataFrame([("2024-01-10",), ("2024-01-20",)], "day string").select(F.to_date("day").alias("day"))
    return A.as_of(facts(s, d), days).select("as_of", "subject", "object", "version")


def timeline(s: SparkSession, d: str) -> DataFrame:
    return A.between(facts(s, d), "2024-01-12", "2024-01-05").groupBy("valid_from", "object").agg(F.count("*").alias("facts"))


def timeline_window(s: SparkSession, d: str) -> DataFrame:
    return A.window_around(facts(s, d), "2024-01-15", 5, 5).select("valid_from", "subject", "object", "doc_id")


def adjacent(s: SparkSession, d: str) -> DataFrame:
    pairs = A.adjacent_pairs(facts(s, d), "2024-01-01", "2024-01-31", 3)
    return pairs.select("valid_from", "subject", "doc_id", "next_valid_from", "next_subject", "gap_days")


def chunk_history(s: SparkSession, d: str) -> DataFrame:
    """Chunks with their lineage; the arrival of a chunk is its page's scan."""
    pages = table(s, d, "pages").groupBy(F.col("rel_path").alias("doc_id")).agg(F.min("scanned_at").alias("at"))
    c = table(s, d, "chunk_nodes").select("chunk_id", F.col("doc_rel_path").alias("doc_id"), F.concat_ws("::", F.lower(F.coalesce("heading", F.lit("")))).alias("lineage")).distinct()
    return c.join(pages, "doc_id")


def chunk_versions(s: SparkSession, d: str) -> DataFrame:
    return A.chunk_versions(chunk_history(s, d)).select("doc_id", "lineage", "chunk_id", "version", "supersedes", "is_latest")


def lifecycle(s: SparkSession, d: str) -> DataFrame:
    return A.lifecycle(A.chunk_versions(chunk_history(s, d))).select("doc_id", "version", F.array_join("latest_chunks", ",").alias("latest_chunks"))


def pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages")


def page_links(s: SparkSession, d: str) -> DataFrame:
    return G.page_edges(pages(s, d))


def link_degrees(s: SparkSession, d: str) -> DataFrame:
    return G.degrees(G.page_nodes(pages(s, d)), page_links(s, d)).select("rel_path", "out_degree", F.round("avg_degree", 6).alias("avg_degree"), "low_density")


def orphan_pages(s: SparkSession, d: str) -> DataFrame:
    return G.unreferenced(G.page_nodes(pages(s, d)), page_links(s, d))


def roots(s: SparkSession, d: str) -> DataFrame:
    return G.page_nodes(pages(s, d)).where(F.lower("rel_path").rlike("-index-[0-9]+[.]md$")).select(F.col("rel_path").alias("node"))


def reachability(s: SparkSession, d: str) -> DataFrame:
    return G.reachable(roots(s, d), page_links(s, d)).select("node")


def unreachable(s: SparkSession, d: str) -> DataFrame:
    return G.page_nodes(pages(s, d)).select(F.col("rel_path").alias("node")).join(reachability(s, d), "node", "left_anti")


def strong_components(s: SparkSession, d: str) -> DataFrame:
    return G.components(page_links(s, d))


def cross_references(s: SparkSession, d: str) -> DataFrame:
    return G.missing_cross_references(pages(s, d))


def chunks(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunk_nodes").where(F.col("chunk_id").isNotNull())
    one = c.groupBy("chunk_id").agg(F.max("doc_rel_path").alias("doc_id"), F.max("heading").alias("heading"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("content").alias("content"))
    return one.withColumn("ord", F.split_part("chunk_id", F.lit("::"), F.lit(-1)).try_cast("int"))


def next_chunks(s: SparkSession, d: str) -> DataFrame:
    return G.next_chunks(chunks(s, d)).select("chunk_id", "next_chunk_id")


def chunk_links(s: SparkSession, d: str) -> DataFrame:
    return G.chunk_links(page_links(s, d), chunks(s, d)).distinct()


def chunk_graph_stats(s: SparkSession, d: str) -> DataFrame:
    c = chunks(s, d)
    nodes = c.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))
    return nodes.join(next_chunks(s, d).agg(F.count("*").alias("next_edges"))).join(chunk_links(s, d).agg(F.count("*").alias("link_edges"))).withColumn("chunks_per_doc", F.round(F.col("chunks") / F.col("docs"), 6))


def mentions(s: SparkSession, d: str) -> DataFrame:
    """Entities of a chunk: the known concepts (of documents) among its runs of as many words as concepts have."""
    known = table(s, d, "documents").where(F.col("concept").isNotNull()).select(F.lower("concept").alias("entity")).distinct()
    lengths = known.agg(F.array_sort(F.collect_set(F.size(F.split("entity", " ")))).alias("_n"))  # one row
    w = F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words = chunks(s, d).where("content is not null").select("chunk_id", "doc_id", w.alias("w")).join(F.broadcast(lengths))
    return words.select("chunk_id", "doc_id", F.explode(G.word_runs(F.col("w"), F.col("_n"))).alias("entity")).join(known, "entity")


def co_occurrence(s: SparkSession, d: str) -> DataFrame:
    return G.co_occurrences(mentions(s, d), "chunk_id")


def interval_overlap(s: SparkSession, d: str) -> DataFrame:
    spans = table(s, d, "pages").select(F.col("rel_path").alias("doc_id"), F.lit(5).alias("from_line"), F.lit(12).alias("to_line")).distinct()
    return G.overlapping_chunks(chunks(s, d), spans).select("doc_id", "chunk_id", "start_line", "end_line")


def ontology_edges(s: SparkSession, d: str) -> DataFrame:
    return G.ontology(chunks(s, d), mentions(s, d)).groupBy("kind", "confidence").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


def section_concepts(s: SparkSession, d: str) -> DataFrame:
    return G.section_concepts(pages(s, d))


def usage(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    order = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    uses = li.select(order.alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("uses").alias("kind"))
    refs = li.select(order.alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("references").alias("kind"))
    return G.usage_counts(uses.unionByName(refs), ["uses", "references", "calls"])


def symbols(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("kind"))
    return G.symbol_lookup(parts, "brand#23")


def dot_export(s: SparkSession, d: str) -> DataFrame:
    return G.export_dot(page_links(s, d))


def resolved_days(s: SparkSession, d: str) -> DataFrame:
    """Messages by the UTC day of their raw time."""
    m = with_utc_micros(table(s, d, "messages").select("msg_id", "timestamp", "tz"), "timestamp", "tz", "us").where("us is not null")
    return m.select("msg_id", F.date_from_unix_date((F.floor(F.col("us") / 86_400_000_000)).cast("int")).alias("day")).groupBy("day").agg(F.countDistinct("msg_id").alias("messages"))


QUERIES = {
    "facts_scd2": facts, "facts_as_of": facts_as_of, "timeline_between": timeline, "timeline_window": timeline_window, "adjacent_pairs": adjacent,
    "chunk_versions": chunk_versions, "lifecycle_rollup": lifecycle, "page_links": page_links, "degree_density": link_degrees, "orphan_pages": orphan_pages,
    "reachability": reachability, "unreachable_pages": unreachable, "strong_components": strong_components, "missing_cross_refs": cross_references,
    "next_chunks": next_chunks, "chunk_links": chunk_links, "chunk_graph_stats": chunk_graph_stats, "entity_cooccurrence": co_occurrence,
    "interval_overlap_chunks": interval_overlap, "ontology_edges": ontology_edges, "section_concepts": section_concepts, "usage_counts_zero_filled": usage,
    "symbol_lookup": symbols, "graph_dot": dot_export, "message_days": resolved_days,
}

_NOISE = "'" + "','".join(NOISE_CONCEPTS) + "'"
_FACTS = """
c as (select user_id::varchar subject, event_type object, ts::date "day", event_id from events),
r as (select *, coalesce((lag(object) over w <> object)::int, 0) ch from c window w as (partition by subject order by "day", event_id)),
i as (select *, sum(ch) over (partition by subject order by "day", event_id rows unbounded preceding) run from r),
o as (select subject, run, any_value(object) object, arg_max(event_id, ("day", event_id)) doc_id, max("day") valid_from, min("day") st from i group by 1, 2),
facts as (select subject, 'last_event' predicate, (run + 1)::int "version", object, valid_from, lead(st) over w valid_to, lead(run) over w is null is_latest, doc_id from o window w as (partition by subject order by run))
"""
_CONCEPT = "lower(trim(replace(replace(regexp_replace(regexp_replace(trim(regexp_replace(trim(l), '#.*$', '')), '^.*/', ''), '(?i)\\.md$', ''), '_', ' '), '-', ' ')))"
_EDGES = f"""
node as (select rel_path, max(concept) concept from pages group by 1), tgt as (select concept, max(rel_path) dst from node group by 1),
refs as (select rel_path src, l from (select rel_path, unnest(links) l from pages) where l is not null and trim(l) <> '' and not regexp_matches(lower(trim(l)), '^(https?://|mailto:|tel:|#)')),
edge as (select distinct src, dst from (select src, {_CONCEPT} concept from refs) join tgt using (concept))
"""
_CH = """ch as (select chunk_id, max(doc_rel_path) doc_id, max(heading) heading, min(start_line) start_line, max(end_line) end_line, max(content) content, try_cast(string_split(chunk_id, '::')[-1] as int) ord from chunk_nodes where chunk_id is not null group by chunk_id)"""
_MENT = f"""{_CH}, w as (select chunk_id, doc_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') w from ch where content is not null),
known as (select distinct lower(concept) entity from documents where concept is not null), lens as (select distinct len(string_split(entity, ' ')) n from known),
run as (select distinct chunk_id, doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) entity from w, lens),
ment as (select run.* from run join known using (entity)),
pair as (select x.entity a, y.entity b, count(*) weight from ment x join ment y on x.chunk_id = y.chunk_id and x.entity < y.entity group by 1, 2)"""
_REACH = f"""{_EDGES}, reach as (select rel_path node from node where regexp_matches(lower(rel_path), '-index-[0-9]+[.]md$') union select dst from reach join edge on src = node)"""

ORACLES = {
    "facts_scd2": f"with {_FACTS} select * from facts",
    "facts_as_of": f"""with {_FACTS}, d as (select unnest([date '2024-01-10', date '2024-01-20']) as_of) select as_of, subject, object, "version" from facts, d where valid_from <= as_of and (valid_to is null or as_of < valid_to)""",
    "timeline_between": f"with {_FACTS} select valid_from, object, count(*) facts from facts where valid_from between date '2024-01-05' and date '2024-01-12' group by 1, 2",
    "timeline_window": f"""with {_FACTS}, z as (select *, row_number() over (order by valid_from, subject, predicate, doc_id) rn from facts), a as (select rn from z order by abs(valid_from - date '2024-01-15'), rn limit 1)
 select valid_from, subject, object, doc_id from z, a where z.rn between a.rn - 5 and a.rn + 5""",
    "adjacent_pairs": f"""with {_FACTS}, p as (select valid_from, subject, doc_id, lead(valid_from) over w next_valid_from, lead(subject) over w next_subject from facts where valid_from between date '2024-01-01' and date '2024-01-31' window w as (order by valid_from, subject, predicate, doc_id))
 select *, (next_valid_from - valid_from)::int gap_days from p where next_valid_from - valid_from <= 3""",
    "chunk_versions": """with p as (select rel_path doc_id, min(scanned_at) t from pages group by 1), c as (select distinct chunk_id, doc_rel_path doc_id, lower(coalesce(heading, '')) lineage from chunk_nodes)
 select doc_id, lineage, chunk_id, row_number() over w::int "version", lag(chunk_id) over w supersedes, row_number() over (partition by doc_id, lineage order by t desc, chunk_id desc) = 1 is_latest from c join p using (doc_id) window w as (partition by doc_id, lineage order by t, chunk_id)""",
    "lifecycle_rollup": """with p as (select distinct rel_path doc_id from pages), c as (select distinct chunk_id, doc_rel_path doc_id, lower(coalesce(heading, '')) lineage from chunk_nodes),
 v as (select *, row_number() over (partition by doc_id, lineage order by chunk_id) v, row_number() over (partition by doc_id, lineage order by chunk_id desc) = 1 l from c join p using (doc_id))
 select doc_id, max(v)::int "version", string_agg(chunk_id, ',' order by chunk_id) filter (l) latest_chunks from v group by 1""",
    "page_links": f"with {_EDGES} select * from edge",
    "degree_density": f"""with {_EDGES}, g as (select rel_path, count(dst) out_degree from node left join edge on src = rel_path group by 1), m as (select avg(out_degree) a from g)
 select rel_path, out_degree, round(a, 6) avg_degree, a > 0 and out_degree < 0.5 * a low_density from g, m""",
    "orphan_pages": f"with {_EDGES} select rel_path from node where rel_path not in (select dst from edge) and (select count(*) from node) > 1",
    "reachability": f"with recursive {_REACH} select node from reach",
    "unreachable_pages": f"with recursive {_REACH} select rel_path node from node where rel_path not in (select node from reach)",
    "missing_cross_refs": f"""with {_EDGES}, w as (select distinct rel_path, regexp_extract_all(lower(regexp_replace(regexp_replace(content, '(?s)```.*?(?:```|$)', ' ', 'g'), '`[^`\\n]*`', ' ', 'g')), '[\\p{{L}}\\p{{N}}_-]+') w from pages where content is not null),
 fm as (select distinct unnest([lower(concept), trim(regexp_replace(lower(concept), '\\s+\\d+$', ''))]) form, rel_path from node),
 ok as (select form, min(rel_path) target from fm where strlen(form) >= 3 and not regexp_full_match(form, '[0-9]+') and form not in ({_NOISE}) group by 1 having count(distinct rel_path) = 1),
 run as (select distinct rel_path, array_to_string(w[i:i + n - 1], ' ') form from (select rel_path, w, n, unnest(range(1, len(w) - n + 2)) i from w, (select distinct len(string_split(form, ' ')) n from ok) v))
 select run.rel_path, target, form concept from run join ok using (form) where run.rel_path <> target and (run.rel_path, target) not in (select src, dst from edge)""",
    "next_chunks": f"with {_CH} select * from (select chunk_id, lead(chunk_id) over (partition by doc_id order by ord) next_chunk_id from ch) where next_chunk_id is not null",
    "chunk_links": f"with {_EDGES}, {_CH}, f as (select doc_id, arg_min(chunk_id, ord) c from ch group by 1) select distinct a.c src_chunk, b.c dst_chunk from edge join f a on a.doc_id = src join f b on b.doc_id = dst",
    "chunk_graph_stats": f"""with {_EDGES}, {_CH}, f as (select doc_id, arg_min(chunk_id, ord) c from ch group by 1), l as (select distinct a.c x, b.c y from edge join f a on a.doc_id = src join f b on b.doc_id = dst)
 select count(*) chunks, count(distinct doc_id) docs, count(*) - count(distinct doc_id) next_edges, (select count(*) from l) link_edges, round(count(*) / count(distinct doc_id), 6) chunks_per_doc from ch""",
    "entity_cooccurrence": f"with {_MENT} select * from pair",
    "interval_overlap_chunks": f"with {_CH} select doc_id, chunk_id, start_line, end_line from ch where doc_id in (select rel_path from pages) and start_line <= 12 and 5 <= end_line",
    "ontology_edges": f"""with {_MENT} select 'belongs_to' kind, 1.0::double confidence, count(*) edges, count(*)::double weight from ch union all select 'mentions', 0.8::double, count(*), count(*)::double from (select distinct chunk_id, entity from ment)
 union all select 'co_occurs', 0.6::double, count(*), sum(weight)::double from pair""",
    "section_concepts": """with t as (select count(distinct rel_path) n from pages), h as (select distinct rel_path, lower(trim(x)) section from (select rel_path, unnest(headings) x from pages) where trim(x) <> '')
 select section, count(*) n, round(count(*) / any_value(t.n), 6) share, count(*) / any_value(t.n) >= 0.4 frequent from h, t group by 1""",
    "usage_counts_zero_filled": """with e as (select 'o' || l_orderkey src, 'p' || l_partkey dst, 'uses' kind from lineitem union all select 'o' || l_orderkey, 's' || l_suppkey, 'references' from lineitem), b as (select src node, kind from e union all select dst, kind from e)
 select node, count(*) filter (kind = 'uses') uses, count(*) filter (kind = 'references') "references", count(*) filter (kind = 'calls') calls from b group by 1""",
    "symbol_lookup": "select distinct p_partkey symbol_id, p_brand \"name\", p_type kind from part where p_brand = 'brand#23' or regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') = 'brand23'",
    "graph_dot": f"""with {_EDGES} select '"' || replace(src, '"', '\\"') || '" -> "' || replace(dst, '"', '\\"') || '";' "value" from edge""",
}
