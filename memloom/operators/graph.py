"""Graphs of pages, chunks, entities and uses, and the checks on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.ordered import cut_lineage
from memloom.functions.text import is_noise, tokens
from memloom.operators.orphans import link_concept


def page_nodes(pages: DataFrame) -> DataFrame:
    """rel_path and concept, one row a page."""
    return pages.where(F.col("rel_path").isNotNull()).groupBy("rel_path").agg(F.max("concept").alias("concept"))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between pages, resolved by concept (the last path of equal concepts)."""
    target = page_nodes(pages).groupBy("concept").agg(F.max("rel_path").alias("dst"))
    refs = pages.select(F.col("rel_path").alias("src"), F.explode("links").alias("l")).select("src", link_concept(F.col("l")).alias("concept")).where(F.col("concept").isNotNull()).distinct()
    return refs.join(target, "concept").select("src", "dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-degree of every page, zero included, with the average and whether its density is low."""
    out = edges.groupBy(F.col("src").alias("rel_path")).agg(F.count("*").alias("out_degree"))
    full = nodes.select("rel_path").join(out, "rel_path", "left").withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))
    mean = full.agg((F.sum("out_degree") / F.count("*")).alias("avg_degree"))
    return full.join(F.broadcast(mean)).withColumn("low_density", (F.col("avg_degree") > 0) & (F.col("out_degree") < 0.5 * F.col("avg_degree")))


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that no page links to, if there is more than one page."""
    count = nodes.agg((F.count("*") > 1).alias("_many"))
    return nodes.join(edges.select(F.col("dst").alias("rel_path")).distinct(), "rel_path", "left_anti").join(F.broadcast(count)).where("_many").select("rel_path")


#: Steps after which the frontiers of a walk are written together.
COMPACT = 16


def reachable(roots: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, depth) of all nodes that a walk from ``roots`` (node) reaches; one join a step, of the frontier only.

    Each step writes its own frontier; what has been seen is their union, written
    together only every COMPACT steps.
    """
    frontier = cut_lineage(roots.select("node", F.lit(0).alias("depth")).distinct())
    parts = [frontier]
    for depth in range(1, rounds + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        for part in parts:
            step = step.join(part, "node", "left_anti")
        frontier = cut_lineage(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) >= COMPACT:
            parts = [cut_lineage(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    keep = nodes.select("node")
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components, named by their smallest node.

    Nodes that no edge enters or none leaves are components of their own and are
    trimmed first, again and again: a graph without cycles is gone after that.  The
    rest is coloured: the smallest node that reaches each node is spread forward;
    the nodes of a colour that reach their root backward are its component; they
    leave the graph, and trimming starts again.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left = cut_lineage(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    todo, done = cut_lineage(nodes), []
    while True:
        while True:
            inner = left.select(F.col("src").alias("node")).distinct().join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            alone = cut_lineage(todo.join(inner, "node", "left_anti"))
            if alone.isEmpty():
                break
            done.append(alone.select("node", F.col("node").alias("component")))
            todo = cut_lineage(todo.join(alone, "node", "left_anti"))
            left = cut_lineage(_within(left, todo))
        if todo.isEmpty():
            break
        colour = cut_lineage(todo.withColumn("colour", F.col("node")))
        while True:
            better = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("_c"))
            moved = colour.join(better, "node", "left").select("node", F.least("colour", F.coalesce("_c", "colour")).alias("colour"), (F.col("_c") < F.col("colour")).alias("_m"))
            moved = cut_lineage(moved)
            colour = moved.select("node", "colour")
            if moved.where("_m").isEmpty():
                break
        inside = (
            left.join(colour.withColumnsRenamed({"node": "src", "colour": "_a"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "_b"}), "dst").where("_a = _b")
        )
        back = cut_lineage(inside.select(F.struct("_a", F.col("dst").alias("n")).alias("src"), F.struct("_a", F.col("src").alias("n")).alias("dst")))
        roots = colour.where("node = colour").select(F.struct(F.col("colour").alias("_a"), F.col("node").alias("n")).alias("node"))
        own = cut_lineage(reachable(roots, back).select(F.col("node.n").alias("node"), F.col("node._a").alias("component")))
        done.append(own)
        todo = cut_lineage(todo.join(own, "node", "left_anti"))
        left = cut_lineage(_within(left, todo))
        if len(done) >= COMPACT:
            done = [cut_lineage(reduce(DataFrame.unionByName, done))]
    return reduce(DataFrame.unionByName, done) if done else nodes.select("node", F.col("node").alias("component")).limit(0)


def word_runs(words: Column, lengths: Column) -> Column:
    """The runs of ``words`` (array) of each of ``lengths`` (array of ints), each once."""
    upto = lambda n: F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.transform(upto(n), lambda i: F.array_join(F.slice(words, i, n), " ")))))


def missing_cross_references(pages: DataFrame) -> DataFrame:
    """(rel_path, target, concept): pages that a page's text names, outside code, without a link to them.

    A page is named by its concept or by the concept without its number, unless
    that is ambiguous.

    The text's runs of as many words as concepts have (each length that occurs) are
    joined with the concepts by equality, which shuffles by word run instead of
    trying every pattern on every text.
    """
    nodes = page_nodes(pages)
    full = F.lower("concept")
    every = F.array_distinct(F.array(full, F.trim(F.regexp_replace(full, r"\s+\d+$", ""))))
    forms = (
        nodes.where(~is_noise(full))
        .select(F.explode(every).alias("form"), F.col("rel_path").alias("target"))
        .where(~is_noise(F.col("form")))
        .groupBy("form")
        .agg(F.min("target").alias("target"), F.max("target").alias("_other"))
        .where(F.col("target") == F.col("_other"))  # a form of two pages names neither
        .drop("_other")
    )
    plain = F.regexp_replace(F.regexp_replace("content", r"(?s)```.*?(?:```|$)", " "), r"`[^`\n]*`", " ")
    w = F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    texts = pages.where(F.col("content").isNotNull()).select("rel_path", w.alias("w")).distinct()

    lengths = forms.agg(F.array_sort(F.collect_set(F.size(F.split("form", " ")))).alias("_n"))  # one row
    named = texts.join(F.broadcast(lengths)).select("rel_path", F.explode(word_runs(F.col("w"), F.col("_n"))).alias("form"))
    hits = named.join(forms, "form").where(F.col("rel_path") != F.col("target")).select("rel_path", "target", F.col("form").alias("concept")).distinct()
    linked = page_edges(pages).select(F.col("src").alias("rel_path"), F.col("dst").alias("target"))
    return hits.join(linked, ["rel_path", "target"], "left_anti")


def cross_reference_severity(missing: DataFrame, edges: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``missing`` (rel_path, target) with ``severity``: high if the target is linked or links at least as often as the average, or lies in another component."""
    both = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("_degree"))
    mean = nodes.select(F.col("rel_path").alias("node")).join(both, "node", "left").agg(F.avg(F.coalesce("_degree", F.lit(0))).alias("_mean"))  # one row
    component = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    rows = missing.join(both.withColumnRenamed("node", "target"), "target", "left").join(F.broadcast(mean))
    rows = rows.join(component("rel_path"), "rel_path", "left").join(component("target"), "target", "left")
    # A page without links is a component of its own.
    apart = F.coalesce("_rel_path", "rel_path") != F.coalesce("_target", "target")
    high = (F.coalesce("_degree", F.lit(0)) >= F.col("_mean")) | apart
    return rows.select(*missing.columns, F.when(high, "high").otherwise("low").alias("severity"))


def next_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, next_chunk_id) of neighbours in a document."""
    return chunks.withColumn("next_chunk_id", F.lead("chunk_id").over(Window.partitionBy("doc_id").orderBy("ord"))).where("next_chunk_id is not null")


def chunk_links(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Page links as links between the first chunks of the pages."""
    first = chunks.groupBy("doc_id").agg(F.min_by("chunk_id", "ord").alias("first"))
    a, b = first.withColumnsRenamed({"doc_id": "src", "first": "src_chunk"}), first.withColumnsRenamed({"doc_id": "dst", "first": "dst_chunk"})
    return edges.join(a, "src").join(b, "dst").select("src_chunk", "dst_chunk")


def co_occurrences(mentions: DataFrame, unit: str) -> DataFrame:
    """(a, b, weight): pairs of entities in the same ``unit`` (at most a dozen entities each), a before b."""
    sets = mentions.groupBy(unit).agg(F.array_sort(F.collect_set("entity")).alias("e"))
    pairs = F.flatten(F.transform("e", lambda x: F.transform(F.filter("e", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))


def overlapping_chunks(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks of a document that share a line with a range (doc_id, from_line, to_line)."""
    return ranges.join(chunks, "doc_id").where((F.col("start_line") <= F.col("to_line")) & (F.col("from_line") <= F.col("end_line")))


def ontology(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, weight, confidence): chunks belong to documents and mention entities, entities co-occur."""
    belongs = chunks.select(F.col("chunk_id").alias("src"), F.col("doc_id").alias("dst"), F.lit("belongs_to").alias("kind"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"))
    says = mentions.select(F.col("chunk_id").alias("src"), F.col("entity").alias("dst"), F.lit("mentions").alias("kind"), F.lit(1.0).alias("weight"), F.lit(0.8).alias("confidence")).distinct()
    near = co_occurrences(mentions, "chunk_id").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("co_occurs").alias("kind"), F.col("weight").cast("double").alias("weight"), F.lit(0.6).alias("confidence"))
    return belongs.unionByName(says).unionByName(near)


def section_concepts(pages: DataFrame, min_page_share: float = 0.4) -> DataFrame:
    """Headings by how many pages have them, and whether they are frequent."""
    total = pages.agg(F.countDistinct("rel_path").alias("pages"))
    heads = pages.select("rel_path", F.explode("headings").alias("h")).select("rel_path", F.lower(F.trim("h")).alias("section")).where("section <> ''").distinct()
    return heads.groupBy("section").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("section", "n", F.round(F.col("n") / F.col("pages"), 6).alias("share"), (F.col("n") / F.col("pages") >= min_page_share).alias("frequent"))


def usage_counts(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Uses of each node in either direction by kind, zeros included."""
    both = edges.select(F.col("src").alias("node"), "kind").unionAll(edges.select(F.col("dst").alias("node"), "kind"))
    return both.groupBy("node").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])


def symbol_lookup(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols with exactly the name, and those with the same name in lower case without separators; no row twice."""
    plain = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    wanted = F.regexp_replace(F.lower(F.lit(name)), "[^a-z0-9]", "")
    return symbols.where((F.col("name") == name) | (plain == wanted)).dropDuplicates()


def export_dot(edges: DataFrame) -> DataFrame:
    """The edge lines of a DOT file, quotes and backslashes escaped; ``write.text`` makes a file of them."""
    esc = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return edges.select(F.format_string('"%s" -> "%s";', esc(F.col("src").cast("string")), esc(F.col("dst").cast("string"))).alias("value"))


def page_words(pages: DataFrame) -> DataFrame:
    return pages.select("rel_path", F.explode(F.array_distinct(tokens(F.col("content")))).alias("word"))


def export_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON line a node and an edge: kind, and id or src, dst; ``write.text`` makes files of them."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *edges.columns)).alias("value")))


def export_html(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A list item a node with links to its neighbours, escaped; ``write.text`` makes pages of them.  ``nodes``: node; ``edges``: src, dst."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    link = F.concat(F.lit('<a href="#'), esc(F.col("dst")), F.lit('">'), esc(F.col("dst")), F.lit("</a>"))
    lists = edges.groupBy(F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_set(link)), ", ").alias("_links"))
    name = esc(F.col("node"))
    full = nodes.select("node").distinct().join(lists, "node", "left")
    return full.select(F.concat(F.lit('<li id="'), name, F.lit('">'), name, F.lit(": "), F.coalesce("_links", F.lit("")), F.lit("</li>")).alias("value"))
