"""Markdown trees, front matter and JSONL transcripts as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, root: str, max_bytes: int = 2_000_000, max_files: int = 50_000, max_total_bytes: int = 1 << 40) -> DataFrame:
    """(path, length, content) of the .md files under ``root`` within the caps, in path order.

    The total cap is a running sum over the file listing (path and length only);
    contents are read for the kept files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    sizes = files.select("path", "length").where(F.col("length") <= max_bytes).orderBy("path").limit(max_files)
    running = F.sum("length").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.withColumn("_total", running).where(F.col("_total") <= max_total_bytes).select("path")  # at most max_files rows of a listing
    return files.join(kept, "path", "left_semi").select("path", "length", F.decode("content", "UTF-8").alias("content"))


def front_matter(content: Column) -> Column:
    """The ``key: value`` lines between the leading dashes as a map; empty without them."""
    block = F.regexp_extract(content, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda line: F.contains(line, F.lit(":")))
    entry = lambda line: F.struct(F.lower(F.trim(F.substring_index(line, ":", 1))), F.trim(F.substr(line, F.locate(":", line) + 1)))
    return F.map_from_entries(F.transform(_last_of_key(pairs), entry))


def _last_of_key(pairs: Column) -> Column:
    name = lambda line: F.lower(F.trim(F.substring_index(line, ":", 1)))
    return F.filter(pairs, lambda line, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: name(later) == name(line)))


def author(meta: Column) -> Column:
    """author, else agent, else author_agent, else created_by."""
    return F.coalesce(*[F.try_element_at(meta, F.lit(k)) for k in ("author", "agent", "author_agent", "created_by")])


def headings(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"(?m)^#{1,6}[ \t]+(.*?)[ \t]*$"), F.lit(1))


def link_targets(content: Column) -> Column:
    """Targets of wiki links and of inline links."""
    return F.concat(F.regexp_extract_all(content, F.lit(r"\[\[([^\]|]+)"), F.lit(1)), F.regexp_extract_all(content, F.lit(r"\[[^\]]*\]\(([^)\s]+)"), F.lit(1)))


def transcript_tail(spark: SparkSession, path: str, last: int = 6) -> DataFrame:
    """The last messages of a JSONL transcript: role and text of string contents or text blocks."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    message = F.coalesce(F.get_json_object("value", "$.message"), F.col("value"))
    blocks = F.from_json(F.get_json_object(message, "$.content"), "array<struct<type: string, text: string>>")
    plain = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: b["text"]), "\n")
    text = F.coalesce(F.when(F.startswith(F.get_json_object(message, "$.content"), F.lit("[")), plain), F.get_json_object(message, "$.content"))
    rows = lines.select("_at", F.get_json_object(message, "$.role").alias("role"), text.alias("text")).where(F.col("role").isNotNull() & (F.trim("text") != ""))
    return rows.orderBy(F.desc("_at")).limit(last).orderBy("_at").select("role", "text")


def token_usage(payload: Column) -> Column:
    """input, output and total tokens from the usual spellings; the total falls back to the sum."""
    first = lambda *paths: F.coalesce(*[F.get_json_object(payload, p).try_cast("bigint") for p in paths])
    given = first("$.usage.input_tokens", "$.usage.prompt_tokens", "$.usage.inputTokens", "$.input_tokens", "$.prompt_tokens")
    made = first("$.usage.output_tokens", "$.usage.completion_tokens", "$.usage.outputTokens", "$.output_tokens", "$.completion_tokens")
    total = F.coalesce(first("$.usage.total_tokens", "$.usage.totalTokens", "$.total_tokens"), F.coalesce(given, F.lit(0)) + F.coalesce(made, F.lit(0)))
    return F.struct(given.alias("input"), made.alias("output"), total.alias("total"))
