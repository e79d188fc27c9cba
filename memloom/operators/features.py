"""Features of documents: ranked terms, chunks, claims, types and topics."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.functions.ordered import keep
from memloom.functions.sizing import BROADCAST_ROWS, within

TOP_TERMS = 12
_TOKEN = re.compile(T.TOKEN)
_WEIGHTS = {n: math.log(n) / math.log(2) for n in (2, 3, 4)}


def _ranked(scores: DataFrame, key: str, keep: int = TOP_TERMS) -> DataFrame:
    """The best terms of each document; ties by term."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "term")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def yake_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Frequency x early position x spread over sentences. Null and wordless texts give no rows."""
    base = docs.where(F.col(text).isNotNull()).select(key, T.tokens(F.col(text)).alias("w"), F.split(text, "[.!?]").alias("s"), T.sentence_total(F.col(text)).alias("sentences"))
    words = base.select(key, "sentences", F.size("w").alias("total"), F.posexplode("w").alias("pos", "term")).where(~F.col("term").isin(T.RANKER_STOP_WORDS))
    freq = words.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.first("total").alias("total"), F.first("sentences").alias("sentences"))
    hits = base.select(key, F.explode("s").alias("sentence")).select(key, F.explode(F.array_distinct(T.tokens(F.col("sentence")))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("hits"))
    score = (F.col("n") / F.col("total")) * (2 - F.col("first") / F.col("total")) * (1 + F.coalesce("hits", F.lit(1)) / F.col("sentences")) * 100
    return _ranked(freq.join(hits, [key, "term"], "left").select(key, "term", score.alias("score")), key)


def rake_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Phrases between stop words (up to five words, four bytes) by the sum of degree/frequency of their words."""
    stop = F.col("t").isin(T.RANKER_STOP_WORDS)
    words = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(T.tokens(F.col(text), T.SHORT_TOKEN)).alias("pos", "t"))
    island = F.sum(stop.cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    kept = words.withColumn("phrase", island).where(~stop)
    sized = kept.withColumn("len", F.count("*").over(Window.partitionBy(key, "phrase"))).where(F.col("len") <= 5)
    word = sized.groupBy(key, "t").agg(((F.sum(F.col("len") - 1) + F.count("*")) / F.count("*")).alias("ws"))
    phrases = (
        sized.join(word, [key, "t"])
        .groupBy(key, "phrase")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias("term"), F.sum("ws").alias("ps"))
        .where(F.octet_length("term") >= 4)
    )
    return _ranked(phrases.groupBy(key, "term").agg(F.sum("ps").alias("score")), key)


def _cvalue_of_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``cvalue_terms`` of documents of any number of rows, whose n-grams are shuffled.

    Containment is of characters, so a phrase may begin inside a word of the longer
    one.  Both share the three letters on either side of the phrase's first space:
    that is the join's key, so no pairs beyond a document's own are formed.
    """
    w = F.col("w")
    base = docs.where(F.col(text).isNotNull()).select(key, T.tokens(F.col(text)).alias("w"))
    none = F.array().cast("array<string>")
    grams = F.concat(*[F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), _gram(w, n))).otherwise(none) for n in (2, 3, 4)])
    freq = base.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    left = freq.withColumn("p", F.split("term", " ")).withColumn("k1", F.right(F.col("p")[0], F.lit(3))).withColumn("k2", F.left(F.col("p")[1], F.lit(3)))
    right = (
        freq.withColumn("p", F.split("term", " "))
        .select(key, F.col("term").alias("longer"), F.col("n").alias("ln"), "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("i"))
        .select(key, "longer", "ln", F.right(F.get("p", F.col("i")), F.lit(3)).alias("k1"), F.left(F.get("p", F.col("i") + 1), F.lit(3)).alias("k2"))
        .distinct()
    )
    nested = (
        left.join(right, [key, "k1", "k2"])
        .where((F.octet_length("longer") > F.octet_length("term")) & F.contains(F.col("longer"), F.col("term")))
        .select(key, "term", "longer", "ln")
        .distinct()
        .groupBy(key, "term")
        .agg(F.avg("ln").alias("mean"))
    )
    score = F.log2(F.size(F.split("term", " ")).cast("double")) * F.greatest(F.col("n") - F.coalesce("mean", F.lit(0.0)), F.lit(0.0))
    return _ranked(freq.join(nested, [key, "term"], "left").select(key, "term", score.alias("score")).where(F.col("score") > 0), key)


def _cvalue_of_text(text: str) -> list[dict]:
    """``cvalue_terms`` of one text.

    A phrase that occurs once and is part of a longer one scores nothing, so those
    that count are the repeated ones and the longest; only their places are looked at.
    """
    w = " ".join(_TOKEN.findall(text)).lower().split()
    grams = {1: w}
    for m in (2, 3, 4):
        grams[m] = [f"{a} {b}" for a, b in zip(grams[m - 1], w[m - 1 :], strict=False)]
    freq = Counter(grams[2] + grams[3] + grams[4])
    words = set(w)
    # A phrase may begin with the end of a word and end with the beginning of one; tokens have three letters at least.
    ending, beginning = defaultdict(list), defaultdict(list)
    for x in words:
        for k in range(3, len(x)):
            if x[-k:] in words:
                ending[x[-k:]].append(x)
            if x[:k] in words:
                beginning[x[:k]].append(x)

    def spellings(gram: str) -> list[str]:
        first, *middle, last = gram.split(" ")
        if first not in ending and last not in beginning:
            return [gram]
        return [x for f in (first, *ending.get(first, ())) for z in (last, *beginning.get(last, ())) if (x := " ".join((f, *middle, z))) in freq]

    longest = min(len(w), 4)
    scores, repeated = [], []
    for x, n in freq.items():
        if n > 1:
            repeated.append((x, n, spellings(x)))
        elif x.count(" ") == longest - 1 and len(spellings(x)) == 1:
            scores.append((-_WEIGHTS[longest], x))
    at: dict[str, list[int]] = {v: [] for _, _, every in repeated for v in every}
    for m in (2, 3, 4) if at else ():
        for i, x in enumerate(grams[m]):
            if x in at:
                at[x].append(i)
    for x, n, every in repeated:
        size = x.count(" ") + 1
        longer = {grams[m][j] for v in every for i in at[v] for m in range(size, longest + 1) for j in range(max(i + size - m, 0), min(i, len(w) - m) + 1)} - {x}
        rest = n - (sum(freq[y] for y in longer) / len(longer) if longer else 0.0)
        if rest > 0:
            scores.append((-_WEIGHTS[size] * rest, x))
    return [{"term": x, "score": -s, "rank": k + 1} for k, (s, x) in enumerate(sorted(scores)[:TOP_TERMS])]


def cvalue_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """2- to 4-grams by log2(words) x (frequency - mean frequency of the longer n-grams that contain them).

    A document of one row is counted where it is read: of those only the keys are
    shuffled, to find the documents of several rows, whose n-grams meet in
    ``_cvalue_of_rows``.
    """
    held = docs.where(F.col(text).isNotNull()).select(key, text)
    several = keep(held.groupBy(key).agg(F.count("*").alias("_n")).where(F.col(key).isNull() | (F.col("_n") > 1)).select(F.col(key).alias("_k")))
    sent = F.broadcast if within(several, BROADCAST_ROWS) else (lambda df: df)

    @F.pandas_udf("array<struct<term: string, score: double, rank: int>>")
    def ranked(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in it:
            yield part.map(_cvalue_of_text)

    alone = held.where(F.col(key).isNotNull()).join(sent(several), F.col(key) == F.col("_k"), "left_anti")
    rows = alone.select(key, F.inline(ranked(text)))
    if several.isEmpty():
        return rows
    together = held.join(sent(several), F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    return rows.unionByName(_cvalue_of_rows(together, key, text).select(*rows.columns))


def _gram(w: Column, n: int):  # noqa: ANN202
    return lambda i: F.array_join(F.slice(w, i, n), " ")


def textrank_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 20) -> DataFrame:
    """Words by TextRank over co-occurrence in windows of three; one document is one text, so each is ranked alone."""

    def rank(words: list[str]) -> list[dict]:
        own = [w for w in words if w not in stop]
        near: dict[str, set[str]] = {}
        for k in range(len(own) - 2):
            for a in own[k : k + 3]:
                near.setdefault(a, set())
            for i in range(3):
                for j in range(3):
                    if i != j:
                        near[own[k + i]].add(own[k + j])
        score = dict.fromkeys(near, 1.0)
        for _ in range(rounds):
            score = {w: 0.15 + 0.85 * sum(score[x] / len(near[x]) for x in sorted(near[w])) for w in near}
        best = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:TOP_TERMS]
        return [{"term": w, "score": s, "rank": k + 1} for k, (w, s) in enumerate(best)]

    stop = frozenset(T.RANKER_STOP_WORDS)

    @F.pandas_udf("array<struct<term: string, score: double, rank: int>>")
    def ranked(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in it:
            yield pd.Series([rank(list(w)) for w in part])

    return docs.where(F.col(text).isNotNull()).select(key, F.inline(ranked(T.tokens(F.col(text)))))


def line_chunks(docs: DataFrame, size: int = 20, overlap: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of ``size`` lines with ``overlap``; blank ones are left out, the first to reach the end is the last.

    Null texts give no rows; a text of blank lines gives one chunk of the whole.
    """
    size = min(max(size, 1), 500)
    step = max(size - min(overlap, size - 1), 1)
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n$", "")
    rows = docs.where(F.col(text).isNotNull()).select(key, F.split(plain, "\n").alias("lines")).withColumn("n", F.size("lines"))
    last = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.ceil((F.col("n") - size) / F.lit(step)).cast("int") * step)
    cut = (
        rows.select(key, "lines", "n", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start"))
        .withColumn("end_line", F.least(F.col("start") + size, F.col("n")))
        .withColumn("content", F.regexp_replace(F.array_join(F.slice("lines", F.col("start") + 1, F.lit(size)), "\n"), r"(?U)^\s+|\s+$", ""))
    )
    full = cut.where(F.col("content") != "").select(key, (F.col("start") + 1).alias("start_line"), "end_line", "content")
    return full


def chunk_by_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections that begin at Markdown headings; the start line is the heading's own."""
    head = re.compile(r"(?m)^#{1,6}\s+(.*)$")

    def cut(body: str) -> list[dict]:
        marks = list(head.finditer(body))
        if not marks:
            return [{"heading": "(document)", "start_line": 1, "end_line": max(body.count("\n") + (not body.endswith("\n")), 1), "content": body.strip()}]
        out = []
        for k, m in enumerate(marks):
            end = marks[k + 1].start() if k + 1 < len(marks) else len(body)
            section = body[m.end() : end].strip()
            first = body.count("\n", 0, m.end()) + 1
            out.append({"heading": m.group(1).strip(), "start_line": first, "end_line": max(first, body.count("\n", 0, end)), "content": section})
        return [c for c in out if c["content"]]

    @F.pandas_udf("array<struct<heading: string, start_line: int, end_line: int, content: string>>")
    def chunks(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in it:
            yield part.map(cut)

    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(chunks(text)).alias("ord", "c")).select(key, "ord", "c.*")


def hybrid_chunks(docs: DataFrame, target: int = 200, most: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs packed greedily to about ``target`` estimated tokens (1.3 a word), never over ``most`` unless one alone is."""

    def cut(body: str) -> list[dict]:
        out, own, size = [], [], 0
        for p in [p.strip() for p in body.replace("\r\n", "\n").split("\n\n") if p.strip()]:
            n = math.ceil(1.3 * len(p.split()))
            if own and (size >= target or size + n > most):
                out.append({"tokens": size, "content": "\n\n".join(own)})
                own, size = [], 0
            own.append(p)
            size += n
        return [*out, {"tokens": size, "content": "\n\n".join(own)}] if own else out

    @F.pandas_udf("array<struct<tokens: int, content: string>>")
    def chunks(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in it:
            yield part.map(cut)

    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(chunks(text)).alias("ord", "c")).select(key, "ord", "c.*")


def heading_bucket(heading: Column) -> Column:
    """The kind of section a heading stands for, else the heading in lower case."""
    low = F.lower(F.trim(heading))
    has = lambda *xs: F.lit(False) if not xs else _any(low, xs)
    return (
        F.when(low.isin("", "(unscoped)", "(untitled section)") | low.isNull(), "unscoped")
        .when(has("related"), "related")
        .when(has("troubleshoot"), "troubleshooting")
        .when(has("setup", "quickstart", "quick start"), "setup")
        .when(has("config"), "configuration")
        .when(has("overview", "what it is", "history"), "overview")
        .when(has("security", "access control", "auth"), "security")
        .when(has("routing", "session"), "routing")
        .otherwise(low)
    )


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def doc_type(headings: Column, content: Column) -> Column:
    """Guessed type of a document, null if none fits."""
    h, c = F.lower(F.coalesce(F.array_join(headings, " "), F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    return (
        F.when(_any(h, ("incident",)) | _any(c, ("postmortem",)), "incident")
        .when(_any(h, ("runbook",)) | _any(c, ("playbook",)), "runbook")
        .when(_any(h, ("changelog",)) | _any(c, ("release notes",)), "changelog")
        .when(_any(h, ("reference",)), "reference")
        .when(_any(h, ("tutorial", "quick start")), "tutorial")
        .when(_any(h, ("decision",)) | _any(c, ("adr",)), "decision")
    )


def aggregate_intent(question: Column) -> Column:
    """``count``, ``sum`` or null."""
    q = F.lower(question)
    count = _any(q, ("how many", " number of", "count the ", "times did i")) | q.startswith("count ")
    total = _any(q, ("how much", " total ", "combined", "in all", "sum ")) | q.startswith("total ")
    return F.when(count, "count").when(total, "sum")


def strict_date(raw: Column) -> Column:
    """The date of a text in one of three exact forms (date, date and time, with fraction), else null."""
    ok = raw.rlike(r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?)?$")
    clock = F.substring(raw, 12, 8)
    good = (F.length(raw) == 10) | ((F.substring(clock, 1, 2) < "24") & (F.substring(clock, 4, 2) < "60") & (F.substring(clock, 7, 2) < "60"))
    return F.when(ok & good, F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"))


MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
WEEKDAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"


def temporal_terms(text: Column) -> Column:
    """Sorted distinct temporal terms of a text: ISO dates, month and day, weekdays, "n units ago"."""
    low = F.lower(text)
    edge, stop = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    find = lambda p, g=0: F.regexp_extract_all(low, F.lit(edge + p + stop), F.lit(g))
    dates = F.filter(F.transform(find(r"(\d{4}-\d{1,2}-\d{1,2})"), lambda d: F.try_to_date(d, "yyyy-M-d")), lambda d: d.isNotNull())
    months = find(rf"((?:{MONTHS})\s+\d{{1,2}})")
    spaced = F.transform(months, lambda m: F.regexp_replace(m, r"\s+", " "))
    first, second = (lambda m: F.split(m, " ")[0]), (lambda m: F.split(m, " ")[1])
    ago = F.when(low.rlike(edge + r"(?:two|three|four|five|six|seven|eight|nine|ten|10|[1-9])\s+(?:day|week|month|year)s?\s+ago" + stop), F.array(F.lit("relative temporal"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform(dates, lambda d: F.concat(F.lit("date "), F.date_format(d, "yyyy-MM-dd"))),
                F.transform(spaced, lambda m: F.concat(F.lit("month "), first(m))),
                F.transform(spaced, lambda m: F.concat(F.lit("day "), second(m))),
                spaced,
                F.transform(find(f"({WEEKDAYS})"), lambda w: F.concat(F.lit("weekday "), w)),
                ago,
            )
        )
    )


def claims(chunks: DataFrame) -> DataFrame:
    """Claims of chunks (doc_id, heading, content, ts, topic, entities, terms): the lowest confidence of equal ones."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    claim = lambda s, p, o, c: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(c).alias("confidence"))
    topic_hit = (F.trim("topic") != "") & (F.contains(low("heading"), low("topic")) | F.contains(low("content"), low("topic")))
    every = F.concat(
        F.when(topic_hit, F.array(claim(F.col("topic"), "mentions", F.col("heading"), 0.55))).otherwise(F.array()),
        F.when(F.trim("ts") != "", F.array(claim(F.col("heading"), "timestamp", F.col("ts"), 0.5))).otherwise(F.array()),
        F.transform("entities", lambda e: claim(F.col("heading"), "mentions_entity", e, 0.45)),
        F.transform("terms", lambda t: claim(F.col("heading"), "important_term", t, 0.4)),
    )
    return (
        chunks.select("doc_id", F.explode(every).alias("c"))
        .select("doc_id", "c.*")
        .where((F.trim("subject") != "") & (F.trim("object") != ""))
        .groupBy("doc_id", "subject", "predicate", "object")
        .agg(F.min("confidence").alias("confidence"))
    )


def key_entities(docs: DataFrame, key: str = "doc_id", text: str = "text", concept: str = "concept", headings: str | None = None, keep: int = 12) -> DataFrame:
    """Heuristic entities: the concept, runs of title-case words, acronyms; scored by mentions, headings and position."""
    title, acronym = re.compile(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b"), re.compile(r"\b([A-Z]{2,8})\b")

    def rank(body: str, topic: str | None, heads: list[str]) -> list[dict]:
        found: dict[str, list] = {}
        if topic and topic.strip():
            found[topic.strip()] = [1, 0, "CONCEPT"]
        at = lambda k: len(body[:k].encode())
        for kind, hits in (("PROPN", [m for _, m in zip(range(80), title.finditer(body))]), ("ACRONYM", [m for _, m in zip(range(50), acronym.finditer(body))])):
            for m in hits:
                word = m.group(1).strip()
                if kind == "PROPN" and len(word.encode()) < 3:
                    continue
                own = found.setdefault(word, [0, at(m.start()), kind])
                own[0] += 1
                own[1] = min(own[1], at(m.start()))
        size, out = max(len(body.encode()), 1), []
        for word, (n, first, kind) in found.items():
            if len(word.encode()) >= 3:
                heads_hit = sum(word.lower() in h.lower() for h in heads)
                score = 0.8 * math.log1p(n) + 0.7 + 1.2 * 1.5 * heads_hit + 0.6 * (2 - first / size)
                out.append({"entity": word, "label": kind, "score": score})
        return sorted(out, key=lambda e: (-e["score"], e["entity"]))[:keep]

    @F.pandas_udf("array<struct<entity: string, label: string, score: double>>")
    def entities(bodies: pd.Series, topics: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([rank(b, t, [h for h in (x if x is not None else []) if h]) for b, t, x in zip(bodies, topics, heads, strict=True)])

    heads = F.col(headings) if headings else F.array().cast("array<string>")
    return docs.where(F.col(text).isNotNull()).select(key, F.inline(entities(F.col(text), F.col(concept), heads)))
