"""Keyword-stuffed pages and lists of links or tags.

First every page's rank-frequency curve is fitted with SQL windows: words ranked
by count, ln(count) against ln(rank), giving slope and residual, and the
divergence of its words from those of the language's prose.  Each figure is held
against the quartiles of same-language prose of comparable length; only pages
that are extreme on one of them (``EXTREME``) go on.  Then the flagged texts,
whole, are read line by line to confirm that more than half of their words stand
in repeated keywords, lists of links or lists of tags.  What words sentences are
made of is learnt from the same prose: its most frequent words, no list of words
is given.

Edge cases: null, blank and wordless texts are no case; languages are compared by
the first two letters, null and unknown ones form their own class; a language and
length without LEAST_REFERENCE pages of prose is held against the language at any
length, a language without them against all prose, and without any prose every
page is flagged; texts without spaces between words count a run of letters as a
word; repeated rows give one row; code, logs and JSON records count as words
outside lists.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.ordered import keep
from memloom.functions.sizing import spread_out

#: Robust deviations from same-language prose of comparable length beyond which a figure is extreme.
EXTREME = {"divergence": 3.0, "slope": 8.0, "residual": 8.0}
#: Prose pages that a class and length must have to be held against its own figures.
LEAST_REFERENCE = 200
#: Most frequent words of a language's prose that count by themselves (the others by their mean), and their longest length.
BACKGROUND_WORDS, BACKGROUND_CHARS = 8_192, 64
#: Share of a language's prose from which a word is one that sentences are made of.
COMMON_SHARE = 0.002
#: Share from which its repetition means nothing.
CORE_SHARE = 0.02

#: A word is a run of letters or digits; scripts without spaces count two characters as one.
_CJK = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff"
_WORD = re.compile(rf"[{_CJK}]{{1,2}}|(?:(?![{_CJK}])[^\W_])+")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\s]*\)|<a\b[^>]*>(.*?)</a>|(?:https?://|www\.)[^\s<>)\]]+|\[\[([^\]\n]*)\]\]", re.I)
_TAG = re.compile(r"#[^\W\d_][\w-]*|#\d+[^\W\d_][\w-]*")
_BULLET = re.compile(r"^\s*(?:[-*+•»›>·–]|\d+[.)])\s+")
_LABEL = re.compile(r"^\s*(?:tags?|keywords?|labels?|topics?|see also|related|links?|schlagw[oö]rter|mots[- ]cl[eé]s|etiquetas|タグ)\s*[:：]\s*", re.I)
_FENCE = re.compile(r"^\s*(```|~~~)")
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d|^\s*\d\d:\d\d:\d\d|\b(?:INFO|WARN|DEBUG|ERROR|TRACE)\b|\w+=\S+\s+\w+=\S+")
_END = re.compile(r"[.!?。！？…][\"'”’)\]]*\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_SEPARATORS = (";", "|", "•", "·", ",", " / ", "、", "›", "»", "~")

#: Words of sentences, and whether they are so frequent that repeating them means nothing.
Common = dict[str, bool]


def _plain(words: list[str], common: Common) -> bool:
    """Whether words that repeat stand among words that hardly belong to sentences."""
    n = len(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    again = {w for w, k in Counter(words).items() if k >= max(3, 0.08 * n)} | {w for p, k in pairs.items() if k >= max(2, 0.05 * n) for w in p}
    return bool(again) and sum(w in common and (w not in again or common[w]) for w in words) <= 0.2 * n


def _items(line: str, common: Common) -> bool:
    """Whether a line is a list of four or more short entries by some separator."""
    body = _LABEL.sub("", line)
    if re.search("[。！？]", body):
        return False
    best: list[str] = []
    for s in _SEPARATORS:
        if body.count(s) >= max(3, len(best)):
            best = max(best, [p for p in (p.strip() for p in body.split(s)) if p], key=len)
    if len(best) < 4:
        return False
    words = [_WORD.findall(p.lower()) for p in best]
    sizes, flat = [len(w) for w in words], [x for w in words for x in w]
    often = {w for w, n in Counter(flat).items() if n >= max(3, 0.08 * len(flat))}
    short = sum(n <= 5 for n in sizes)
    return short >= 0.9 * len(best) and sum(w in common and w not in often for w in flat) <= 0.25 * len(flat) and sum(sizes) <= 4 * len(best)


def listed_share(text: str, common: Common | None = None) -> float:
    """Share of the words that stand in repeated keywords, lists of links or lists of tags; ``common`` are words that sentences are made of."""
    common, total, listed, code = common or {}, 0, 0, False
    runs: list[tuple[str, list[str]]] = []  # short lines in a row

    def close() -> None:
        nonlocal listed
        if len(runs) >= 4:
            words = [w for _, ws in runs for w in ws]
            counts = Counter(tuple(ws[-2:]) for _, ws in runs)
            heads = Counter(words)
            if counts.most_common(1)[0][1] >= 2 or heads.most_common(1)[0][1] >= 3:
                listed += len(words)
        runs.clear()

    for line in text.splitlines():
        if _FENCE.match(line):
            close()
            code = not code
            total += len(_WORD.findall(line))
            continue
        words = _WORD.findall(line.lower())
        if not words:
            continue
        total += len(words)
        links = _LINK.findall(line) if "://" in line or "](" in line or "<" in line or "[[" in line or "www." in line.lower() else []
        bare = _LINK.sub(" ", line) if links else line
        if code or _LOG.search(bare) or line.lstrip().startswith(("{", "[{", "$ ")):
            close()
            continue
        tags = _TAG.findall(line) if line.count("#") >= 3 else []
        if links:
            rest = _WORD.findall(_LABEL.sub("", bare))
            if len(rest) <= 4 * len(links) and not (_END.search(line) and len(rest) > 3):
                close()
                listed += len(words)
                continue
        if len(tags) >= 3:
            tagged = sum(len(_WORD.findall(t)) for t in tags)
            if tagged >= 0.5 * len(words):
                close()
                listed += tagged
                continue
        if _items(line, common):
            close()
            listed += len(words)
            continue
        body = _BULLET.sub("", line)
        own = _WORD.findall(body.lower())
        if len(own) <= 5 and not _END.search(body) and not body.startswith(("#", "=")) and ":" not in body:
            runs.append((body, own))
            continue
        close()
        for sentence in _SENTENCE.split(body):
            ws = _WORD.findall(sentence.lower())
            if len(ws) >= 4 and _plain(ws, common):
                listed += len(ws)
    close()
    return listed / total if total else 0.0


def reads_as_prose(text: Column, words: Column) -> Column:
    """Rough sign of prose, for the reference only: a sentence end every 4 to 30 words and hardly any marks of lists and code."""
    ends, marks = F.regexp_count(text, F.lit("[.!?。！？]")), F.regexp_count(text, F.lit("[;|#/\\[\\]{}=<>]"))
    return (ends * 30 >= words) & (marks * 25 <= words) & (words > 0)


def _words(documents: DataFrame, *columns: str) -> DataFrame:
    """``columns``, class, words and whether the text reads as prose.

    Readers use ``explode_outer``: the other form filters by the words, which would
    then be split once more before every shuffle of the texts.
    """
    language = F.regexp_extract(F.lower(F.trim("lang")), "^[a-z]{2}", 0)
    # The class as a number: keys of every (document, word) row are short then.
    number = F.ascii(language) * 256 + F.ascii(F.substring(language, 2, 1))
    split = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    named = documents.select(*columns, "text", F.coalesce(number, F.lit(0)).alias("class"), split.alias("w"))
    return named.select(*columns, "class", "w", F.size("w").alias("words"), reads_as_prose(F.col("text"), F.size("w")).alias("prose"))


def background(documents: DataFrame) -> DataFrame:
    """(class, word, share): the BACKGROUND_WORDS most frequent words of each language's prose; word null is the mean of the others."""
    # A row a language and word, read three times.
    counts = keep(_words(documents).where("prose").select("class", F.explode_outer("w").alias("word")).groupBy("class", "word").agg(F.count("*").alias("n")))
    order = Window.partitionBy("class").orderBy(F.desc("n"), "word")
    known = counts.where(F.length("word") <= BACKGROUND_CHARS).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= BACKGROUND_WORDS)
    totals = counts.groupBy("class").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    heads = known.groupBy("class").agg(F.sum("n").alias("head"), F.count("*").alias("listed"))
    sums = totals.join(F.broadcast(heads), "class")  # classes are two letters
    mean = (F.col("total") - F.col("head") + 0.5) / (F.col("distinct") - F.col("listed") + 1) / F.col("total")
    rest = sums.select("class", F.lit(None).cast("string").alias("word"), mean.alias("share"))
    own = known.join(F.broadcast(sums.select("class", "total")), "class").select("class", "word", (F.col("n") / F.col("total")).alias("share"))
    return own.unionByName(rest)


FIGURES = ("slope", "residual", "divergence")


def rank_frequency(documents: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, class, prose, words, slope, residual and divergence of every document with words; ``words`` is the background.

    Documents are dealt out once, so that counting, ranking and fitting need no
    further shuffle; the background has a proven size and is sent to every task.
    """
    # A language without prose: every word is as rare as can be.
    tokens = _words(documents.select("doc_id", "text", "lang").repartition("doc_id"), "doc_id")
    page = F.struct("class", "prose", "words").alias("page")
    counts = tokens.select("doc_id", page, F.explode_outer("w").alias("word")).where(F.col("word").isNotNull()).groupBy("doc_id", "page", "word").agg(F.count("*").alias("n")).select("doc_id", "page.*", "word", "n")
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"))))
    rest = words.where(F.col("word").isNull()).select("class", F.col("share").alias("_rest"))
    held = ranked.join(F.broadcast(words.where(F.col("word").isNotNull())), ["class", "word"], "left").join(F.broadcast(rest), "class", "left")
    x, y, p = F.ln(F.col("_r").cast("double")), F.ln(F.col("n").cast("double")), F.col("n") / F.col("words")
    sums = held.withColumns({"x": x, "y": y}).groupBy("doc_id", "class", "prose", "words").agg(
        F.count("*").alias("k"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(p * F.ln(p / F.coalesce("share", "_rest", F.lit(1e-9)))).alias("divergence"),
    )
    xx, xy, yy = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("k"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("k"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("k"))
    fitted = sums.withColumn("slope", F.when(xx > 1e-9, xy / xx).otherwise(F.lit(0.0))).withColumn("residual", F.sqrt(F.greatest(yy - F.col("slope") * xy, F.lit(0.0)) / F.col("k")))
    return fitted.select("doc_id", "class", "prose", "words", *FIGURES)


def _reference(curves: DataFrame, by: list, suffix: str) -> DataFrame:
    """Quartiles of the figures of each group."""
    quarters = [F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"_q{suffix}_{f}") for f in FIGURES]
    return curves.groupBy(*by).agg(F.count("*").alias(f"_n{suffix}"), *quarters)


def _away(figure: str, quartiles: Column) -> Column:
    """Robust deviations of a figure from the median; only upwards for the divergence."""
    by = F.col(figure) - F.get(quartiles, 1)
    return (by if figure == "divergence" else F.abs(by)) / F.greatest(0.7413 * (F.get(quartiles, 2) - F.get(quartiles, 0)), F.lit(1e-6))


def extreme(curves: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """The curves with ``flagged``: a figure is extreme against same-language prose of comparable length (within a doubling of the word count).

    Stuffed pages with full stops may look like prose and be most of it at some
    length, so prose whose divergence is extreme in its language at any length is
    left out of the reference for its length.
    """
    limits = limits or EXTREME
    # A row of figures a document, read four times.
    bins = keep(curves.withColumn("_bin", F.floor(F.log2(F.col("words").cast("double")))))
    # Rows for each language class and doubling of length: some tens a class.
    prose = bins.where("prose")
    held = (
        bins.join(F.broadcast(_reference(prose, ["class"], "b")), "class", "left")
        .withColumn("_all", F.lit(1))
        .join(F.broadcast(_reference(prose, [F.lit(1).alias("_all")], "c")), "_all", "left")
    )
    wide = lambda f: F.when(F.col("_nb") >= LEAST_REFERENCE, F.col(f"_qb_{f}")).otherwise(F.col(f"_qc_{f}"))
    sound = held.where(F.col("prose") & (_away("divergence", wide("divergence")) <= EXTREME["divergence"]))
    held = held.join(F.broadcast(_reference(sound, ["class", "_bin"], "a")), ["class", "_bin"], "left")
    far = F.lit(False)
    for f, limit in limits.items():
        held = held.withColumn(f"z_{f}", _away(f, F.when(F.col("_na") >= LEAST_REFERENCE, F.col(f"_qa_{f}")).otherwise(wide(f))))
        far = far | F.coalesce(F.col(f"z_{f}") > limit, F.lit(True))
    return held.withColumn("flagged", far)


def stuffed_pages(documents: DataFrame, share: float = 0.5, limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id and share of the pages of which more than ``share`` of the words are listed."""
    own = documents.select("doc_id", "text", "lang").where(F.col("text").isNotNull())
    # At most BACKGROUND_WORDS a language, and 1 / COMMON_SHARE of them on the driver.
    words = keep(background(own))
    frequent = words.where(F.col("word").isNotNull() & (F.col("share") >= COMMON_SHARE)).groupBy("word").agg(F.max("share").alias("share"))
    common = {r["word"]: r["share"] >= CORE_SHARE for r in frequent.collect()}

    @F.pandas_udf("double")
    def listed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield texts.map(lambda t: listed_share(t, common)).astype("float64")

    listed = listed.asNondeterministic()  # run once, after the join
    flagged = extreme(rank_frequency(own, words), limits).where("flagged").select("doc_id").distinct()
    read = spread_out(own).join(flagged, "doc_id", "left_semi").withColumn("listed", listed("text"))
    return read.where(F.col("listed") > share).groupBy("doc_id").agg(F.max("listed").alias("listed"))
