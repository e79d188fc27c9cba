"""Splitting of oversized texts at natural boundaries by recursive bisection.

A text of more than ``max_chars`` code points is cut at the strongest boundary
near its middle; halves that still exceed ``max_chars - overlap`` are cut again;
then each piece but the first is given the ``overlap`` characters before it, so
that no piece is over the limit and consecutive pieces share exactly ``overlap``
characters.  Removing the overlaps gives the text back, character for character.

Boundaries from strong to weak: before a heading, blank line, line end, sentence
end, clause end, white space; with none of them in reach, between two characters
(never inside a CR LF pair or before a combining mark, unless the window holds
nothing else).  The window is the middle half of the stretch: a stronger kind
wins over a nearer one, and among equals the nearest to the middle wins.

Edge cases: a null text gives no piece, an empty or short text one piece; the
limit must exceed the overlap; lines are counted by LF, CR or CR LF; without a
usable start line the lines count from end line if there is one, else from 1;
reversed lines are swapped.  Each text is worked on alone and whole.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Each pattern ends where the next piece would begin.
_KINDS = [
    regex.compile(r"(?:\r\n|\n|\r)(?=#{1,6} |={1,6} ?\S[^\r\n]*=\s*$|<h[1-6]\b|\\(?:sub)*section\b)", regex.M),
    regex.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)(?=[^\r\n])"),
    regex.compile(r"(?:\r\n|\n|\r)(?=[^\r\n])"),
    regex.compile(r"[.!?…]+[\"'”’)\]]*\s+(?=\S)|[。！？]+(?=\S)"),
    regex.compile(r"[,;:–—]\s+(?=\S)|[、，；：](?=\S)"),
    regex.compile(r"\s+(?=\S)"),
]

PIECES = T.ArrayType(
    T.StructType([
        T.StructField("piece_no", T.IntegerType()), T.StructField("start_char", T.IntegerType()),
        T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("text", T.StringType()),
    ])
)


def _nearest(cuts: list[int], middle: int, low: int, high: int) -> int | None:
    k = bisect_left(cuts, middle)
    near = [c for c in cuts[max(0, k - 1) : k + 1] if low <= c <= high]
    return min(near, key=lambda c: (abs(c - middle), c)) if near else None


def cut_points(text: str, limit: int) -> list[int]:
    """Ends of the parts of ``text``, each of at most ``limit`` characters."""
    kinds: list[list[int] | None] = [None] * len(_KINDS)

    def cuts(k: int) -> list[int]:
        if kinds[k] is None:
            kinds[k] = [m.end() for m in _KINDS[k].finditer(text)]
        return kinds[k]  # type: ignore[return-value]

    def choose(start: int, end: int) -> int:
        size = end - start
        middle, low, high = start + size // 2, start + max(1, size // 4), end - max(1, size // 4)
        for k in range(len(_KINDS)):
            if (found := _nearest(cuts(k), middle, low, high)) is not None:
                return found
        at = middle
        while at < high and (unicodedata.combining(text[at]) or text[at - 1 : at + 1] == "\r\n"):
            at += 1
        return at

    ends, stack = [], [(0, len(text))]
    while stack:
        start, end = stack.pop()
        if end - start <= limit:
            ends.append(end)
        else:
            at = choose(start, end)
            stack += [(at, end), (start, at)]
    return ends


def split_text(text: str, max_chars: int, overlap: int, first_line: int = 1) -> list[dict]:
    """The pieces of one text, in order."""
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the limit")
    ends = cut_points(text, max_chars if len(text) <= max_chars else max_chars - overlap)
    breaks = np.array([m.end() for m in regex.finditer(r"\r\n|\n|\r", text)], dtype=np.int64)
    pieces, start = [], 0
    for n, end in enumerate(ends):
        begin = max(0, start - overlap) if n else 0
        last = max(begin, end - 1)
        line = lambda at: first_line + int(np.searchsorted(breaks, at, side="right"))
        pieces.append({"piece_no": n, "start_char": begin, "start_line": line(begin), "end_line": line(last), "text": text[begin:end]})
        start = end
    return pieces


def split_oversized(
    records: DataFrame, limits: DataFrame, *, kind: str = "record_kind", key: str = "record_key", text: str = "content", oversized_only: bool = False
) -> DataFrame:
    """Pieces of ``records`` (kind, key, content, start_line, end_line) under ``limits`` (record_kind, max_chars, overlap_chars).

    Rows that repeat count once.  Only texts over their limit go to Python; the
    others are their own piece.  Output: record_kind, record_key, piece_no,
    pieces, start_char, start_line, end_line, content.
    """
    few = limits.select(F.col("record_kind").alias(kind), "max_chars", "overlap_chars").dropDuplicates([kind])
    rows = (
        records.select(kind, key, text, "start_line", "end_line")
        .where(F.col(text).isNotNull())
        # The limits are a table of kinds of records, a handful of rows by meaning.
        .join(F.broadcast(few), kind)
        .withColumn("_size", F.char_length(text))
    )
    big = rows.where(F.col("_size") > F.col("max_chars")).withColumn("_lines", F.size(F.split(text, r"\r\n|\n|\r")))
    first = F.coalesce(F.least("start_line", "end_line"), F.lit(1))
    base = (
        F.when(F.col("start_line").isNotNull(), first)
        .when(F.col("end_line").isNotNull(), F.greatest(F.lit(1), F.col("end_line") - F.col("_lines") + 1))
        .otherwise(F.lit(1))
    )

    @F.pandas_udf(PIECES)
    def pieces(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, most, overlap, line in it:
            yield pd.Series([split_text(t, int(m), int(o), int(f)) for t, m, o, f in zip(texts, most, overlap, line, strict=True)])

    cut = (
        big.select(kind, key, text, "max_chars", "overlap_chars", base.alias("_line"))
        .dropDuplicates([kind, key, text, "_line"])
        .withColumn("_pieces", pieces(F.col(text), "max_chars", "overlap_chars", "_line"))
        .select(kind, key, F.size("_pieces").alias("pieces"), F.explode("_pieces").alias("p"))
        .select(kind, key, "p.piece_no", "pieces", "p.start_char", "p.start_line", "p.end_line", F.col("p.text").alias(text))
    )
    if oversized_only:
        return cut
    lines = F.size(F.split(text, r"\r\n|\n|\r"))
    whole = (
        rows.where(F.col("_size") <= F.col("max_chars"))
        .dropDuplicates([kind, key, text, "start_line", "end_line"])
        .withColumn("_lines", lines)
        .select(
            kind, key, F.lit(0).alias("piece_no"), F.lit(1).alias("pieces"), F.lit(0).alias("start_char"),
            base.alias("start_line"), (base + F.col("_lines") - 1).alias("end_line"), text,
        )
    )
    return cut.unionByName(whole)
