"""Held-out test items that leaked into a corpus.

The test items are indexed with BM25: for each word a posting list in item order,
cut into blocks that each know their highest weight.  Every document is cut into
overlapping passages (of stretches of words that items have, as a run can hold no
other) and every passage queries the index with block-max WAND for all items over
a threshold.  The threshold is safe: weights are divided by the
least score that any run of MIN_RUN words of the item can give, so a passage that
holds such a run scores at least 1 and no leak is lost.  The items retrieved are
then verified word by word, and the longest common run is reported.

Words are maximal runs of letters or digits without regard to case; layout and
punctuation don't count.  Passages overlap by MIN_RUN - 1 words, so every run lies
whole in one.  Items go to the tasks in blocks of at most BLOCK_ITEMS, one pass
over the corpus each, so what is broadcast is bounded.

Edge cases: null and short texts and items give nothing; equal items are each
reported; repeated documents give one row; an empty index gives no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from memloom.functions.sizing import spread_out

MIN_RUN = 12
PASSAGE_WORDS = 64
BLOCK_ITEMS = 20_000
#: Postings of a block of the index.
BLOCK = 16
K1, B = 1.2, 0.75
#: Scores this close below 1 are still verified: sums of floats.
SLACK = 1e-6

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Index:
    """BM25 postings of test items, weights relative to the least score of a run."""

    def __init__(self, items: list[tuple[int, str]], min_run: int = MIN_RUN) -> None:
        texts = sorted((i, w) for i, t in items if len(w := words_of(t)) >= min_run)
        self.ids, self.min_run = [i for i, _ in texts], min_run
        n, average = len(texts), sum(len(w) for _, w in texts) / max(1, len(texts))
        df = Counter(x for _, w in texts for x in set(w))
        idf = {x: math.log(1 + (n - k + 0.5) / (k + 0.5)) for x, k in df.items()}
        self.postings: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        self.runs: list[dict[tuple[str, ...], list[int]]] = []
        self.words = [w for _, w in texts]
        for k, (_, w) in enumerate(texts):
            norm = K1 * (1 - B + B * len(w) / average)
            weight = {x: idf[x] * tf * (K1 + 1) / (tf + norm) for x, tf in Counter(w).items()}
            starts = range(len(w) - min_run + 1)
            least = min(sum(weight[x] for x in set(w[s : s + min_run])) for s in starts)
            for x, v in weight.items():
                at, values = self.postings[x]
                at.append(k)
                values.append(v / least if least > 0 else 1.0)
            runs: dict[tuple[str, ...], list[int]] = {}
            for s in starts:
                runs.setdefault(tuple(w[s : s + min_run]), []).append(s)
            self.runs.append(runs)
        self.postings = dict(self.postings)
        self.top = {x: max(v) for x, (_, v) in self.postings.items()}
        self.blocks = {
            x: ([at[min(j + BLOCK, len(at)) - 1] for j in range(0, len(at), BLOCK)], [max(v[j : j + BLOCK]) for j in range(0, len(v), BLOCK)])
            for x, (at, v) in self.postings.items()
        }

    def search(self, query: set[str], threshold: float = 1.0 - SLACK) -> list[int]:
        """Places of all items that score at least ``threshold``, by block-max WAND."""
        terms = [x for x in query if x in self.top]
        if sum(self.top[x] for x in terms) < threshold:
            return []
        lists = [[self.postings[x][0], self.postings[x][1], self.top[x], self.blocks[x], 0] for x in terms]
        found = []
        while lists:
            lists.sort(key=lambda p: p[0][p[4]])
            bound, pivot = 0.0, -1
            for j, p in enumerate(lists):
                bound += p[2]
                if bound >= threshold:
                    pivot = j
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == item:
                pivot += 1
            # Bound by the blocks that would hold the pivot item.
            bound, ends = 0.0, []
            for at, _, _, (last, best), _ in lists[: pivot + 1]:
                b = bisect_left(last, item)
                if b < len(last):
                    bound += best[b]
                    ends.append(last[b])
            if bound < threshold:
                # No item up to the nearest block end, or before the next list's item, can do.
                target = min(ends) + 1 if ends else item + 1
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0][lists[pivot + 1][4]])
                target = max(target, item + 1)
            elif lists[0][0][lists[0][4]] == item:
                score = 0.0
                for p in lists[: pivot + 1]:
                    score += p[1][p[4]]
                if score >= threshold:
                    found.append(item)
                target = item + 1
            else:
                target = item
            moved = lists[: pivot + 1]
            for p in moved:
                if p[0][p[4]] < target:
                    p[4] = bisect_left(p[0], target, p[4])
            lists = [p for p in lists if p[4] < len(p[0])]
        return found

    def verify(self, passage: list[str], item: int, start: int, whole: list[str]) -> int:
        """Longest run of the item's words in the document around ``passage``; 0 if under min_run."""
        runs, own, longest = self.runs[item], self.words[item], 0
        for s in range(len(passage) - self.min_run + 1):
            for at in runs.get(tuple(passage[s : s + self.min_run]), ()):
                n, d = self.min_run, start + s
                while at + n < len(own) and d + n < len(whole) and own[at + n] == whole[d + n]:
                    n += 1
                longest = max(longest, n)
        return longest

    def leaks(self, text: str | None) -> dict[int, int]:
        """Item ids that leaked into a text, with their longest run."""
        whole, best = words_of(text), {}
        step, top, n = PASSAGE_WORDS - self.min_run + 1, self.top, len(whole)
        at = 0
        while at <= n - self.min_run:
            # Words that no item has end a run, so only stretches of known words are cut into passages.
            end = at
            while end < n and whole[end] in top:
                end += 1
            for start in range(at, end - self.min_run + 1, step):
                passage = whole[start : min(start + PASSAGE_WORDS, end)]
                for item in self.search(set(passage)):
                    if n_run := self.verify(passage, item, start, whole):
                        best[self.ids[item]] = max(n_run, best.get(self.ids[item], 0))
            at = end + 1
        return best


_INDEXES: dict[str, Index] = {}


def index_of(name: str, items: Callable[[], list[tuple[int, str]]], min_run: int) -> Index:
    """The index of a block, built once a worker process; only the latest block's is kept."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(items(), min_run)
    return _INDEXES[name]


def leaked_items(documents: DataFrame, items: DataFrame, min_run: int = MIN_RUN, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id and run (longest common run of words, at least ``min_run``) of every leak."""
    spark = documents.sparkSession
    own = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    texts = spread_out(documents.select("doc_id", "text").where(F.col("text").isNotNull()))
    schema = "doc_id long, item_id long, run int"

    def block(last: Row | None) -> list[Row]:
        rows = own
        if last is not None:
            rows = own.where((F.col("item_id") > last["item_id"]) | ((F.col("item_id") == last["item_id"]) & (F.col("text") > last["text"])))
        return rows.orderBy("item_id", "text").limit(block_items).collect()

    def leaks_of(rows: list) -> DataFrame:
        shared, name = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows]), uuid.uuid4().hex

        def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = index_of(name, lambda: shared.value, min_run)
            for part in it:
                out = [(d, i, n) for d, t in zip(part["doc_id"], part["text"], strict=True) for i, n in index.leaks(t).items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "run"])

        return texts.mapInPandas(search, schema)

    found, rows = [], block(None)
    while rows:
        found.append(leaks_of(rows))
        rows = block(rows[-1]) if len(rows) == block_items else []
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))
