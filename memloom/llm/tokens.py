"""Token ids of a corpus by a public byte-level BPE vocabulary.

The texts are split into words in Spark by the vocabulary's own pattern; each
distinct word is encoded once; the ids come back by word and are put in order by
position.  A word's ids don't depend on its neighbours, so
this equals encoding each text whole.  Decoding joins ids with the table of pieces.

The ids of the HOT_WORDS most frequent words of at most HOT_CHARS characters (so a
proven size) are sent to every task and put in place of the words in their text:
" the" and its like, which may be a third of all positions, are never shuffled.
Only positions of other words are; they meet their ids by a shuffle, the
vocabulary having no bound, and return to their text by another.

Edge cases: null and empty texts give an empty list; every other text gives at
least one id; special tokens' strings are ordinary text; repeated doc_ids with
the same text give one row, with different texts one row a text; doc_id null is
kept as a key.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.ordered import keep

#: Fixed value: the split pattern of the vocabulary, with Unicode white space for the JVM.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HOT_WORDS = 16_384
HOT_CHARS = 128
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}


@lru_cache(maxsize=4)
def encoder(lines: bytes):  # noqa: ANN201
    import tiktoken

    # Words come one at a time: the pattern takes each whole.
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks(lines), special_tokens={})


def vocabulary(spark: SparkSession, path: str) -> bytes:
    """The lines of the vocabulary file, read where the driver is, else by Spark; as many as the vocabulary has pieces."""
    if os.path.isfile(path):
        with open(path, "rb") as f:
            return f.read()
    return "\n".join(r["value"] for r in spark.read.text(path).collect()).encode()


def words(text: Column) -> Column:
    """The words of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def encode_words(distinct: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``distinct`` (word) with the ids of each word."""
    shared = distinct.sparkSession.sparkContext.broadcast(vocabulary(distinct.sparkSession, path))

    def encode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(shared.value)
        for part in it:
            yield part.assign(ids=own.encode_ordinary_batch(part["word"].tolist(), num_threads=1))

    return distinct.select("word").mapInPandas(encode, "word string, ids array<int>")


def encode_corpus(documents: DataFrame, path: str = VOCABULARY, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id and ids of every document of (doc_id, text)."""
    spark = documents.sparkSession
    # Counts of the distinct words, read for the frequent ones and for all others.
    split = words(F.coalesce("text", F.lit("")))
    uses = keep(documents.select(F.explode(split).alias("word")).groupBy("word").agg(F.count("*").alias("uses")))
    first = uses.where(F.length("word") <= HOT_CHARS).orderBy(F.desc("uses"), "word").limit(hot_words)
    hot = spark.sparkContext.broadcast({r["word"]: r["ids"] for r in encode_words(first, path).collect()})
    known = spark.createDataFrame([(w,) for w in hot.value], "hot string")
    rare = encode_words(uses.join(F.broadcast(known), F.col("word") == F.col("hot"), "left_anti"), path)

    # A null doc_id is a key.
    key = ["_h", "_k", "_null"]
    texts = documents.select(F.xxhash64("doc_id", "text").alias("_h"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_null"), "text")
    rest = texts.select(*key, F.posexplode(split).alias("pos", "word")).join(F.broadcast(known), F.col("word") == F.col("hot"), "left_anti")
    back = (
        rest.join(rare, "word")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set(F.struct("pos", "ids"))).alias("p"))  # repeated rows of a text give the same positions
        .select(*key, F.transform("p", lambda p: p["ids"]).alias("rest"))
    )

    @F.pandas_udf("array<int>")
    def place(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of = hot.value.get
        for lists, others in it:
            out = []
            for own, rare in zip(lists, others, strict=True):
                left, ids = iter(rare if rare is not None else ()), []
                for w in own:
                    found = of(w)
                    ids.extend(next(left) if found is None else found)
                out.append(ids)
            yield pd.Series(out, dtype=object)

    # Repeated rows go where they meet, before Python, whose output Spark doesn't know to be dealt out by text.
    done = texts.join(back, key, "left").distinct()
    return done.select(F.when(~F.col("_null"), F.col("_k")).alias("doc_id"), place(split, "rest").alias("ids"))


def pieces(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """(id, piece): the bytes of each id as hex; as many rows as the vocabulary file has lines."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    two = F.split("value", " ")
    return lines.select(F.get(two, 1).cast("int").alias("id"), F.hex(F.unbase64(F.get(two, 0))).alias("piece"))


def decode_corpus(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of (doc_id, ids); an empty list is an empty text."""
    table = pieces(encoded.sparkSession, path)
    placed = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id")
    text = F.decode(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), "")), "UTF-8")
    full = placed.groupBy("doc_id").agg(text.alias("text"))
    return full.unionByName(encoded.where(F.size("ids") == 0).select("doc_id", F.lit("").alias("text")))
