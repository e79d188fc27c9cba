"""Profiles, scoped search, stores, walks and measures against brute force."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from memloom.operators import evaluate as E
from memloom.operators import facts as A
from memloom.operators import graph as G
from memloom.operators import index as I
from memloom.operators import rank as R
from memloom.operators import segments as S
from memloom.operators import store as M
from memloom.sources import registry


def test_rolling_memory_against_the_fold(spark):
    rng, rows, turns = random.Random(5), [], {}
    for d in range(6):
        turns[d] = [[] for _ in range(25)]
        for t in range(25):
            for p in range(rng.randint(0, 5)):
                kind, term = rng.choice(["term", "entity", "topic"]), rng.choice("abcdefgh")
                turns[d][t].append((kind, term))
                rows.append((d, t, p, kind, term))
        turns[d][24].append(("term", "z"))
        rows.append((d, 24, 9, "term", "z"))
    got = S.rolling_memory(spark.createDataFrame(rows, "doc_id int, turn int, pos int, kind string, term string")).collect()
    own = {d: {r.term: r.weight for r in got if r.doc_id == d} for d in turns}
    for d, t in turns.items():
        expected = S.local_memory(t)
        assert own[d].keys() == expected.keys() and all(abs(own[d][k] - v) < 1e-9 for k, v in expected.items())


def test_profiles_keep_the_heaviest(spark):
    rows = [("s", f"d{k}", "terms", f"t{j:03d}", 1.0) for k in range(3) for j in range(40)]
    got = S.build_profiles(spark.createDataFrame(rows, "segment_id string, doc_id string, kind string, term string, weight double")).collect()
    assert {r.term for r in got} == {f"t{j:03d}" for j in range(24)} and abs(sum(r.weight for r in got) - 1) < 1e-9
    assert S.build_profiles(spark.createDataFrame(rows[:0], "segment_id string, doc_id string, kind string, term string, weight double")).count() == 0


def test_all_segments_are_a_global_search(spark):
    rng = random.Random(2)
    scores = spark.createDataFrame([(f"q{q}", f"d{d}", rng.random()) for q in range(4) for d in range(30)], "query_id string, doc_id string, score double")
    members = spark.createDataFrame([(f"s{d % 5}", f"d{d}") for d in range(30)], "segment_id string, doc_id string")
    routes = spark.createDataFrame([(f"q{q}", f"s{s}", 1.0 + s) for q in range(3) for s in range(5)], "query_id string, segment_id string, score double")
    queries = scores.select("query_id").distinct()
    key = lambda df: {(r.query_id, r.doc_id, r.score) for r in df.collect()}
    scoped, told = S.scope(queries, routes, 5)
    assert key(S.scoped_search(scores, scoped, members)) == key(scores)
    assert {r.query_id: (r.segments, r.reason) for r in told.collect()} == {"q0": (5, "scoped"), "q1": (5, "scoped"), "q2": (5, "scoped"), "q3": (0, "no_route")}
    scoped, told = S.scope(queries, routes, 1)
    got = S.scoped_search(scores, scoped, members).collect()
    assert {r.segment_id for r in got if r.query_id == "q0"} == {"s4"} and sum(r.query_id == "q3" for r in got) == 30
    assert S.scope(queries, routes, 1, 9.0)[1].where("reason = 'weak_routes'").count() == 3


def test_typed_overlap(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    q = {"people": a("x", "y"), "subjects": a("s"), "times": a(), "actions": a("do"), "objects": a("o")}
    score = lambda seg: spark.range(1).select(S.typed_overlap(q, seg).alias("v")).first().v
    assert score({k: a() for k in q}) == 0.0 and score({**{k: a() for k in q}, "people": a("x")}) == 0.0
    assert abs(score({**{k: a() for k in q}, "people": a("x"), "subjects": a("s")}) - (1.4 + 0.75 + 1.0 + 0.35)) < 1e-9


def test_temporal_paths_against_all_pairs(spark):
    rng, start = random.Random(9), date(2024, 1, 1)
    anchors = [(f"q{k}", start + timedelta(rng.randint(0, 200))) for k in range(20)] + [("n", None)]
    days = [(f"s{k % 7}", start + timedelta(rng.randint(0, 200))) for k in range(60)] + [("n", None)]
    a, b = spark.createDataFrame(anchors, "query_id string, day date"), spark.createDataFrame(days, "segment_id string, day date")
    ok = {"near": lambda g: abs(g) <= 7, "before": lambda g: -28 <= g <= -1, "after": lambda g: 1 <= g <= 28}
    for how, fits in ok.items():
        best = {}
        for q, x in anchors:
            for s, y in days:
                if x and y and fits((y - x).days):
                    v = 1.5 * (1 - abs((y - x).days) / 28) + (1.0 if how == "near" else 0.65)
                    best[q, s] = max(v, best.get((q, s), 0))
        got = {(r.query_id, r.segment_id): r.score for r in S.temporal_paths(a, b, how).collect()}
        assert got.keys() == best.keys() and all(abs(got[k] - v) < 1e-9 for k, v in best.items())


@pytest.mark.parametrize("few", [10_000, 0])
def test_as_of_both_ways(spark, few):
    rng, start = random.Random(1), date(2023, 1, 1)
    rows = []
    for k in range(200):
        a = rng.choice([None, start + timedelta(rng.randint(0, 500))])
        rows.append((k, a, rng.choice([None, (a or start) + timedelta(rng.randint(0, 300))])))
    days = [start + timedelta(37 * k) for k in range(15)]
    facts = spark.createDataFrame(rows, "k int, valid_from date, valid_to date")
    got = {(r.k, r.as_of) for r in A.as_of(facts, spark.createDataFrame([(d,) for d in [*days, None]], "day date"), few).collect()}
    assert got == {(k, d) for k, a, b in rows for d in days if a and a <= d and (b is None or d < b)}


def test_latest_rows(spark):
    rows = lambda *x: spark.createDataFrame(x, "k string, v string, at int")
    got = {r.k: (r.v, r.at) for r in M.upsert(rows(("a", "old", None), ("b", "old", 2), ("c", "old", 5)), rows(("b", "new", 2), ("c", "new", None), ("d", "x", None)), "k", "at").collect()}
    assert got == {"a": ("old", None), "b": ("new", 2), "c": ("old", 5), "d": ("x", None)}
    same = [M.upsert(rows().limit(0), rows(*p), "k", "at").first().v for p in ([("a", "x", 1), ("a", "y", 1)], [("a", "y", 1), ("a", "x", 1)])]
    assert same[0] == same[1]


def test_numbers_across_tasks(spark):
    from memloom.functions.ordered import numbered

    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k, "x") for k in range(500)]
    rng.shuffle(rows)
    got = {(r.s, r.k): r.n for r in numbered(spark.createDataFrame(rows, "s string, k int, _other string").repartition(4), ["s"], ["k"], "n").collect()}
    seen: dict = {}
    for s, k, _ in sorted(rows, key=lambda r: r[1]):
        seen[s] = seen.get(s, 0) + 1
        assert got[s, k] == seen[s]
    assert len(got) == 500


def test_two_writers(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k long, v string, at int")
    one, two = M.Store(spark, str(tmp_path / "s"), buckets=4), M.Store(spark, str(tmp_path / "s"), buckets=4)
    assert one.upsert(rows(*[(k, "a", 1) for k in range(20)]), "k", "at")
    before = one.current()
    assert one.upsert(rows((3, "b", 2)), "k", "at")
    after = one.current()
    assert sum(before["buckets"][b] != after["buckets"][b] for b in after["buckets"]) == 1  # only the key's bucket was written
    assert not two._claim({**after, "number": after["number"]}) and two.current() == after
    assert {r.k: r.v for r in two.read().collect()} == {**{k: "a" for k in range(20)}, 3: "b"}
    assert one.upsert(rows().limit(0), "k", "at", rows(*[(k, "", 0) for k in range(20)]).select("k")) and one.read().count() == 0
    assert one.compact() >= 1 and one.read().count() == 0


def test_chains_end_soon(spark, monkeypatch):
    """A graph without cycles is trimmed away: no colouring at all."""
    chain = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(9)], "src string, dst string")
    calls = []
    monkeypatch.setattr(G, "reachable", lambda *a, **k: calls.append(1))
    got = {r.node: r.component for r in G.components(chain).collect()}
    assert got == {f"n{k:02d}": f"n{k:02d}" for k in range(10)} and not calls


def test_long_walks(spark, monkeypatch):
    monkeypatch.setattr(G, "COMPACT", 3)
    edges = spark.createDataFrame([(k, k + 1) for k in range(10)] + [(10, 0)], "src long, dst long")
    got = {r.node: r.depth for r in G.reachable(spark.createDataFrame([(0,)], "node long"), edges).collect()}
    assert got == {k: k for k in range(11)}


def test_concepts_of_any_length(spark):
    name = "the very long name of one page"
    p = spark.createDataFrame([("a.md", name, ""), ("b.md", "beta", f"see {name.title()} for more")], "rel_path string, concept string, content string").withColumn("links", F.array().cast("array<string>"))
    assert [(r.rel_path, r.target) for r in G.missing_cross_references(p).collect()] == [("b.md", "a.md")]


def test_severity(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "rel_path string")
    missing = spark.createDataFrame([("b", "a"), ("a", "d"), ("d", "c")], "rel_path string, target string")
    got = {(r.rel_path, r.target): r.severity for r in G.cross_reference_severity(missing, edges, nodes, G.components(edges)).collect()}
    assert got == {("b", "a"): "high", ("a", "d"): "high", ("d", "c"): "high"}
    whole = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")], "node string, component string")
    got = {(r.rel_path, r.target): r.severity for r in G.cross_reference_severity(missing, edges, nodes, whole).collect()}
    assert got == {("b", "a"): "high", ("a", "d"): "low", ("d", "c"): "low"}


def test_expansion(spark):
    lexicon = [("job", "occupation", "synonym", 0.9), ("occupation", "office", "related", 0.5), ("occupation", "career", "related", 0.85), ("occupation", "trade", "similar", 0.7), ("occupation", "post", "similar", 0.6), ("occupation", "query", "synonym", 0.99)]
    terms = spark.createDataFrame([("q", "occupation"), ("q", "query")], "query_id string, term string")
    got = {r.related for r in R.expand(terms, spark.createDataFrame(lexicon, "term string, related string, relation string, confidence double")).collect()}
    assert got == {"job", "career", "trade"}


def test_hard_time_filter(spark):
    d = lambda n: date(2024, 1, n)
    df = spark.createDataFrame([(1, d(5)), (2, d(9)), (3, None)], "k int, day date")
    keys = lambda x: {r.k for r in x.collect()}
    assert keys(R.temporal_filter(df)) == {1, 2, 3} and keys(R.temporal_filter(df, start=F.lit(d(6)))) == {2}
    assert keys(R.temporal_filter(df, target=F.lit(d(6)), window_days=2)) == {1} and keys(R.temporal_filter(df, end=F.lit(None).cast("date"))) == {1, 2, 3}


def test_diversified_picks(spark):
    cand = spark.createDataFrame([("q", "a", "s1", 1.0), ("q", "b", "s1", 0.95), ("q", "c", "s2", 0.8)], "query_id string, doc_id string, segment_id string, score double")
    terms = spark.createDataFrame([("q", "a", "x"), ("q", "b", "x"), ("q", "c", "y")], "query_id string, doc_id string, term string")
    assert [(r.pick, r.doc_id) for r in R.diversified(cand, terms, 3).orderBy("pick").collect()] == [(1, "a"), (2, "c"), (3, "b")]


def test_number_words_count(spark):
    df = spark.createDataFrame([("q", "g", "d1", 1, "I bought twenty-one apples and 3 pears"), ("q", "h", "d2", 2, None)], "query_id string, group_id string, doc_id string, rank int, text string")
    assert E.sum_answer(df, 10, number_words=True).first().answer == 24.0 and E.sum_answer(df, 10).first().answer == 3.0
    intents = spark.createDataFrame([("q", "sum"), ("r", "count"), ("n", None)], "query_id string, intent string")
    got = {r.query_id: r.text for r in E.answers(intents, E.count_answer(df, 10), E.sum_answer(df, 10), 10).collect()}
    assert got == {"q": "3", "r": "0"}


def test_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# A\n")
    (tmp_path / "x.jsonl").write_text('{"role": "user"}\n')
    assert registry.source_of(str(tmp_path / "x.jsonl")).name == "json_lines" and registry.ingest(spark, str(tmp_path / "docs")).first().content == "# A\n"
    assert registry.ingest(spark, str(tmp_path / "x.jsonl")).first().source == "json_lines"
    with pytest.raises(LookupError):
        registry.source_of("x.bin", "none")


def test_index_is_read_back(spark, tmp_path):
    doc = ("d", "g", date(2024, 1, 1), ["alpha", "beta", "alpha"], ["beta"], ["alpha"], ["alpha"], [], ["alpha"], ["note"], ["alpha", "beta"])
    corpus = spark.createDataFrame([doc], "doc_id string, group_id string, day date, tokens array<string>, heading_tokens array<string>, terms array<string>, entities array<string>, temporal array<string>, topic_tokens array<string>, type_tokens array<string>, rerank array<string>")
    post = spark.createDataFrame([("alpha", "d", 0.8)], "key string, doc_id string, score double")
    links = spark.createDataFrame([], "src string, dst string")
    root = str(tmp_path / "index")
    assert I.read(spark, root) is None
    I.write(I.of_corpus(corpus, post, post, links), root, "v1")
    assert I.read(spark, root, "v2") is None
    q = spark.createDataFrame([("q", "alpha", ["alpha"], None, None)], "query_id string, norm string, terms array<string>, intent string, target date")
    kept, fresh = (R.hybrid(q, x).first() for x in (I.read(spark, root, "v1"), I.of_corpus(corpus, post, post, links)))
    assert kept == fresh and kept.doc_id == "d" and kept.score > 0
