from datetime import date, datetime

from pyspark.sql import functions as F

from memloom.functions.ordered import with_next
from memloom.operators import evaluate as E
from memloom.operators import facts as A
from memloom.operators import graph as G
from memloom.operators import rank as R
from memloom.operators import segments as S
from memloom.operators import store as M


def test_versions(spark):
    rows = [("s", "p", "a", date(2024, 1, 1), 1), ("s", "p", "A ", date(2024, 1, 3), 2), ("S", "p", "b", date(2024, 1, 5), 3), ("s", "p", "a", date(2024, 1, 9), 4)]
    c = spark.createDataFrame(rows, "subject string, predicate string, object string, day date, doc_id long")
    got = [(r.version, r.object.strip().lower(), r.valid_from.day, r.valid_to and r.valid_to.day, r.is_latest) for r in A.versioned(c).orderBy("version").collect()]
    # the repeated value moves valid_from, which leaves a gap before it
    assert got == [(1, "a", 3, 5, False), (2, "b", 5, 9, False), (3, "a", 9, None, True)]
    assert A.versioned(c, contiguous=True).orderBy("version").first().valid_from.day == 1


def test_next_across_tasks(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = with_next(df, ["k"], ["v"]).orderBy("k").collect()
    assert [r.next_v for r in out] == [2 * (k + 1) for k in range(999)] + [None]


def test_reach_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x"), ("f", "a")], "src string, dst string")
    roots = spark.createDataFrame([("d",)], "node string")
    assert {r.node for r in G.reachable(roots, edges).collect()} == {"d", "e"}
    got = {r.node: r.component for r in G.components(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "x": "x"}


def test_cross_references(spark):
    rows = [("alpha.md", "alpha", "Gamma is close. Related: Beta."), ("beta.md", "beta", "see Alpha"), ("gamma.md", "gamma", "```\nalpha beta\n```")]
    p = spark.createDataFrame([(a, b, c, []) for a, b, c in rows], "rel_path string, concept string, content string, links array<string>")
    assert {(r.rel_path, r.target) for r in G.missing_cross_references(p).collect()} == {("alpha.md", "gamma.md"), ("alpha.md", "beta.md"), ("beta.md", "alpha.md")}
    assert {r.rel_path for r in G.unreferenced(G.page_nodes(p), G.page_edges(p)).collect()} == {"alpha.md", "beta.md", "gamma.md"}


def test_group_cap_and_bm25(spark):
    docs = spark.createDataFrame([(1, ["a", "b"], "g"), (2, ["a"], "g"), (3, ["a", "a"], "g"), (4, ["c"], None)], "doc_id long, w array<string>, group_id string")
    q = spark.createDataFrame([(1, "a"), (1, "c")], "query_id long, token string")
    scores = R.bm25(R.field_tokens(docs, {"content": F.col("w")}), q, docs.agg(F.count("*").alias("n")), {"content": 1.0})
    ranked = R.cap_groups(scores.join(docs, "doc_id"), 10).collect()
    assert sum(r.group_id == "g" for r in ranked) == 2 and {r.doc_id for r in ranked} >= {3, 4}


def test_prefix_keys(spark):
    t, k = spark.createDataFrame([("index",), ("inde",), ("ind",)], "term string"), spark.createDataFrame([("index",), ("indexer",)], "key string")
    assert {(r.term, r.key, r.exact) for r in R.prefix_keys(t, k).collect()} == {("index", "index", True), ("inde", "index", False)}


def test_filters(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"a": "1"},), (None,)], "m map<string,string>")
    assert df.where(R.matches_filters(F.col("m"), {"a": "1", "b": "2"})).count() == 1 and df.where(R.matches_filters(F.col("m"), {})).count() == 3


def test_metrics(spark):
    res = spark.createDataFrame([(1, "x", 1), (1, "g", 2), (1, "g", 3)], "query_id long, item string, rank int")
    gold = spark.createDataFrame([(1, "g"), (1, "h"), (2, "z")], "query_id long, item string")
    m = {r.query_id: r for r in E.retrieval_metrics(res, gold).collect()}
    assert m[1].recall_5 == 0.5 and m[1].mrr == 0.5 and m[2].mrr == 0.0 and abs(m[1].ndcg_10 - (1 / 1.5849625) / (1 + 1 / 1.5849625)) < 1e-6


def test_routers(spark):
    rows = [("s1", {"router": 3.0, "Cache": 1.0, "none": None}, {"router": 1.0}, {}, None), ("s2", {"cache": 2.0}, {}, {"cache": 1.0}, {})]
    p = S.long_profiles(spark.createDataFrame(rows, "segment_id string, terms map<string,double>, entities map<string,double>, topics map<string,double>, local_memory map<string,double>"))
    q = spark.createDataFrame([("q", "router"), ("q", "missing")], "query_id string, term string")
    for how in ("sparse", "local", "coverage", "kl"):
        assert S.best_routes(S.route(q, p, how), 1).first().segment_id == "s1"
    assert abs(S.route(q, p, "sparse").first().score - (0.75 + 1.3)) < 1e-9
    assert [r.segment_id for r in S.team(q, p, 2).orderBy("pick").collect()] == ["s1"]


def test_redaction(spark):
    text = "ok\napi_key=1\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\nfine\nghp_abcdefgh12"
    r = M.redact_lines(spark.createDataFrame([(1, text), (2, None)], "k long, t string"), "k", "t").collect()
    assert len(r) == 1 and r[0].secret_lines == 5 and r[0].redacted.split("\n")[0] == "ok" and r[0].redacted.split("\n")[5] == "fine"


def test_store(spark, tmp_path):
    store = M.Store(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame(x, "k long, v string, at int")
    assert store.read() is None and store.upsert(rows((1, "a", 1), (2, "b", 1)), "k", "at")
    assert store.upsert(rows((1, "c", 2), (3, "d", 2)), "k", "at", spark.createDataFrame([(2,)], "k long"))
    assert {(r.k, r.v) for r in store.read().collect()} == {(1, "c"), (3, "d")}
    assert not store.publish(rows((9, "z", 9)), "gen-of-the-past")


def test_interrupted(spark):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [("p", "a", t(1)), ("p", "a", t(2)), ("p", "b", t(2, 31)), ("q", "c", t(1))]
    df = spark.createDataFrame(rows, "cwd string, session_id string, received_at timestamp")
    assert [r.session_id for r in M.interrupted(df, "cwd", "session_id", "received_at").collect()] == ["a"]


def test_stream_into_store(spark, tmp_path):
    from memloom.streaming.sessions import captured, into_store

    schema = "hook_id long, session_id string, hook_event_name string, prompt string, tool_response string, tool_input string, received_at timestamp"
    rows = [(1, "s", "UserPromptSubmit", "hi", None, None, datetime(2024, 1, 1)), (2, "s", "PostToolUse", None, "Bearer x", None, datetime(2024, 1, 2)), (1, "s", "UserPromptSubmit", "again", None, None, datetime(2024, 1, 3))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    store = M.Store(spark, str(tmp_path / "store"))
    into_store(captured(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), store, str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.hook_id, r.text) for r in store.read().collect()} == {(1, "again"), (2, "[REDACTED]")}
