"""Queries give all their rows: no cut before the last step."""

from datetime import datetime

from memloom.operators import evaluate as E
from memloom.operators import rank as R
from memloom.plans import memory_queries as P
from memloom.plans import rank_queries as K
from memloom.plans import segmented_queries as S


def _write(spark, at, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


def test_semi_join_sees_all_postings(spark, tmp_path):
    # 600 earlier pages hold the word too; a cap of 500 a key would leave none of runbooks
    paths = [f"archive/{n:04d}.md" for n in range(600)] + ["runbooks/a.md", "runbooks/b.md"]
    d = _write(
        spark, tmp_path,
        chunk_nodes=([(f"c{n}", p, "", "index") for n, p in enumerate(paths)], "chunk_id string, doc_rel_path string, heading string, content string"),
        pages=([(p,) for p in paths], "rel_path string"),
        smoke_longmemeval=([("q", "index")], "question_id string, question string"),
    )
    assert [tuple(r) for r in K.multi_query_filter(spark, d).collect()] == [("q", 2, 1.6)]
    assert K.postings(spark, d).count() == 500


def _pages(spark, at, rows):
    """pages of (rel_path, concept, content)."""
    schema = "rel_path string, concept string, content string, headings array<string>, links array<string>, scanned_at timestamp"
    return _write(spark, at, pages=([(p, c, t, ["Index"], [], datetime(2024, 5, 9)) for p, c, t in rows], schema))


def test_ranker_has_all_postings(spark, tmp_path):
    d = _pages(spark, tmp_path, [(f"docs/{n:04d}.md", "same", "alpha beta gamma") for n in range(502)])
    _, post, ents, _ = K.corpus(spark, d)
    assert post.where("key = 'index'").count() == 502 and ents.where("key = 'same'").count() == 502


def test_preferred_of_every_session(spark, tmp_path):
    rows = [(n, "u", f"s{n // 2}", "assistant" if n % 2 == 0 else "user", datetime(2024, 1, 1)) for n in range(2400)]
    d = _write(spark, tmp_path, messages=(rows, "msg_id long, user_id string, session_id string, role string, ingested_at timestamp"))
    got = P.preferred(spark, d).collect()
    assert {(r.session_id, r.doc_id) for r in got} == {(f"u/s{n}", 2 * n) for n in range(1200)} and len(got) == 1200


def test_preferred_first_sessions_of_each_query(spark):
    rows = [(q, f"s{n}", 10 * n, "other", 1, n) for q in ("a", "b") for n in range(7)]
    m = spark.createDataFrame(rows, "query_id string, session_id string, doc_id int, kind string, at int, rank int")
    assert sorted((r.query_id, r.rank) for r in E.preferred_documents(m).collect()) == [(q, n) for q in ("a", "b") for n in range(5)]
    assert E.preferred_documents(m.where("query_id = 'a'").drop("query_id")).count() == 5


def test_groups_of_all_scored_documents(spark, tmp_path):
    # 60 documents of x before the ones of y and z
    docs = [(n, "x", "alpha " * 3) for n in range(60)] + [(100, "y", "alpha beta"), (101, "y", "alpha beta gamma"), (102, "y", "alpha beta gamma delta"), (103, "z", "alpha beta gamma delta epsilon")]
    d = _write(spark, tmp_path, documents=(docs, "doc_id long, source string, text string"), eval_items=([("i", "alpha")], "item_id string, text string"))
    got = [(r.group_id, r.doc_id) for r in K.bm25_grouped(spark, d).orderBy("rank").collect()]
    assert got == [("x", 0), ("x", 1), ("y", 100), ("y", 101), ("z", 103)]


def test_overlap_reads_the_whole_page(spark, tmp_path):
    from memloom.operators import index as I
    from memloom.operators import rank as R

    d = _pages(spark, tmp_path, [("docs/a.md", "topic", "filler " * 900 + "zebra"), ("docs/b.md", "other", "filler")])
    q = spark.createDataFrame([("q", "zebra topic", ["zebra", "topic", "absent", "index"], None, None)], "query_id string, norm string, terms array<string>, intent string, target date")
    got = {r.doc_id: r.overlap for r in R.hybrid(q, I.of_corpus(*K.corpus(spark, d))).collect()}
    # the last word of the page, its topic and its heading
    assert abs(got["docs/a.md"] - 0.08 * 3 / 4) < 1e-9 and abs(got["docs/b.md"] - 0.08 / 4) < 1e-9


def test_segment_terms_of_any_length(spark, tmp_path):
    weights = "map<string,double>"
    d = _write(
        spark, tmp_path,
        segment_profiles=([("s", {"clean-context window": 1.0}, {}, {}, {})], f"segment_id string, terms {weights}, entities {weights}, topics {weights}, local_memory {weights}"),
        smoke_longmemeval=([("q", "clean context window today"), ("r", "clean"), ("n", "")], "question_id string, question string"),
    )
    assert {(r.query_id, r.term) for r in P.segment_queries(spark, d).collect()} == {
        ("q", t) for t in ("clean", "context", "window", "today", "clean context", "context window", "window today", "clean context window", "context window today")
    } | {("r", "clean")}
    for how in ("sparse", "local", "coverage", "kl"):
        assert [(r.query_id, r.segment_id, r.covered) for r in P.router(how)(spark, d).collect()] == [("q", "s", 1)]


def test_target_day_orders_again(spark, tmp_path):
    d = _pages(spark, tmp_path, [("docs/a.md", "one", "zebra zebra zebra"), ("notes/b.md", "two", "zebra padding padding")])
    _write(spark, tmp_path, smoke_longmemeval=([("q", "zebra yesterday", datetime(2024, 5, 10)), ("r", "zebra", datetime(2024, 5, 10))], "question_id string, question string, ingested_at timestamp"))
    assert {r.query_id: r.target and r.target.day for r in K.questions(spark, d).collect()} == {"q": 9, "r": None}
    got = K.hybrid(spark, d).collect()
    assert {(r.query_id, r.time) for r in got} == {("q", 0.45), ("r", 0.0)}
    of_q = sorted((r for r in got if r.query_id == "q"), key=lambda r: r["rank"])
    assert [r.score for r in of_q] == sorted((r.score for r in of_q), reverse=True)


def test_group_bonuses(spark):
    from pyspark.sql import functions as F

    from memloom.operators import rank as R

    schema = "query_id string, group string, doc_id int, score double, q array<string>, norm string, matched_entities array<string>, matched_terms array<string>, day date"
    rows = [("q", "g", 1, 1.0, ["a"], "a", ["a"], ["t", "u"], datetime(2024, 5, 1).date()), ("q", "g", 2, 0.5, ["a"], "a", ["b"], ["t"], datetime(2024, 5, 4).date())]
    got = R.group_score(spark.createDataFrame(rows, schema), F.lit(False)).first().group_score
    assert abs(got - (1.0 + 0.15 + 0.05 + 0.10 + 0.08 + 0.08 + 0.03 + 0.06 + 0.08)) < 1e-9


def _haystacks(spark, at, n):
    """``n`` questions with the same words, each with a haystack of two sessions of its own."""
    turns = [[("user", "alpha beta"), ("assistant", "gamma alpha")], [("user", "beta beta gamma")]]
    rows = [(f"q{k}", "beta gamma", "one" if k % 2 else None, [f"a{k}"], [f"a{k}", f"b{k}"], turns) for k in range(n)]
    schema = "question_id string, question string, question_type string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string>>>"
    return _write(spark, at, smoke_longmemeval=(rows, schema))


def test_bm25_of_haystacks_forms_their_own_pairs(spark, tmp_path):
    d = _haystacks(spark, tmp_path, 6)
    scores = S.haystack_scores(spark, d)
    assert {r.doc_id for r in scores.where("query_id = 'q3'").collect()} == {"a3::turn0", "a3::turn1", "b3::turn0"}
    q = S.question_words(spark, d).withColumnRenamed("term", "token")
    docs = P.turns(spark, d).groupBy("doc_id").agg({"text": "max"}).withColumnRenamed("max(text)", "text")
    every = R.bm25(R.field_tokens(docs, {"content": K.words("text")}), q, docs.selectExpr("count(*) n"), {"content": 1.0})
    key = lambda df: {(r.query_id, r.doc_id): round(r.score, 6) for r in df.collect()}
    whole, own = key(every), key(scores)
    assert len(whole) == 108 and len(own) == 18 and all(whole[k] == v for k, v in own.items())
    # No join of words alone: a question meets the turns of its haystack only.
    assert "[query_id" in "".join(x for x in scores._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "query_id" in x and "token" in x)


def test_means_read_the_measures_once(spark):
    metrics = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 0.5)], "query_id string, mrr double").repartition(2)
    types = spark.createDataFrame([("a", "all"), ("b", None)], "query_id string, question_type string")
    means = E.mean_metrics(metrics, types)
    assert sorted((r.question_type, r.queries, r.mrr) for r in means.collect()) == [("all", 1, 1.0), ("all", 3, 0.5), ("unknown", 2, 0.25)]
    assert means._jdf.queryExecution().optimizedPlan().toString().count("Repartition 2") == 1


def test_shared_terms_of_own_haystacks(spark, tmp_path):
    d = _haystacks(spark, tmp_path, 3)
    assert {r.query_id: r.terms for r in S.shared_session_terms(spark, d).collect()} == dict.fromkeys(("q0", "q1", "q2"), "beta,gamma,user")
    # Each word of a turn is dealt out once.
    assert "array_distinct" in S.shared_session_terms(spark, d)._jdf.queryExecution().optimizedPlan().toString()
