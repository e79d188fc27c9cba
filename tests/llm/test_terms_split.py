import math

from hypothesis import given, settings
from hypothesis import strategies as st

from memloom.llm import queries, split, terms


def llr(a, b, c, d):
    n = a + b + c + d
    part = lambda k, r, s: k * math.log(k * n / (r * s)) if k else 0.0
    g = 2 * (part(a, a + b, a + c) + part(b, a + b, b + d) + part(c, c + d, a + c) + part(d, c + d, b + d))
    return g if a * (c + d) >= c * (a + b) else -g


def test_scores_against_brute_force(spark):
    counts = {("k", "r1", "x"): 5.0, ("k", "r1", "the"): 10.0, ("k", "r2", "the"): 20.0, ("k", "r2", "y"): 1.0, ("k", "r3", "x"): 1.0, ("k", "r3", "the"): 30.0}
    df = spark.createDataFrame([(*k, n) for k, n in counts.items()], "record_kind string, record_key string, term string, n double")
    total = sum(counts.values())
    for r in terms.distinctive_terms(df).collect():
        own = sum(n for (_, k, _), n in counts.items() if k == r.record_key)
        all_ = sum(n for (_, _, t), n in counts.items() if t == r.term)
        assert abs(r.llr - llr(r.n, own - r.n, all_ - r.n, total - own - all_ + r.n)) < 1e-6
    assert {r.term for r in terms.distinctive_terms(df, 2, 2).collect()} == {"x"}


def test_one_record_and_empty(spark):
    one = spark.createDataFrame([("k", "r", "x", 2.0)], "record_kind string, record_key string, term string, n double")
    assert terms.distinctive_terms(one).first().llr == 0.0 and terms.distinctive_terms(one.limit(0)).count() == 0


def test_segment_terms(spark):
    rows = [("s", {" Big_Cache": 1.0, "big-cache": 2.0, "zero": 0.0, "none": None}, "x"), ("s", {" Big_Cache": 1.0}, "x"), (None, {"a": 1.0}, "x"), ("t", None, "x")]
    got = terms.segment_terms(spark.createDataFrame(rows, "segment_id string, terms map<string,double>, n string")).collect()
    assert [(r.record_key, r.term, r.n) for r in got] == [("s", "big cache", 2.0)]


def test_page_words(spark):
    rows = [("p", "Router_router ROUTER1 naïves straße123 Planet"), ("p", "Router_router ROUTER1 naïves straße123 Planet"), ("q", None), ("r", "")]
    got = terms.page_words(spark.createDataFrame(rows, "rel_path string, content string")).collect()
    assert {(r.record_key, r.term, r.n) for r in got} == {("p", "router", 2.0), ("p", "planet", 1.0)}


def test_found_terms_need_no_score(spark, tmp_path):
    weights = [("r1", {"x": 1.0, "y": 2.0, "zero": 0.0}), ("r2", {"X_": 3.0, "zero": None}), ("r2", {"-x": 1.0}), (None, {"y": 1.0}), ("r3", None)]
    spark.createDataFrame(weights, "segment_id string, terms map<string,double>").write.parquet(str(tmp_path / "segment_profiles.parquet"))
    texts = [(f"p{k}", "nobody everyone " * (k < 8) + "everyone Planet planet" * (k < 2) + f" everyone single{'abcdefghi'[k]}") for k in range(9)]
    texts += [texts[0], ("p0", "second scanned"), ("p1", "Second"), ("p1", None), (None, "scanned")]
    spark.createDataFrame(texts, "rel_path string, content string").write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.p1_found(spark, str(tmp_path))
    want = [("segment", r, "x") for r in ("r1", "r2")] + [("page", p, t) for t in ("planet", "second") for p in ("p0", "p1")] + [("page", f"p{k}", "nobody") for k in range(8)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # Terms meet the number of their records and nothing else: no sums of records or kinds, no texts in an aggregation.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "first(" not in plan


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r,#é́", max_size=400), st.integers(2, 60), st.integers(0, 20))
def test_pieces_hold_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = split.split_text(text, limit, overlap)
    assert all(len(p["text"]) <= limit for p in pieces)
    assert "".join(p["text"] if k == 0 else p["text"][_end(pieces, k - 1) - p["start_char"] :] for k, p in enumerate(pieces)) == text
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert b["start_char"] <= _end(pieces, a["piece_no"]) and text[b["start_char"] : b["start_char"] + len(b["text"])] == b["text"]
    for p in pieces:
        assert p["start_line"] == 1 + _breaks(text[: p["start_char"]], text)


def _end(pieces, k):
    return pieces[k]["start_char"] + len(pieces[k]["text"])


def _breaks(head, text):
    import re

    return sum(1 for m in re.finditer("\r\n|\n|\r", text) if m.end() <= len(head))


def test_cuts_follow_boundaries():
    text = "# One\n" + "word " * 30 + "end.\n\n# Two\n" + "word " * 30
    pieces = split.split_text(text, 200, 0)
    assert len(pieces) == 2 and pieces[1]["text"].startswith("# Two") and pieces[1]["start_line"] == 4
    assert [len(p["text"]) for p in split.split_text("x" * 100, 30, 5)] and max(len(p["text"]) for p in split.split_text("x" * 100, 30, 5)) <= 30


def test_split_records(spark):
    limits = spark.createDataFrame([("page", 20, 4)], "record_kind string, max_chars int, overlap_chars int")
    rows = [("page", "a", "one two three four five six seven", 9, 3), ("page", "a", "one two three four five six seven", 9, 3), ("page", "b", "short", None, None), ("page", "c", None, 1, 1), ("page", "d", "", None, 5), ("page", "e", "line\n" * 10, None, 20), ("other", "f", "x" * 99, 1, 1)]
    df = spark.createDataFrame(rows, "record_kind string, record_key string, content string, start_line int, end_line int")
    out = split.split_oversized(df, limits).orderBy("record_key", "piece_no").collect()
    assert {r.record_key for r in out} == {"a", "b", "d", "e"} and len({(r.record_key, r.piece_no) for r in out}) == len(out)
    assert [r.start_line for r in out if r.record_key == "a"][0] == 3 and [r.start_line for r in out if r.record_key == "e"][0] == 10
    assert split.split_oversized(df.limit(0), limits).count() == 0
