from datetime import date

import pytest
from pyspark.sql import functions as F

from memloom.operators import questions as Q
from memloom.operators import segments as S
from memloom.sources import markdown as D

FRIDAY = date(2024, 5, 10)


@pytest.mark.parametrize(
    ("text", "day"),
    [("what happened yesterday", date(2024, 5, 9)), ("two weeks ago", date(2024, 4, 26)), ("in 3 days", date(2024, 5, 13)), ("last month", date(2024, 4, 10)), ("last friday", date(2024, 5, 3)), ("on monday", date(2024, 5, 6)), ("on 2024-01-02", date(2024, 1, 2)), ("next week", date(2024, 5, 17)), ("one month ago", date(2024, 4, 10))],
)
def test_relative_days(text, day):
    assert Q.relative_day(text, FRIDAY)[0] == day


def test_no_day():
    assert Q.relative_day("nothing here", FRIDAY) is None and Q.relative_day(None, FRIDAY) is None and Q.relative_day("today", None) is None
    assert Q._months(date(2024, 3, 31), -1) == date(2024, 2, 29)


def test_numbers():
    assert Q.digits("I led twenty-three projects and two hundred and five tasks") == "I led 23 projects and 205 tasks" and Q.digits("one million") == "1000000"


def test_analyse(spark):
    df = spark.createDataFrame([("two days ago", FRIDAY), (None, FRIDAY), ("x", None)], "q string, t date")
    rows = df.select(Q.analyse(F.col("q"), F.col("t")).alias("a")).select("a.*").collect()
    assert [(r.normalized, r.target) for r in rows] == [("2 days ago", date(2024, 5, 8)), (None, None), ("x", None)]


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("---\nauthor: me\ntopic: t: u\nauthor: you\n---\n# Head\nsee [[wiki|w]] and [l](b.md#c)")
    (tmp_path / "big.md").write_text("y" * 5000)
    (tmp_path / "no.txt").write_text("z")
    out = D.read_tree(spark, str(tmp_path), max_bytes=1000)
    row = out.select(D.front_matter(F.col("content")).alias("m"), D.headings(F.col("content")).alias("h"), D.link_targets(F.col("content")).alias("l")).collect()
    assert len(row) == 1 and row[0].m == {"author": "you", "topic": "t: u"} and row[0].h == ["Head"] and row[0].l == ["wiki", "b.md#c"]


def test_transcript_and_usage(spark, tmp_path):
    lines = ['{"role": "user", "content": "hi"}', '{"message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "text": "b"}]}}', "broken", '{"role": "user", "content": ""}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    assert [(r.role, r.text) for r in D.transcript_tail(spark, str(tmp_path / "t.jsonl")).collect()] == [("user", "hi"), ("assistant", "a")]
    u = spark.createDataFrame([('{"usage": {"prompt_tokens": 3, "completion_tokens": 4}}',), ("x",), (None,)], "p string").select(D.token_usage(F.col("p")).alias("u")).collect()
    assert (u[0].u.input, u[0].u.output, u[0].u.total) == (3, 4, 7) and u[1].u.total == 0


def test_local_memory():
    m = S.local_memory([[("term", "a"), ("entity", "b")], [("term", "a")]])
    assert abs(sum(m.values()) - 1) < 1e-9 and m["a"] > m["b"]
    assert S.local_memory([]) == {}


def test_temporal_boost(spark):
    routes = spark.createDataFrame([("q", "s", 1.0), ("q", "t", 1.0)], "query_id string, segment_id string, score double")
    days = spark.createDataFrame([("s", FRIDAY)], "segment_id string, day date")
    got = {r.segment_id: r.score for r in S.temporal_boost(routes, days, spark.createDataFrame([("q", FRIDAY)], "query_id string, target date")).collect()}
    assert got == {"s": 2.25, "t": 1.0}
