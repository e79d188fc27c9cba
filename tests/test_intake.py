import json

from pyspark.sql import functions as F

from memloom.operators import intake as I


def test_problems(spark):
    rows = [("r", "u", "user", "x"), ("r", None, "user", "x"), ("r\n", "u", "user", "x"), ("r", "u", None, "x"), ("r", "u", "user", " "), ("r" * 300, "u", "user", "x")]
    df = spark.createDataFrame(rows, "r string, u string, o string, c string").select(I.problems(F.col("r"), F.col("u"), F.col("o"), F.col("c")).alias("p"))
    assert [r.p for r in df.collect()] == [None, "user_id", "request_id", "role", "content", "request_id"]


def test_changed(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "k int, v string, w int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, None, None)], "k int, v string, w int")
    assert sorted(r.k for r in I.changed(old, new, "k", ["v", "w"]).collect()) == [2, 3]


def test_bounded_json(spark):
    text = json.dumps({"password": "x", "a": ["y"] * 200, "b": "z" * 9000, "c": "Bearer q"})
    rows = spark.createDataFrame([(0, text), (1, "not json"), (2, None)], "k int, t string").select("k", I.bounded_json(F.col("t")).alias("j")).orderBy("k").collect()
    value = json.loads(rows[0].j)
    assert value["password"] == value["c"] == "[REDACTED]" and len(value["a"]) == 128 and len(value["b"].encode()) <= 8192 + 3
    assert json.loads(rows[1].j) == "not json" and rows[2].j is None


def test_common_run(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "x", "c"]), ([], ["a"])], "a array<string>, b array<string>").select(I.common_run(F.col("a"), F.col("b")).alias("r"))
    assert [round(r.r, 4) for r in df.collect()] == [0.6667, 0.0]
