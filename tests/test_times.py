from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memloom.functions.times import with_utc_micros


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-05-01T10:00:00Z", None, us(2024, 5, 1, 10)),
    (" 2024-05-01 10:00:00+0200 ", "Asia/Tokyo", us(2024, 5, 1, 8)),
    ("2024-05-01T10:00:00.123456789-05:00", None, us(2024, 5, 1, 15, micro=123456)),
    ("20240501T100000Z", None, us(2024, 5, 1, 10)),
    ("20240501T100000", "Asia/Tokyo", us(2024, 5, 1, 1)),
    ("2024/05/01 (Wed) 10:05", None, us(2024, 5, 1, 10, 5)),
    ("05/01/2024 1:05 PM", None, us(2024, 5, 1, 13, 5)),
    ("05/01/2024 12:05 AM", None, us(2024, 5, 1, 0, 5)),
    ("01.05.2024 10:05", None, us(2024, 5, 1, 10, 5)),
    ("1 May 2024, 10:05:06", None, us(2024, 5, 1, 10, 5, 6)),
    ("May 1, 2024", "Europe/Berlin", us(2024, 4, 30, 22)),
    ("Wed, 1 May 2024 10:00:00 +0545", None, us(2024, 5, 1, 4, 15)),
    ("2024-05-01 10:00:00 EST", "Asia/Tokyo", us(2024, 5, 1, 15)),
    ("2024-05-01 10:00:00 CEST", None, us(2024, 5, 1, 8)),
    ("1714557600", None, us(2024, 5, 1, 10)),
    ("1714557600123", None, us(2024, 5, 1, 10, micro=123000)),
    ("1714557600123456", None, us(2024, 5, 1, 10, micro=123456)),
    # a wall time that occurs twice: the earlier; one that is skipped: the offset before
    ("2024-10-27 02:30:00", "Europe/Berlin", us(2024, 10, 27, 0, 30)),
    ("2024-03-31 02:30:00", "Europe/Berlin", us(2024, 3, 31, 1, 30)),
    ("2024-05-01", "Nowhere/Land", us(2024, 5, 1)),
    ("2024-05-01", " ", us(2024, 5, 1)),
    ("0000000001", None, None),
    ("2025-02-30T08:00:00Z", None, None),
    ("2024-05-01 25:00:00", None, None),
    ("13/13/2024", None, None),
    ("05/01/2024 13:05 PM", None, None),
    ("2024-05-01 10:00:00 XYZ", None, None),
    ("25:61", None, None),
    ("soon", None, None),
    ("", None, None),
    (None, None, None),
    ("x" * 50_000, None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(k, r, z) for k, (r, z, _) in enumerate(CASES)], "k int, raw string, tz string")
    got = {r["k"]: r["us"] for r in with_utc_micros(df, "raw", "tz", "us").collect()}
    assert [(CASES[k][0], got[k]) for k in range(len(CASES))] == [(r, e) for r, _, e in CASES]


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "raw string, tz string, other int")
    out = with_utc_micros(df, "raw", "tz", "us")
    assert out.columns == ["raw", "tz", "other", "us"] and out.count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1_580_000_000, 1_880_000_000), st.sampled_from(["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney"])), min_size=1, max_size=30))
def test_against_zoneinfo(spark, cases):
    rows, expected = [], []
    for k, (t, zone) in enumerate(cases):
        wall = datetime.fromtimestamp(t, ZoneInfo(zone)).replace(tzinfo=None)
        rows.append((k, wall.strftime("%Y-%m-%d %H:%M:%S"), zone))
        expected.append(int((wall.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)))
    df = spark.createDataFrame(rows, "k int, raw string, tz string")
    got = with_utc_micros(df, "raw", "tz", "us").orderBy("k").select(F.col("us")).collect()
    assert [r["us"] for r in got] == expected


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_session_zone_does_not_matter(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2024-05-01 10:00:00", "Asia/Tokyo")], "raw string, tz string")
        assert with_utc_micros(df, "raw", "tz", "us").first()["us"] == us(2024, 5, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
