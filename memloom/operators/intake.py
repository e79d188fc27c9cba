"""What comes in: validation, scoping, change detection, bounded JSON and lexicons."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.store import CREDENTIALS

ID_BYTES, STRING_BYTES, ITEMS = 256, 8_192, 128
_SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "credential", "private_key", "access_key", "cookie")


def problems(request_id: Column, user_id: Column, role: Column, content: Column) -> Column:
    """What is wrong with a message, first fault first; null if nothing is."""
    bad = lambda c: c.isNull() | (F.trim(c) == "") | (F.octet_length(c) > ID_BYTES) | c.rlike(r"[\x00-\x1f\x7f]")
    return (
        F.when(bad(user_id), "user_id").when(bad(request_id), "request_id").when(~F.coalesce(role.isin("user", "assistant"), F.lit(False)), "role")
        .when(F.coalesce(F.trim(content), F.lit("")) == "", "content")
    )


def in_scope(path: Column, ignore: list[str], prefix: str = "") -> Column:
    """Paths under ``prefix`` that hold none of the ignored parts."""
    ok = F.startswith(path, F.lit(prefix))
    for part in ignore:
        ok = ok & ~F.contains(path, F.lit(part))
    return ok


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks or has with another value; nulls are equal to nulls."""
    state = lambda df, name: df.select(F.col(key).alias(name), F.struct(*columns).alias("_s"))
    before = state(old, "_k")
    fresh = new.withColumn("_n", F.struct(*columns))
    return fresh.join(before, (F.col(key) == F.col("_k")) & F.col("_n").eqNullSafe(F.col("_s")), "left_anti").drop("_n")


def top_relations(relations: DataFrame, keep: int = 12) -> DataFrame:
    """Of (source, target, confidence): the highest confidence of a pair, and the ``keep`` best targets of a source."""
    best = relations.where(F.col("source") != F.col("target")).groupBy("source", "target").agg(F.max("confidence").alias("confidence"))
    order = Window.partitionBy("source").orderBy(F.desc("confidence"), "target")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def memories(events: DataFrame, text: str, at: str, limit: int = 50, preview: int = 2_000) -> DataFrame:
    """The newest recorded texts with a preview; the limit is the feature."""
    rows = events.where(F.trim(text) != "").select("session_id", "hook_id", at, F.substring(text, 1, preview).alias("preview")).distinct()
    return rows.orderBy(F.desc(at), F.desc("hook_id")).limit(limit)


def _bounded(value: object, key: str = "", depth: int = 0) -> object:
    if any(s in key.lower() for s in _SENSITIVE) and not isinstance(value, (dict, list)):
        return "[REDACTED]"
    if isinstance(value, dict):
        return {k: _bounded(v, k, depth + 1) for k, v in list(value.items())[:ITEMS]} if depth < 64 else "…"
    if isinstance(value, list):
        return [_bounded(v, key, depth + 1) for v in value[:ITEMS]] if depth < 64 else "…"
    if isinstance(value, str):
        if "Bearer " in value or "-----BEGIN " in value or any(w.startswith(p) and len(w) >= len(p) + 8 for w in value.split() for p in CREDENTIALS):
            return "[REDACTED]"
        raw = value.encode()
        return value if len(raw) <= STRING_BYTES else raw[:STRING_BYTES].decode(errors="ignore").rstrip() + "…"
    return value


def bounded_json(payload: Column) -> Column:
    """JSON with secrets replaced and long strings and lists cut; texts that aren't JSON become a bounded JSON string."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str) -> str:
            try:
                value = json.loads(text)
            except ValueError:
                value = text
            return json.dumps(_bounded(value), ensure_ascii=False)

        for part in it:
            yield part.map(one, na_action="ignore")

    return run(payload)


def common_run(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of words over the length of the first."""

    @F.pandas_udf("double")
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        def one(x: list, y: list) -> float:
            if x is None or y is None or not len(x):
                return 0.0
            row = [0] * (len(y) + 1)
            for w in x:
                last = 0
                for j, v in enumerate(y, 1):
                    last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
            return row[-1] / len(x)

        return pd.Series([one(x, y) for x, y in zip(first, second, strict=True)])

    return run(a, b)
