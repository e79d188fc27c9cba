"""Conversations rebuilt from message rows.

A conversation is all rows of one user_id and session_id (nulls are a value like
any other).  Rows with the same request_id and message_index are one message, the
one with the lowest msg_id.  A row whose role is none of the known ones drops its
conversation; system and tool rows are left out; the rest must have a content
that isn't blank and a usable time.  The messages are ordered topologically by
their reply graph (Kahn's algorithm, ties broken by instant, message_index and
msg_id); messages left over lie on or behind a cycle and drop the conversation.
The roles must start with user, alternate and end with assistant.

Reply edges: ``reply_to`` (msg_id of the message answered) if the rows have such
a column, else the order of the messages of one request that share an instant.
So every message waits for at most one other: the graph is a forest, or has a
cycle.  Without ``reply_to`` all edges follow the order of the ties, so the
topological order is the order of instant, index and id.

A conversation of at most ``GROUP_ROWS`` messages is gathered (without contents)
and ordered by Kahn's algorithm, many conversations a batch.  A larger one would
not fit a task and is ordered across tasks with the same result.  On a forest,
Kahn's algorithm with the smallest key first puts a message where the largest key
on its way from the root is, and among those that share it goes on below that
message; so its place is that of the keys on its way that no later key exceeds,
compared as a list (``_waits``).  The lists are found by pointer doubling, in as
many joins as the logarithm of the longest way; a message that has not come to a
root by then lies on or behind a cycle.  Neither way drops a conversation that the
other keeps.

Edge cases: an empty table gives no rows; a null request_id or message_index
never merges rows; a null msg_id sorts first and can't be replied to; of rows with
the same msg_id in one request and index the least stands; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions.ordered import cut_lineage, keep
from memloom.functions.times import with_utc_micros

#: Messages up to which a conversation is gathered into one array.
GROUP_ROWS = 2_000

# Spellings of the roles.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "system": "system", "tool": "tool"}

def speaker(role: Column) -> Column:
    """The role that a spelling stands for, else null."""
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.try_element_at(names, F.lower(F.regexp_replace(role, r"^\s+|\s+$", "")))


def kahn(nodes: list[tuple], edges: list[tuple[int, int]]) -> list[int]:
    """Positions of ``nodes`` (sort keys) in topological order, the smallest key first; shorter than ``nodes`` on a cycle."""
    after: dict[int, list[int]] = {}
    waits = [0] * len(nodes)
    for a, b in edges:
        after.setdefault(a, []).append(b)
        waits[b] += 1
    ready = [(key, k) for k, key in enumerate(nodes) if not waits[k]]
    heapq.heapify(ready)
    order = []
    while ready:
        _, k = heapq.heappop(ready)
        order.append(k)
        for b in after.get(k, ()):
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, (nodes[b], b))
    return order


def _order(rows: list) -> list[int] | None:
    """Places (in ``rows``, sorted by key) of a conversation's messages in order if it is whole, else null."""
    nodes = [(k,) for k in range(len(rows))]
    place = {r["id"]: k for k, r in enumerate(rows) if r["id"] is not None}
    edges, last = [], {}
    for k, r in enumerate(rows):
        if r["parent"] is not None:
            if r["parent"] in place:
                edges.append((place[r["parent"]], k))
        elif r["request"] is not None:
            group = (r["request"], r["at"])
            if group in last:
                edges.append((last[group], k))
            last[group] = k
    order = kahn(nodes, edges)
    if len(order) < len(rows):
        return None
    users = [rows[k]["user"] for k in order]
    if not users or not users[0] or users[-1] or any(a == b for a, b in zip(users, users[1:], strict=False)):
        return None
    return order


KEY = ["user_id", "session_id"]


def _same(other: str = "_", keys: list[str] = KEY) -> Column:
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"{other}{c}"))
    return on


def _renamed(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in keys})


def turns(messages: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """user_id, session_id, request_id, message_index, turn_no, msg_id, role and utc_us of the kept conversations."""
    linked = "reply_to" in messages.columns
    own = messages.select(
        *KEY, "request_id", "message_index", "msg_id", "timestamp", "tz", speaker(F.col("role")).alias("who"),
        (F.col("reply_to") if linked else F.lit(None)).cast("long").alias("parent"),
        (F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+", "") != "").alias("said"),
    )
    timed = with_utc_micros(own, "timestamp", "tz", "at")
    # Null request or index: the row's own id keeps it apart.
    alone = F.when(F.col("request_id").isNull() | F.col("message_index").isNull(), F.col("msg_id"))
    # Keys, instants and flags, read for the heads and for both ways below.
    once = keep(
        timed.groupBy(*KEY, "request_id", "message_index", alone.alias("_alone"))
        .agg(F.min(F.struct("msg_id", "at", "who", "said", "parent")).alias("m"))
        .select(*KEY, "request_id", F.col("message_index").alias("idx"), F.col("m.msg_id").alias("id"), "m.at", "m.who", "m.said", "m.parent")
    )
    talk = F.coalesce(F.col("who").isin("user", "assistant"), F.lit(False))
    good = F.col("who").isNotNull() & (~talk | (F.col("said") & F.col("at").isNotNull()))
    heads = (
        once.groupBy(*KEY)
        .agg(F.min(good).alias("good"), F.count(F.when(talk, 1)).alias("n"), F.count(F.when(F.col("who") == "user", 1)).alias("users"))
        .where(F.col("good") & (F.col("n") > 0) & (F.col("n") == 2 * F.col("users")))
        .select(*[F.col(c).alias(f"_{c}") for c in KEY], "n")
    )
    said = once.where(talk & F.col("said") & F.col("at").isNotNull())
    small, large = heads.where(F.col("n") <= group_rows), heads.where(F.col("n") > group_rows)
    # Large conversations leave before the rows meet their heads, by a key of its own that AQE may split.
    light = said.join(large.select(F.xxhash64(*[f"_{c}" for c in KEY]).alias("_hash"), *[f"_{c}" for c in KEY]), (F.xxhash64(*KEY) == F.col("_hash")) & _same(), "left_anti")
    kept = [*KEY, "request_id", "idx", "id", "at", "who", "parent"]
    return _small(light.join(small, _same()).select(*kept)).unionByName(_large(said.join(large, _same()).select(*kept), linked))


def rebuild(messages: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """user_id, session_id, turn_no, msg_id, role, content and utc_us of the kept conversations.

    Contents are joined to the ordered messages; they never go through a group.
    """
    keys = [*KEY, "request_id", "message_index", "msg_id"]
    contents = messages.groupBy(*keys).agg(F.max("content").alias("content"))
    joined = turns(messages, group_rows).join(_renamed(contents, keys), F.col("msg_id").eqNullSafe(F.col("_msg_id")) & _same(keys=keys), "left")
    return joined.select(*KEY, "turn_no", "msg_id", "role", "content", "utc_us")


def _small(kept: DataFrame) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ordered(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for groups in it:
            yield pd.Series([_order(list(g)) for g in groups])

    node = F.struct("at", "idx", "id", (F.col("who") == "user").alias("user"), F.col("request_id").alias("request"), "parent")
    # Else the optimizer would run it once to filter and once to show.
    ordered = ordered.asNondeterministic()
    groups = kept.groupBy(*KEY).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    done = groups.withColumn("order", ordered("nodes")).where(F.col("order").isNotNull())
    placed = done.select(*KEY, "nodes", F.posexplode("order").alias("pos", "k")).withColumn("m", F.get("nodes", F.col("k")))
    return placed.select(
        *KEY, F.col("m.request").alias("request_id"), F.col("m.idx").alias("message_index"), (F.col("pos") + 1).alias("turn_no"), F.col("m.id").alias("msg_id"),
        F.when(F.col("m.user"), "user").otherwise("assistant").alias("role"), F.col("m.at").alias("utc_us"),
    )


def _waits(kept: DataFrame) -> DataFrame:
    """``kept`` with ``place``: the keys on each message's way from its root that no later one exceeds; cycles drop their conversation.

    Only conversations with an edge against the order of keys are walked; elsewhere
    the own key is the place.
    """
    key = F.struct("at", "idx", "id")
    chain = Window.partitionBy(*KEY, "request_id", "at").orderBy("idx", "id")
    free = kept.where(F.col("parent").isNull() & F.col("request_id").isNotNull()).withColumn("_up", F.lag(key).over(chain))
    rest = kept.where(F.col("parent").isNull() & F.col("request_id").isNull()).withColumn("_up", F.lit(None).cast(free.schema["_up"].dataType))
    ids = kept.where(F.col("id").isNotNull()).select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("id").alias("_id"), key.alias("_up"))
    bound = kept.where(F.col("parent").isNotNull()).join(ids, (F.col("parent") == F.col("_id")) & _same(), "left").select(*kept.columns, "_up")
    edges = cut_lineage(free.unionByName(rest).unionByName(bound).withColumn("_key", key))
    back = edges.where(F.col("_up") >= F.col("_key")).select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    straight = edges.join(back, _same(), "left_anti").withColumn("place", F.array("_key"))
    way = cut_lineage(edges.join(back, _same(), "left_semi").withColumn("place", F.array("_key")))
    rounds = max(1, math.ceil(math.log2(max(2, way.count()))) + 1)
    for _ in range(rounds):
        if way.where(F.col("_up").isNotNull()).isEmpty():
            break
        above = way.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("_key").alias("_k"), F.col("_up").alias("_next"), F.col("place").alias("_above"))
        joined = way.join(above, (F.col("_up") == F.col("_k")) & _same(), "left")
        longer = F.when(F.col("_above").isNull(), F.col("place")).otherwise(
            F.concat(F.filter("_above", lambda k: k > F.get(F.col("place"), 0)), F.col("place"))
        )
        way = cut_lineage(joined.select(*kept.columns, "_key", F.col("_next").alias("_up"), longer.alias("place")))
    cyclic = way.where(F.col("_up").isNotNull()).select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    return straight.select(*kept.columns, "place").unionByName(way.join(cyclic, _same(), "left_anti").select(*kept.columns, "place"))


def _large(kept: DataFrame, linked: bool) -> DataFrame:
    """The same for conversations of any size: a sort across tasks, then runs of (task, conversation) put together."""
    order = ["place"] if linked else ["at", "idx", "id"]
    sorted_ = (_waits(kept) if linked else kept).repartitionByRange(*[F.col(c) for c in (*KEY, *order)])
    placed = keep(sorted_.withColumn("_task", F.spark_partition_id()))  # read twice: the ranges of a second sampling could differ
    run = Window.partitionBy("_task", *KEY).orderBy(*order)
    rows = placed.withColumn("_rn", F.row_number().over(run)).withColumn("_same", F.coalesce(F.lag("who").over(run) == F.col("who"), F.lit(False)))
    runs = rows.groupBy("_task", *KEY).agg(
        F.count("*").alias("_size"), F.max("_same").alias("_same"), F.min_by("who", "_rn").alias("_first"), F.max_by("who", "_rn").alias("_last")
    )
    # A run is a task's part of a conversation: as many rows as tasks.
    chain = Window.partitionBy(*KEY).orderBy("_task")
    linked_runs = runs.withColumn("_before", F.sum("_size").over(chain.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_prior", F.lag("_last").over(chain))
    bad = (
        F.col("_same")
        | (F.col("_prior").isNull() & (F.col("_first") != "user"))
        | F.coalesce(F.col("_prior") == F.col("_first"), F.lit(False))
        | (F.lead("_task").over(chain).isNull() & (F.col("_last") != "assistant"))
    )
    whole = linked_runs.withColumn("_bad", bad).withColumn("_drop", F.max("_bad").over(Window.partitionBy(*KEY))).where(~F.col("_drop"))
    offsets = whole.select(F.col("_task").alias("_t"), *[F.col(c).alias(f"_{c}") for c in KEY], F.coalesce("_before", F.lit(0)).alias("_offset"))
    return rows.join(offsets, (F.col("_task") == F.col("_t")) & _same()).select(
        *KEY, "request_id", F.col("idx").alias("message_index"), (F.col("_rn") + F.col("_offset")).cast("int").alias("turn_no"), F.col("id").alias("msg_id"),
        F.col("who").alias("role"), F.col("at").alias("utc_us"),
    )
