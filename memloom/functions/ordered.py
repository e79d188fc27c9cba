"""Neighbours in a total order without gathering all rows in one task, checkpoints and tables kept for several reads."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder that the session names in ``spark.checkpoint.dir``.

    A folder is only made here for a local session that names none; on a cluster
    that is an error, since the executors would not share it.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="memloom-"))
    return df.checkpoint()


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """``df`` persisted (a lost block is computed again) until ``release`` is called."""
    _KEPT.append(df.persist())
    return _KEPT[-1]


def release() -> int:
    """Free what the library's queries have persisted so far; call it once their results are written. Gives the number of tables freed."""
    n = len(_KEPT)
    while _KEPT:
        _KEPT.pop().unpersist()
    return n


def with_next(df: DataFrame, order: list[str], columns: list[str], prefix: str = "next_") -> DataFrame:
    """``df`` with ``columns`` of the following row in the order ``order`` (which must be total).

    Rows are sorted across tasks; each task looks ahead within its own range, and
    only the first row of every range (as many as tasks) is passed on.
    """
    # Kept, since the ranges of a second sampling could differ from the first.
    placed = keep(df.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()))
    state = F.struct(*dict.fromkeys([*order, *columns]))
    within = Window.partitionBy("_task").orderBy(*order)
    rows = placed.withColumn("_next", F.lead(state).over(within))
    firsts = placed.groupBy("_task").agg(F.min(state).alias("_first"))
    following = firsts.select((F.lead("_first").over(Window.orderBy("_task"))).alias("_after"), "_task")
    out = rows.join(F.broadcast(following), "_task").withColumn("_next", F.coalesce("_next", "_after"))
    return out.select(*df.columns, *[F.col(f"_next.{c}").alias(f"{prefix}{c}") for c in columns])


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the row number ``out`` (from 1) within ``keys`` in the order ``order`` (total within a key).

    Rows are sorted across tasks by key and order, so that a key of any size is
    spread over tasks; each task numbers its own rows, and only the count of every
    (task, key) is passed on.
    """
    # Kept, since the ranges of a second sampling could differ from the first.
    placed = keep(df.repartitionByRange(*keys, *order).withColumn("_task", F.spark_partition_id()))
    sizes = placed.groupBy("_task", *keys).agg(F.count("*").alias("_size"))
    # A row for each key of a task: the keys that span tasks are at most as many as tasks.
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.sum("_size").over(before)).where(F.col("_offset").isNotNull())
    later = offsets.select(F.col("_task").alias("_t"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_offset")
    on = F.col("_task") == F.col("_t")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_task", *keys).orderBy(*order)))
    # Offsets are a row for each task that a key goes on into: fewer than tasks.
    done = rows.join(F.broadcast(later), on, "left")
    return done.select(*df.columns, (F.col("_rn") + F.coalesce("_offset", F.lit(0))).cast("int").alias(out))
