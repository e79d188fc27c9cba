"""Checks of size before rows are gathered or dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side may be sent to every executor.
BROADCAST_ROWS = 200_000


def within(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than that and one."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread_out(df: DataFrame, per_core: int = 3) -> DataFrame:
    """``df`` in at least ``per_core`` partitions a core, for costly work on each row.

    A scan of many files already has more than that and stays as it is; only a
    small or badly split input is dealt out again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    has = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if has >= cores else df.repartition(cores * per_core)
