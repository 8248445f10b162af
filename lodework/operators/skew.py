"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least this part of the rows, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 1000


def join_stats(rows: DataFrame, stats: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join of rows with one statistic row per key.

    stats holds, per key, in count_col how many of the rows carry it. Keys with at least total / HOT_PARTS rows (there
    can be at most HOT_PARTS of them, whatever the size of the data) are joined by broadcast, so their rows never meet
    in one task; the remaining keys are joined by a shuffle in which no key exceeds total / HOT_PARTS rows.
    """
    floor = max(1.0, total / HOT_PARTS)
    hot = stats.where(F.col(count_col) >= floor)
    cold = stats.where(F.col(count_col) < floor)
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__hot"))), keys, "left")
    on_hot = marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot), keys)
    on_cold = marked.where(F.col("__hot").isNull()).drop("__hot").join(cold, keys)
    return on_hot.unionByName(on_cold)
