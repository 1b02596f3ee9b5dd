"""Top rows of groups, sessions and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import free_name


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their `rank` (`_rank` where that name is taken); Spark keeps k rows a group before the shuffle (WindowGroupLimit)."""
    rank = free_name("rank", df.columns)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def sessions(events: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """events with `session` (`_session` where that name is taken), numbered from 0 for each key: a pause of more than the gap starts the next. Rows at one time are in one session; a null time belongs to the first."""
    order = Window.partitionBy(by).orderBy(at)
    pause = F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(order).cast("timestamp"))
    return events.withColumn(free_name("session", events.columns), F.sum((F.coalesce(pause, F.lit(0)) > gap_seconds).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
