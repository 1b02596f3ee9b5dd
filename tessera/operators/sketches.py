"""Sketches that are made once for each day and group, stored, and merged over days: distinct counts with set algebra, quantiles, heavy hitters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Log of the entries of a Theta sketch (counts up to as many are exact; the relative error above is about 1/sqrt of it), k of a KLL sketch (rank error about 1.3 % at 200), items a heavy-hitter sketch tracks.
THETA_LG, KLL_K, TRACKED = 12, 400, 1000
#: Columns of a stored row beside day and the groups.
SKETCHES = ("n", "ids", "amounts", "items")


def daily_sketches(rows: DataFrame, at: str, by: Sequence[str], id_col: str, value_col: str, item_col: str, theta_lg: int = THETA_LG, kll_k: int = KLL_K, tracked: int = TRACKED) -> DataFrame:
    """day, by, n, ids (Theta sketch of id_col), amounts (KLL sketch of value_col as double), items (heavy hitters of item_col): one row for each day and group.

    All three are built by partial aggregates of bounded size, so a hot day or group is no hot task. Null ids, values
    and items don't count; rows without a time have day null. A group without any id has a null sketch.
    """
    return rows.groupBy(F.to_date(at).alias("day"), *by).agg(
        F.count("*").alias("n"),
        F.theta_sketch_agg(id_col, theta_lg).alias("ids"),
        F.kll_sketch_agg_double(F.col(value_col).cast("double"), kll_k).alias("amounts"),
        F.expr(f"approx_top_k_accumulate(`{item_col}`, {tracked})").alias("items"),
    )


def daily_ids(rows: DataFrame, at: str, by: Sequence[str], id_col: str) -> DataFrame:
    """day, by, id: each id of a day and group once, for counts that must be exact beyond the entries of a sketch. Null ids are left out."""
    return rows.where(F.col(id_col).isNotNull()).select(F.to_date(at).alias("day"), *by, F.col(id_col).alias("id")).distinct()


def _between(rows: DataFrame, first: str | None, last: str | None) -> DataFrame:
    if first is not None:
        rows = rows.where(F.col("day") >= F.to_date(F.lit(first)))
    if last is not None:
        rows = rows.where(F.col("day") <= F.to_date(F.lit(last)))
    return rows


class SketchStore:
    """Daily sketches in a folder that all executors share, a partition for each day.

    `put` writes the days that a batch of rows touches and replaces what was there for them, so a batch that is
    delivered again changes nothing; a day must come whole in one batch. Readers see whole days only.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str]):
        self.spark, self.path, self.by = spark, path, list(by)

    def put(self, sketches: DataFrame) -> None:
        sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def days(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The stored rows of a range of days, both included; other days' files are not read."""
        return _between(self.spark.read.parquet(self.path), first, last)

    def _ids_path(self) -> str:
        return f"{self.path}-ids"

    def put_ids(self, ids: DataFrame) -> None:
        """Daily ids (`daily_ids`) beside the sketches, days replaced as by `put`."""
        # rows of a day go to few tasks, of like size, so a day is few files
        ids.hint("rebalance", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self._ids_path())

    def ids(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """by, id: each id of a group once over a range of days, both included."""
        return _between(self.spark.read.parquet(self._ids_path()), first, last).select(*self.by, "id").distinct()

    def merged(self, first: str | None = None, last: str | None = None, by: Sequence[str] | None = None, tracked: int = TRACKED) -> DataFrame:
        """by (some of the store's groups, or none), n and the three sketches over the days and over the groups left out."""
        return merged(self.days(first, last), self.by if by is None else by, tracked)


def merged(sketches: DataFrame, by: Sequence[str], tracked: int = TRACKED) -> DataFrame:
    """Rows of sketches put together by the groups; merging is associative, so it may go in steps."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.theta_union_agg("ids").alias("ids"), F.kll_merge_agg_double("amounts").alias("amounts"), F.expr(f"approx_top_k_combine(items, {tracked})").alias("items")
    )


def distinct(ids: Column | str) -> Column:
    """The estimated number of distinct ids of a sketch."""
    return F.theta_sketch_estimate(ids)


def in_both(a: Column, b: Column) -> Column:
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def only_first(a: Column, b: Column) -> Column:
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def in_either(a: Column, b: Column) -> Column:
    return F.theta_sketch_estimate(F.theta_union(a, b))


def quantile(amounts: Column | str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(amounts, F.lit(float(share)))


def rank(amounts: Column | str, value: Column) -> Column:
    """The estimated share of values that are no larger."""
    return F.kll_sketch_get_rank_double(amounts, value)


def heavy(items: str, k: int) -> Column:
    """An array of (item, count) of the k most frequent items, most frequent first."""
    return F.expr(f"approx_top_k_estimate({items}, {k})")
