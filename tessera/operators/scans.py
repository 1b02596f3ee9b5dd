"""Ordered scans for keys of any size: rows go in slices of like size, each slice hands on a carry, and carries are combined before the slices."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import free_name
from tessera.sources.tables import held


@dataclass(frozen=True)
class Fold:
    """A running value that can be had in parts: over ordered rows (`over`), of a whole slice (`part`, given the order), of a part before and one after (`join`)."""

    over: Callable[[Column], Column]
    part: Callable[[Column, Column], Column]
    join: Callable[[Column, Column], Column]


def _added(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _latest(x: Column, at: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), at))


FOLDS = {
    "sum": Fold(F.sum, lambda x, at: F.sum(x), _added),
    "count": Fold(F.count, lambda x, at: F.count(x), _added),
    "min": Fold(F.min, lambda x, at: F.min(x), lambda a, b: F.least(a, b)),
    "max": Fold(F.max, lambda x, at: F.max(x), lambda a, b: F.greatest(a, b)),
    "last": Fold(lambda x: F.last(x, ignorenulls=True), _latest, lambda a, b: F.coalesce(b, a)),
}
#: How a slice's parts are put together over the slices before: counts are then added.
_OVER_SLICES = {"count": "sum"}


class Slices:
    """The rows of df, range-partitioned by (by, order) and written with the number of their slice.

    `rows` has the columns row (a struct of df's), key, at, slice. A key with most rows spans most slices, and many
    small keys share one. Rows that agree in key and order stay in one slice, so order should end with something that
    tells rows apart. Of all keys only the first and last of a slice can go on in another: carries are two rows a slice
    at most, and are broadcast. The table stays in the shared folder while results that read it are in use.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], slices: int | None = None):
        keyed = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), F.struct(*by).alias("key"), F.struct(*order).alias("at"))
        dealt = keyed.repartitionByRange(slices, "key", "at") if slices else keyed.repartitionByRange("key", "at")
        stored = held(dealt.withColumn("slice", F.spark_partition_id()))
        self.ends = held(stored.groupBy("slice").agg(F.min("key").alias("low"), F.max("key").alias("high")))
        self.count = (self.ends.agg(F.max("slice")).first()[0] or 0) + 1
        # one partition for each slice; a window by (slice, key) then needs no exchange of its own
        self.rows = stored.repartitionById(self.count, F.col("slice"))

    def fold(self, rows: DataFrame, out: str, kind: str, value: Column, own_row: bool = True) -> DataFrame:
        """rows (this object's, with columns added by folds before) with `out`: the fold of value over the rows of the key up to this one, or up to the one before."""
        fold, last = FOLDS[kind], Window.currentRow if own_row else -1
        inside = fold.over(value).over(Window.partitionBy("slice", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, last))
        border = rows.join(F.broadcast(self.ends), "slice").where(F.col("key").eqNullSafe(F.col("low")) | F.col("key").eqNullSafe(F.col("high")))
        parts = border.groupBy("slice", "key").agg(fold.part(value, F.col("at")).alias("part"))
        earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        before = FOLDS[_OVER_SLICES.get(kind, kind)].over(F.col("part")).over(earlier)
        carry = held(parts.select(F.col("slice").alias("_slice"), F.col("key").alias("_key"), before.alias("_before")))
        both = rows.withColumn(out, inside).join(F.broadcast(carry), (F.col("slice") == F.col("_slice")) & F.col("key").eqNullSafe(F.col("_key")), "left")
        return both.withColumn(out, fold.join(F.col("_before"), F.col(out))).drop("_slice", "_key", "_before")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], folds: dict[str, tuple[str, Column | str]], slices: int | None = None) -> DataFrame:
    """df with running values: folds maps a new column's name to (sum, count, min, max or last; its value), over the key's rows in order up to each row.

    Nulls add nothing, and `last` is the latest value that is not null; null keys are one key, null order comes first.
    Names that df has take underscores in front.
    """
    names, values = {}, {}
    for name in folds:
        names[name] = free_name(name, [*df.columns, *names.values()])
        values[name] = free_name(f"{name}_value", [*df.columns, *names.values(), *values.values()])
    own = Slices(df.select("*", *[F.col(v).alias(values[n]) if isinstance(v, str) else v.alias(values[n]) for n, (_, v) in folds.items()]), by, order, slices)
    rows = own.rows
    for i, (name, (kind, _)) in enumerate(folds.items()):
        rows = own.fold(rows, f"fold{i}", kind, F.col("row")[values[name]])
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns], *[F.col(f"fold{i}").alias(n) for i, n in enumerate(names.values())])


def asof_scan(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], prefix: str = "asof_", slices: int | None = None) -> DataFrame:
    """What `operators.joins.asof_join` returns, for keys of any size: the last right row at or before each left row is carried from slice to slice."""
    named = {v: free_name(f"{prefix}{v}", left.columns) for v in (right_time, *values)}
    l = left.select(F.col(by).alias("by"), F.col(left_time).alias("time"), F.lit(1).alias("side"), F.struct(*[f"`{c}`" for c in left.columns]).alias("l"))
    carried = F.struct(F.col(right_time).alias("time"), *values)
    r = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(F.col(by).alias("by"), F.col(right_time).alias("time"), F.lit(0).alias("side"), carried.alias("r"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("tie", F.xxhash64("l"))
    own = Slices(both, ["by"], ["time", "side", "r", "tie"], slices)
    found = own.fold(own.rows, "last", "last", F.col("row.r")).where("row.side = 1")
    match = F.when(F.col("row.by").isNotNull() & F.col("row.time").isNotNull(), F.col("last"))
    return found.select("row.l.*", match["time"].alias(named[right_time]), *[match[v].alias(named[v]) for v in values])


def session_scan(events: DataFrame, by: str, at: str, gap_seconds: int, slices: int | None = None) -> DataFrame:
    """What `operators.grouping.sessions` returns, for keys of any size: the last time and the number of pauses are carried from slice to slice."""
    name, tie = free_name("session", events.columns), free_name("tie", events.columns)
    own = Slices(events.withColumn(tie, F.xxhash64(*[f"`{c}`" for c in events.columns])), [by], [at, tie], slices)
    rows = own.fold(own.rows, "before", "last", F.col("row")[at], own_row=False)
    pause = F.unix_timestamp(F.col("row")[at].cast("timestamp")) - F.unix_timestamp(F.col("before").cast("timestamp"))
    rows = own.fold(rows.withColumn("pause", (F.coalesce(pause, F.lit(0)) > gap_seconds).cast("int")), "session", "sum", F.col("pause"))
    return rows.select(*[F.col("row")[c].alias(c) for c in events.columns], F.col("session").alias(name))
