"""As-of and range joins without a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import free_name


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], prefix: str = "asof_") -> DataFrame:
    """Each row of left with the latest row of right of the same `by` at or before its time; nulls if there is none.

    Both sides go through one shuffle and one ordered window: the right rows come before left rows of their
    time, and the last of them is carried forward. Of right rows at one time the greatest values win. A null
    key or time finds nothing. The window needs a key's rows in one task; give a coarser time as part of `by`
    only if matches cannot cross it. Results are named prefix + name, with underscores in front where left has that name.
    """
    carried = F.struct(F.col(right_time).alias("time"), *values)
    named = {v: free_name(f"{prefix}{v}", left.columns) for v in (right_time, *values)}
    l = left.select(F.col(by).alias("by"), F.col(left_time).alias("at"), F.lit(1).alias("side"), F.struct(*left.columns).alias("l"))
    r = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(F.col(by).alias("by"), F.col(right_time).alias("at"), F.lit(0).alias("side"), carried.alias("r"))
    order = Window.partitionBy("by").orderBy("at", "side", F.col("r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("last", F.last("r", ignorenulls=True).over(order)).where("side = 1")
    found = F.when(F.col("by").isNotNull() & F.col("at").isNotNull(), F.col("last"))
    return both.select("l.*", found["time"].alias(named[right_time]), *[found[v].alias(named[v]) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at < high: ranges are dealt to bins of `width`, so that the join is an equi-join on the bin.

    The columns of points come first; those of ranges follow, with `range_` before a name that points has. Null
    bounds and points match nothing.
    """
    p = points.select(F.col(at).alias("at"), F.struct(*points.columns).alias("p")).withColumn("bin", F.floor(F.col("at") / width))
    r = ranges.select(F.col(low).alias("low"), F.col(high).alias("high"), F.struct(*ranges.columns).alias("r")).where("low < high")
    r = r.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    found = p.join(r, "bin").where("at >= low AND at < high")
    taken = set(points.columns)
    return found.select("p.*", *[F.col("r")[c].alias(free_name(f"range_{c}", taken) if c in taken else c) for c in ranges.columns])


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int = 16) -> DataFrame:
    """Inner join whose hot keys are spread over `salts` tasks; the small side is repeated as often."""
    name = free_name("salt", [*big.columns, *small.columns])
    salt: Column = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    repeated = small.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn(name, salt).join(repeated, [on, name]).drop(name)
