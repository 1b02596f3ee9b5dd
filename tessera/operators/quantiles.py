"""Exact quantiles of groups of any size: no group's values meet in one task or one map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scans import Slices


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], discrete: bool = False, slices: int | None = None) -> DataFrame:
    """by, n, and for each name in shares the quantile of value at that share: interpolated between neighbours, or with `discrete` the first value that so many rows reach.

    Equal values collapse in partial counts, so a value that most rows have is one row. What is left is ordered in
    slices (`operators.scans`), running counts give the ranks, and the two rows that hold a rank go into partial maxima.
    Nulls don't count; a group of nulls alone has n 0 and null quantiles. by may be empty, for one group of all rows.
    """
    if any(not 0 <= q <= 1 for q in shares.values()):
        raise ValueError("shares lie between 0 and 1")
    key = F.struct(F.lit(0).alias("_"), *by).alias("g")
    counts = df.groupBy(key, F.col(value).alias("v")).agg(F.count(value).alias("n"))
    own = Slices(counts, ["g"], ["v"], slices)
    rows = own.fold(own.rows, "upto", "sum", F.col("row.n")).select("row.g", "row.v", "row.n", "upto")
    sizes = rows.groupBy(F.col("g").alias("of")).agg(F.sum("n").alias("size"))
    ranked = rows.join(sizes, F.col("g").eqNullSafe(F.col("of")))

    def at(place: Column) -> Column:
        """The value of the 0-based place in order."""
        return F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col("v")))

    found = []
    for i, q in enumerate(shares.values()):
        # as a decimal, so that a share such as 0.9 of 10 rows is 9 rows and not a little more
        of = F.lit(q).cast("decimal(18,12)")
        place = of * (F.col("size") - 1) if not discrete else F.greatest(F.ceil(of * F.col("size")) - 1, F.lit(0))
        found += [at(F.floor(place)).alias(f"low{i}"), at(F.ceil(place)).alias(f"high{i}"), F.max(place - F.floor(place)).cast("double").alias(f"part{i}")]
    ends = ranked.groupBy("g").agg(F.max("size").alias("n"), *found)
    out = [F.col(f"low{i}") if discrete else (F.col(f"low{i}") + F.col(f"part{i}") * (F.col(f"high{i}") - F.col(f"low{i}"))) for i in range(len(shares))]
    return ends.select(*[F.col("g")[c].alias(c) for c in by], "n", *[c.alias(name) for c, name in zip(out, shares, strict=True)])
