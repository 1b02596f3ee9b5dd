"""Samples of a fixed size for each stratum that any rerun draws again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import free_name


def bottom_k(df: DataFrame, by: Sequence[str], id_col: str, k: int, seed: int = 0) -> DataFrame:
    """The k rows of each stratum whose hash of (seed, id) is least, or all there are, with `weight`: the rows of its stratum that each stands for.

    The draw depends on ids and seed alone, so other partitions, reruns and added rows of other strata change nothing,
    and a larger k keeps what a smaller one drew. Each task keeps k rows a stratum before the shuffle (WindowGroupLimit),
    so a hot stratum is no hot task; sizes come of partial counts. Nulls are a stratum; equal ids go by their hash alike.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    place, size, weight = (free_name(n, df.columns) for n in ("place", "size", "weight"))
    order = Window.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), id_col)
    drawn = df.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k).drop(place).alias("d")
    sizes = df.groupBy(*[F.col(c).alias(f"by{i}") for i, c in enumerate(by)]).agg(F.count("*").alias(size)).alias("s")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"s.by{i}"))
    return drawn.join(sizes, same).select("d.*", (F.col(size) / F.least(F.col(size), F.lit(k))).alias(weight))
