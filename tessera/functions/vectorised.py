"""Functions of the user's own over Arrow batches and table arguments, and SQL functions that the optimizer inlines."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, NumericType, Row, StringType, StructType, TimestampNTZType

from tessera.functions.names import free_name


def skeleton(words: Column) -> Column:
    """The first letter and the later consonants of a text; null stays null."""
    low = F.lower(words)
    return F.concat(F.substring(low, 1, 1), F.regexp_replace(F.substring(low, 2, 1 << 30), r"[aeiouyhw\W\d_]", ""))


@F.arrow_udf(StringType())
def plain_letters(texts: pa.Array) -> pa.Array:
    """Letters without their accents (canonical decomposition without combining marks); null stays null."""
    return pa.array([None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) if not t.isascii() else t for t in texts.to_pylist()], pa.string())


@F.arrow_udf(DoubleType())
def spread(values: pa.Array) -> float:
    """The median distance from the median (MAD) of a group or a window frame; nulls don't count."""
    own = values.drop_null().to_numpy()
    return float(np.median(np.abs(own - np.median(own)))) if len(own) else None


def exponential_average(rows: DataFrame, by: str, order: str, value: str, weight: float, out: str) -> DataFrame:
    """rows with `out`: v_n = weight * x_n + (1 - weight) * v_(n-1) within each key, in order; a null value, and a key without any so far, leave it as it was.

    A recurrence: rows are dealt by key and sorted, and a task goes through its batches with one number for the open
    key, so no key is ever held. Nulls are a key, null order comes first. `out` takes underscores in front where rows has it.
    """
    name = free_name(out, rows.columns)
    at, what = rows.columns.index(by), rows.columns.index(value)
    schema = StructType([*rows.schema.fields]).add(name, "double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, begun = None, None, False
        for batch in batches:
            found = []
            for k, x in zip(batch.column(at).to_pylist(), batch.column(what).to_pylist(), strict=True):
                if not begun or k != key:
                    key, held, begun = k, None, True
                if x is not None:
                    held = x if held is None else weight * x + (1 - weight) * held
                found.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(scan, schema)


def nearest_match(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """by, at and `value` of the nearest row of right, before or after, of the same key; of two as near the earlier, of several at one time the least value. One row for each row of left.

    Both sides go through one shuffle; the last row of right before and the first after each row of left come of two
    ordered frames. Null keys and times find nothing.
    """
    l = left.select(F.col(by).alias("by"), F.col(at).alias("at"), F.lit(1).alias("side"))
    r = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(by).alias("by"), F.col(at).alias("at")).agg(F.min(value).alias("value"))
    both = l.unionByName(r.select("by", "at", F.lit(0).alias("side"), F.struct("at", "value").alias("r")), allowMissingColumns=True)
    order = Window.partitionBy("by").orderBy("at", "side")
    before, after = F.last("r", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("r", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("before", before).withColumn("after", after).where("side = 1")
    place = (lambda c: F.col(c)) if isinstance(left.schema[at].dataType, NumericType) else (lambda c: F.unix_micros(F.col(c).cast("timestamp")))
    away = [F.abs(place(f"{c}.at") - place("at")) for c in ("before", "after")]
    near = F.when(F.col("after").isNull() | (away[0] <= away[1]), F.col("before.value")).otherwise(F.col("after.value"))
    return found.select(F.col("by").alias(by), F.col("at").alias(at), F.when(F.col("by").isNotNull() & F.col("at").isNotNull(), near).alias(value))


@F.udtf(returnType=StructType().add("key", LongType()).add("kind", StringType()).add("n", IntegerType()).add("first", TimestampNTZType()).add("last", TimestampNTZType()))
class Runs:
    """Runs of rows of one kind, of a table argument with the columns key, at, kind, partitioned by key and ordered by at: one row a run, the last one when the partition ends."""

    def __init__(self) -> None:
        self.run: tuple | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.run and self.run[1] == row["kind"]:
            key, kind, n, first, _ = self.run
            self.run = key, kind, n + 1, first, row["at"]
        else:
            if self.run:
                yield self.run
            self.run = row["key"], row["kind"], 1, row["at"], row["at"]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield self.run


#: SQL functions: their bodies take the place of the calls before optimization, so filters go through them.
SQL_FUNCTIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DOUBLE, discount DOUBLE, tax DOUBLE DEFAULT 0) RETURNS DOUBLE RETURN price * (1 - discount) * (1 + tax)",
    "CREATE OR REPLACE TEMPORARY FUNCTION days_of_week(first DATE, weeks INT) RETURNS TABLE (day DATE, week INT) RETURN SELECT date_add(first, i * 7), i FROM (SELECT explode(sequence(0, weeks - 1)) AS i) s",
)


def sql_functions(spark: SparkSession) -> SparkSession:
    """net_price and days_of_week as temporary functions of the session."""
    for text in SQL_FUNCTIONS:
        spark.sql(text)
    return spark
