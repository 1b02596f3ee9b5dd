"""Queries over what Spark offers besides relations: connectors, layouts of tables, functions of the user's own, samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectorised import Runs, plain_letters, spread, sql_functions
from tessera.operators.sampling import bottom_k
from tessera.ship import shipped
from tessera.sources.journal import Journal
from tessera.sources.tables import register, scratch, table
from tessera.streaming.events import written


def _journal(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The orders as a journal of two commits: its path, and a reader."""
    shipped(spark).dataSource.register(Journal)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path, orders = scratch(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    for part in ("o_orderkey % 3 = 0", "o_orderkey % 3 > 0"):
        orders.where(part).sortWithinPartitions("o_custkey").write.format("journal").mode("append").option("path", path).save()
    return path, spark.read.format("journal").schema(orders.schema).option("path", path).load()


def journal_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, and read with a filter that reaches the connector."""
    return _journal(spark, sf_dir)[1].where("o_custkey < 40 AND o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


def journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read as a stream, from the first commit on."""
    path, orders = _journal(spark, sf_dir)
    stream = spark.readStream.format("journal").schema(orders.schema).option("path", path).load()
    return written(stream.select("o_orderkey", "o_orderstatus")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("ids"))


def pruned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events laid out by nation, joined with the nations of a region: only their partitions are read (dynamic pruning)."""
    path = scratch(spark)
    table(spark, sf_dir, "events").withColumn("nation", (F.col("user_id") % 25).cast("int")).write.partitionBy("nation").parquet(path)
    events, nations = spark.read.parquet(path), table(spark, sf_dir, "nation").where("n_regionkey = 2")
    return events.join(nations, F.col("nation") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines in buckets of the order key: they join without an exchange."""
    own = []
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        at = f"tessera_{name}_{uuid.uuid4().hex}"
        table(spark, sf_dir, name).write.bucketBy(16, key).sortBy(key).option("path", scratch(spark)).saveAsTable(at)
        own.append(spark.table(at))
    orders, lines = own
    return orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def unaccented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(shipped(spark), sf_dir, "documents").select("doc_id", F.md5(plain_letters("text")).alias("plain"))


def windowed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped-aggregate Arrow function over the frames of a window."""
    frame = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(shipped(spark), sf_dir, "events").select("event_id", F.round(spread("value").over(frame), 6).alias("mad"))


def runs_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function with a table argument: it sees each user's events in order."""
    shipped(spark).udtf.register("runs_of", Runs)
    register(spark, sf_dir, ("events",))
    return spark.sql("SELECT key AS user_id, kind, n, first, last FROM runs_of(TABLE (SELECT user_id AS key, ts AS at, event_type AS kind, event_id FROM events) PARTITION BY key ORDER BY (at, event_id))")


def net_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(sql_functions(spark), sf_dir, ("lineitem",))
    return spark.sql("SELECT l_returnflag, round(sum(net_price(l_extendedprice, l_discount)), 2) AS net, round(sum(net_price(l_extendedprice, l_discount, l_tax)), 2) AS gross FROM lineitem GROUP BY l_returnflag")


def weekly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(sql_functions(spark), sf_dir, ("orders",))
    return spark.sql("SELECT day, week, count(o_orderkey) AS n FROM days_of_week(DATE '1996-01-01', 20) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = day GROUP BY day, week")


def sampled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottom_k(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 5, seed=3)
    return found.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.round("weight", 6).alias("weight"))


QUERIES = {
    "journal_batch": journal_batch, "journal_stream": journal_stream, "dynamic_pruning": pruned_partitions, "bucketed_join": bucketed, "arrow_scalar": unaccented,
    "arrow_window": windowed_spread, "udtf_runs": runs_of_types, "sql_scalar_function": net_prices, "sql_table_function": weekly_orders, "sample_bottom_k": sampled_orders,
}
ORACLES = {
    "journal_batch": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey < 40 AND o_orderstatus = 'F'",
    "journal_stream": "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders GROUP BY o_orderstatus",
    "dynamic_pruning": "SELECT n_name, count(*) AS n, round(sum(value), 3) AS total FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE n_regionkey = 2 GROUP BY n_name",
    "bucketed_join": "SELECT o_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "arrow_scalar": "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents",
    "arrow_window": "SELECT event_id, round(mad(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mad FROM events",
    "udtf_runs": "SELECT user_id, event_type AS kind, CAST(count(*) AS INT) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) e GROUP BY user_id, event_type, g",
    "sql_scalar_function": "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS gross FROM lineitem GROUP BY l_returnflag",
    "sql_table_function": "SELECT CAST(d AS DATE) AS day, CAST(w AS INT) AS week, count(o_orderkey) AS n FROM (SELECT DATE '1996-01-01' + CAST(7 * i AS INT) AS d, i AS w FROM range(20) t(i)) s LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY ALL",
    "sample_bottom_k": "SELECT o_orderkey, o_orderstatus, o_orderpriority, round(size / least(size, 5), 6) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS size, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5('3:' || o_orderkey), o_orderkey) AS r FROM orders) o WHERE r <= 5",
}
