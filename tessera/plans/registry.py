"""Every query of the engine with its oracle; queries on corpora are registered by their own subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectorised import exponential_average, nearest_match, skeleton
from tessera.functions.vectors import cosine
from tessera.operators.grouping import sessions, top_k
from tessera.operators.joins import asof_join, range_join, salted_join
from tessera.operators.quantiles import exact_quantiles
from tessera.plans import mechanisms, scale
from tessera.plans.sql import PAIRS, SAME
from tessera.sources.tables import TABLES, register, round_trip, table
from tessera.ship import shipped
from tessera.sources.calendar import Calendar
from tessera.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]


def of_sql(text: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tuple(t for t in TABLES if re.search(rf"\b{t}\b", text)))
        return spark.sql(text)

    return query


def recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark stops a recursion at a million rows unless told otherwise; this one has a row for each part, so it ends by itself. The setting is read when the result runs, so it stays, where the session has none of its own."""
    limit = "spark.sql.cteRecursionRowLimit"
    if limit not in spark.conf.getAll:
        spark.conf.set(limit, "-1")
    return of_sql(PAIRS["recursive_cte"][0])(spark, sf_dir)


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return asof_join(bought, clicks, "user_id", "ts", "ts", ["click"]).select("event_id", F.col("asof_click").alias("click"))


def range_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(20).select(F.col("id").alias("band"), (F.col("id") * 50.0).alias("low"), (F.col("id") * 50.0 + 80).alias("high"))
    return range_join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 50.0).select("p_partkey", "band")


def salted_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    joined = salted_join(lines, table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    return joined.groupBy("s_nationkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


def two_dearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral join. The columns are chosen after it, since Spark ranks by the order of a lateral subquery only where its limit stands right on the sort: with a projection between them it numbers each key's rows as they happen to come."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    dearest = orders.where(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2)
    return table(spark, sf_dir, "customer").lateralJoin(dearest).select("c_custkey", "o_orderkey")


def near_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two estimates of distinct parts against the exact number. They are made apart: beside a count(DISTINCT), Spark makes a sketch of each group for each of its parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey")
    near = lines.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("approx"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)).alias("hll"))
    exact = lines.groupBy(F.col("l_returnflag").alias("of")).agg(F.count_distinct("l_partkey").alias("n"))
    n = F.col("n")
    return near.join(exact, F.col("l_returnflag").eqNullSafe(F.col("of"))).select("l_returnflag", "n", (F.abs(F.col("approx") - n) <= 0.08 * n).alias("near"), (F.abs(F.col("hll") - n) <= 0.04 * n).alias("hll_near"))


def _with(left: DataFrame, right: DataFrame, by: str, *values: str) -> DataFrame:
    """left with values of right, which has a row for each `by` of left; null is a key like others."""
    other = right.select(F.col(by).alias("of"), *values)
    return left.join(F.broadcast(other), F.col(by).eqNullSafe(F.col("of"))).drop("of")


def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ordered slices: Spark's own percentiles bring all values of a flag together in one task."""
    lines = table(spark, sf_dir, "lineitem")
    prices = exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "p90": 0.9})
    found = _with(prices, exact_quantiles(lines, ["l_returnflag"], "l_quantity", {"mid": 0.5}, discrete=True), "l_returnflag", "mid")
    return found.select("l_returnflag", F.round("q1", 4).alias("q1"), F.round("p90", 4).alias("p90"), "mid")


def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments in partial aggregates, and the median by ordered slices."""
    lines = table(spark, sf_dir, "lineitem")
    found = {"sd": F.stddev_samp("l_quantity"), "vp": F.var_pop("l_quantity"), "r": F.corr("l_quantity", "l_extendedprice"), "cs": F.covar_samp("l_quantity", "l_discount")}
    moments = lines.groupBy("l_returnflag").agg(*[F.round(c, 6).alias(name) for name, c in found.items()])
    medians = exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", {"med": 0.5})
    return _with(moments, medians, "l_returnflag", "med").withColumn("med", F.round("med", 4))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600)
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def cosine_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    # one row at most: vec_id is a key
    first = vectors.where("vec_id = 0").select(F.col("embedding").alias("other")).limit(1)
    return vectors.crossJoin(F.broadcast(first)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def formats(kind: str, **options: str) -> Query:
    return lambda spark, sf_dir: round_trip(table(spark, sf_dir, "customer"), kind, **options)


def calendar_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each day of a month, days without orders too, by the custom connector."""
    shipped(spark).dataSource.register(Calendar)
    days = spark.read.format("calendar").option("from", "1996-02-01").option("to", "1996-03-01").option("stretch", "10").load()
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return days.join(orders, "day", "left").groupBy("day", "weekday", "weekend").agg(F.count("o_orderkey").alias("n"))


def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", skeleton(F.col("p_name")).alias("sound"))


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(shipped(spark), sf_dir, "events").select("event_id", "user_id", "value")
    return exponential_average(events, "user_id", "event_id", "value", 0.3, "smooth").select("event_id", F.round("smooth", 6).alias("smooth"))


def nearest_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return nearest_match(events.where("event_type = 'purchase'").select("user_id", "ts"), clicks, "user_id", "ts", "click").select("user_id", "ts", F.col("click").cast("long").alias("click"))


def words_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word"))


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "orders"), "parquet", ("o_orderstatus",)).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice")


QUERIES: dict[str, Query] = {name: of_sql(text) for name, text in SAME.items()} | {name: of_sql(pair[0]) for name, pair in PAIRS.items()}
QUERIES |= {
    "recursive_cte": recursion, "join_asof": asof_events, "join_range": range_bands, "join_salted": salted_supply, "top_k": top_orders, "lateral": two_dearest, "percentiles": price_percentiles, "statistics": line_statistics, "approx_distinct": near_counts, "sessions": event_sessions, "cosine": cosine_to_first,
    "format_orc": formats("orc"), "format_json": formats("json"), "format_csv": formats("csv", header="true"), "format_partitioned": partitioned,
    "format_xml": formats("xml", rowTag="customer"), "source_calendar": calendar_orders,
    "udf_scalar": sounds, "udf_grouped": smoothed, "udf_cogrouped": nearest_clicks, "udf_table": words_of_parts,
    "stream_daily": streams.daily_counts, "stream_closed_days": streams.closed_days, "stream_dedup": streams.first_of_each, "stream_sliding": streams.sliding_counts, "stream_sessions": streams.closed_sessions,
    "stream_late": streams.late_days, "stream_join": streams.clicks_and_purchases, "stream_static_join": streams.named_events, "stream_state": streams.running_totals,
}
QUERIES |= scale.QUERIES | mechanisms.QUERIES
CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLES: dict[str, str] = SAME | {name: pair[1] for name, pair in PAIRS.items()}
ORACLES |= {
    "join_asof": "SELECT b.event_id, c.event_id AS click FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON b.user_id = c.user_id AND b.ts >= c.ts",
    "join_range": "SELECT p_partkey, band FROM part JOIN (SELECT i AS band, i * 50.0 AS low, i * 50.0 + 80 AS high FROM range(20) t(i)) b ON p_retailprice >= low AND p_retailprice < high",
    "join_salted": "SELECT s_nationkey, round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey",
    "top_k": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) o WHERE rank <= 3",
    "lateral": "SELECT o_custkey AS c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) o WHERE r <= 2",
    "approx_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, TRUE AS near, TRUE AS hll_near FROM lineitem GROUP BY l_returnflag",
    "percentiles": "SELECT l_returnflag, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS q1, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p90, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS mid FROM lineitem GROUP BY l_returnflag",
    "statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(median(l_extendedprice), 4) AS med FROM lineitem GROUP BY l_returnflag",
    "sessions": "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, sum(CASE WHEN floor(epoch(ts)) - floor(epoch(before)) > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) e) s GROUP BY ALL",
    "cosine": "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) f",
    "format_orc": CUSTOMER, "format_json": CUSTOMER, "format_csv": CUSTOMER,
    "format_partitioned": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "format_xml": CUSTOMER,
    "source_calendar": "SELECT CAST(d AS DATE) AS day, CAST(isodow(d) AS INT) AS weekday, isodow(d) > 5 AS weekend, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '1996-02-01', TIMESTAMP '1996-03-01', INTERVAL 1 DAY)) AS d) c LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY ALL",
    "udf_scalar": r"SELECT p_partkey, left(lower(p_name), 1) || regexp_replace(substr(lower(p_name), 2), '[aeiouyhw\W\d_]', '', 'g') AS sound FROM part",
    "udf_grouped": "WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), s AS (SELECT event_id, user_id, r, value AS smooth FROM e WHERE r = 1 UNION ALL SELECT e.event_id, e.user_id, e.r, 0.3 * e.value + 0.7 * s.smooth FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1) SELECT event_id, round(smooth, 6) AS smooth FROM s",
    "udf_cogrouped": "SELECT b.user_id, b.ts, (SELECT c.event_id FROM events c WHERE c.event_type = 'click' AND c.user_id = b.user_id ORDER BY abs(epoch_us(c.ts) - epoch_us(b.ts)), c.ts, c.event_id LIMIT 1) AS click FROM events b WHERE b.event_type = 'purchase'",
    "udf_table": "SELECT p_partkey, string_split(p_name, ' ')[i] AS word, CAST(i - 1 AS INT) AS place FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part) w",
    "stream_daily": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_closed_days": "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') - INTERVAL '6 hours']) AS start FROM events) t WHERE start + INTERVAL '12 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY start",
    "stream_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - before < INTERVAL '1 hour' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) e) t GROUP BY user_id, s HAVING max(ts) + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)",
    "stream_late": "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1",
    "stream_join": "SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '2' HOUR",
    "stream_static_join": "SELECT n_name, count(*) AS n FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey GROUP BY n_name",
    "stream_state": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id",
}
ORACLES |= scale.ORACLES | mechanisms.ORACLES
