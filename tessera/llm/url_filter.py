"""Operator 9: evaluate captures against the URL list entries that were active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL without user, port and trailing dot; '' if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), r"\.+$", ""))


def validity(entries: DataFrame) -> DataFrame:
    """key, action, valid_from, valid_to from dated entries (key, action, listed_at).

    An entry holds until the next entry of its key; of entries at one moment the greatest action holds. `remove`
    only ends the one before. The last interval of a key is open: valid_to is null. Entries without a key or a
    date are void.
    """
    once = entries.where("key IS NOT NULL AND listed_at IS NOT NULL").groupBy(F.lower("key").alias("key"), "listed_at").agg(F.max("action").alias("action"))
    return once.withColumn("valid_to", F.lead("listed_at").over(Window.partitionBy("key").orderBy("listed_at"))).select("key", "action", F.col("listed_at").alias("valid_from"), "valid_to").where("action <> 'remove'")


def temporal_url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """capture id, url, host, fetched_at, blocked, action, matched, valid_from, valid_to; one row for each capture.

    The as-of join: a host and its parent domains are the keys of a capture; an entry is active where valid_from
    <= fetched_at < valid_to. Of the active entries the longest key decides (block or allow); without any the
    capture passes. Both sides also carry the month, so that a host with a third of all captures, or with a long
    history, falls into many join keys and each capture meets only the intervals of its month; what still is
    skewed adaptive execution splits. A null URL, a URL without a host, and a null time match nothing. Repeated
    captures give repeated rows, an empty table an empty one, an empty list blocks nothing; other columns are not read.
    """
    caps = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at")).withColumn("host", host_of(F.col("url")))
    month = lambda c: F.year(c) * 12 + F.month(c)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # each distinct (url host, moment) is evaluated once, however many captures share it
    asked = caps.where("host <> '' AND at IS NOT NULL").select("host", "at").distinct()
    span = asked.agg(F.min(month("at")).alias("first"), F.max(month("at")).alias("last"))
    valid = validity(entries)
    held = valid.join(F.broadcast(span), F.coalesce(month("valid_to"), F.col("last")) >= F.col("first")).withColumn("from", F.greatest(month("valid_from"), "first")).withColumn("to", F.least(F.coalesce(month("valid_to"), F.col("last")), "last")).where("from <= to")
    held = held.select("key", "action", "valid_from", "valid_to", F.explode(F.sequence("from", "to")).alias("month"))
    keys = asked.select("host", "at", month("at").alias("month"), F.explode(suffixes).alias("key"))
    hit = keys.join(held, ["key", "month"]).where((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    best = hit.groupBy("host", "at").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action", "valid_from", "valid_to")).alias("hit"))
    return caps.join(best, ["host", "at"], "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "host", F.col("at").alias(time_col),
        F.coalesce(F.col("hit.action") == "block", F.lit(False)).alias("blocked"), F.col("hit.action").alias("action"), F.col("hit.key").alias("matched"), F.col("hit.valid_from").alias("valid_from"), F.col("hit.valid_to").alias("valid_to"),
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """The test pages have no fetch time; page n counts as fetched n mod 366 days and n mod 24 hours into 2024."""
    days = F.make_interval(days=(F.col("page_id") % 366).cast("int"), hours=(F.col("page_id") % 24).cast("int"))
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp_ntz") + days).alias("fetched_at"))


def dated_list(pages: DataFrame) -> DataFrame:
    """The test tables hold no list; by rule a third of the hosts are listed, delisted and listed again, and another third's parent domain has two hosts' worth of history."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    n = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    day = lambda k: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=(F.col("n") % 200 + k).cast("int"))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    event = lambda key, action, k: F.struct(key.alias("key"), F.lit(action).alias("action"), day(k).alias("listed_at"))
    own = F.array(event(F.col("host"), "block", 0), event(F.col("host"), "remove", 60), event(F.col("host"), "block", 120))
    wide = F.array(event(parent, "block", 30), event(F.col("host"), "allow", 90))
    return hosts.withColumn("n", n).select(F.explode(F.when(F.col("n") % 3 == 0, own).when(F.col("n") % 3 == 1, wide)).alias("e")).select("e.*")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return temporal_url_filter(dated_captures(pages), dated_list(pages))


OP9_SQL = r"""
WITH caps AS (
  SELECT page_id, url, lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\.+$', '')) AS host,
    TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) + to_hours(CAST(page_id % 24 AS INTEGER)) AS fetched_at
  FROM pages
), h AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS n, regexp_replace(host, '^[^.]*\.', '') AS parent FROM (SELECT DISTINCT host FROM caps WHERE host <> '')
), e AS (
  SELECT host AS key, 'block' AS action, n % 200 AS d FROM h WHERE n % 3 = 0
  UNION ALL SELECT host, 'remove', n % 200 + 60 FROM h WHERE n % 3 = 0
  UNION ALL SELECT host, 'block', n % 200 + 120 FROM h WHERE n % 3 = 0
  UNION ALL SELECT parent, 'block', n % 200 + 30 FROM h WHERE n % 3 = 1
  UNION ALL SELECT host, 'allow', n % 200 + 90 FROM h WHERE n % 3 = 1
), once AS (
  SELECT key, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AS valid_from, max(action) AS action FROM e GROUP BY ALL
), v AS (
  SELECT key, action, valid_from, lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from) AS valid_to FROM once
), hit AS (
  SELECT c.page_id, v.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.key) DESC, v.key DESC) AS r
  FROM caps c JOIN v ON (c.host = v.key OR ends_with(c.host, '.' || v.key)) AND v.action <> 'remove'
    AND v.valid_from <= c.fetched_at AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to)
  WHERE c.host <> ''
)
SELECT c.page_id, c.url, c.host, c.fetched_at, coalesce(t.action = 'block', FALSE) AS blocked, t.action, t.key AS matched, t.valid_from, t.valid_to
FROM caps c LEFT JOIN hit t ON t.page_id = c.page_id AND t.r = 1
"""
