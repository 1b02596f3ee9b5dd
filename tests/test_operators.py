"""Operators on inline rows with nulls, ties and unmatched rows."""

import pytest
from pyspark.sql import functions as F

from oracle import SF
from tessera.functions.names import free_name
from tessera.functions.vectorised import exponential_average, nearest_match, skeleton
from tessera.functions.vectors import cosine
from tessera.operators.grouping import sessions, top_k
from tessera.operators.joins import asof_join, range_join, salted_join
from tessera.plans.registry import QUERIES
from tessera.sources.calendar import Calendar


def test_asof_join_keeps_unmatched_and_takes_ties(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, None, 5), (4, "b", 9), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("b", 10, 1), (None, 1, 7)], "k string, t int, v int")
    got = {r["id"]: r["asof_v"] for r in asof_join(left, right, "k", "t", "t", ["v"]).collect()}
    assert got == {1: 51, 2: None, 3: None, 4: None, 5: None}


def test_range_join_is_half_open(spark):
    points = spark.createDataFrame([(0.0,), (10.0,), (19.9,), (25.0,)], "x double")
    ranges = spark.createDataFrame([("a", 0.0, 10.0), ("b", 10.0, 25.0), ("none", 3.0, 3.0)], "name string, lo double, hi double")
    got = sorted((r["x"], r["name"]) for r in range_join(points, ranges, "x", "lo", "hi", 4.0).collect())
    assert got == [(0.0, "a"), (10.0, "b"), (19.9, "b")]


def test_range_join_has_no_nested_loop(spark):
    points, ranges = spark.range(10).select(F.col("id").cast("double").alias("x")), spark.range(10).select(F.col("id").cast("double").alias("lo"), (F.col("id") + 2.0).alias("hi"))
    plan = range_join(points, ranges, "x", "lo", "hi", 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_salted_join_equals_join(spark):
    big, small = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 5), (3, 1)], "k int, v int"), spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, w string")
    assert sorted(map(tuple, salted_join(big, small, "k", 8).select("k", "v", "w").collect())) == sorted(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))


def test_top_k_and_cosine(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None)], "k string, v int")
    assert top_k(df, ["k"], [F.desc("v")], 2).count() == 3
    got = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([2.0, 0.0], [4.0, 0.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["c"] for r in got] == [0.0, None, 1.0]


def test_filters_and_columns_reach_the_scan(spark):
    plan = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 40").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[-1]


def test_joins_and_groups_bear_clashing_names(spark):
    left = spark.createDataFrame([(1, "a", 5, "x", 0)], "id int, k string, t int, asof_v string, _asof_v int")
    right = spark.createDataFrame([("a", 2, 20)], "k string, t int, v int")
    assert asof_join(left, right, "k", "t", "t", ["v"]).first().asDict() == {"id": 1, "k": "a", "t": 5, "asof_v": "x", "_asof_v": 0, "asof_t": 2, "__asof_v": 20}
    points = spark.createDataFrame([(1.0, 7, "p"), (None, 8, "q")], "x double, bin int, low string")
    ranges = spark.createDataFrame([(0.0, 2.0, 3), (None, 2.0, 4)], "low double, high double, bin int")
    assert [r.asDict() for r in range_join(points, ranges, "x", "low", "high", 1.0).collect()] == [{"x": 1.0, "bin": 7, "low": "p", "range_low": 0.0, "high": 2.0, "range_bin": 3}]
    rows = spark.createDataFrame([("a", 3, 9), ("a", 1, 8)], "g string, rank int, session int")
    assert [r.asDict() for r in top_k(rows, ["g"], [F.asc("rank")], 1).collect()] == [{"g": "a", "rank": 1, "session": 8, "_rank": 1}]
    assert sorted(r["_session"] for r in sessions(rows.withColumn("at", F.timestamp_seconds(F.col("rank") * 100)), "g", "at", 150).collect()) == [0, 1]
    salted = salted_join(rows.withColumnRenamed("session", "salt"), rows.select("g", F.lit(1).alias("_salt")).distinct(), "g", 4)
    assert salted.columns == ["g", "rank", "salt", "_salt"] and salted.count() == 2
    assert free_name("A", ["a", "_A"]) == "__A"


@pytest.mark.parametrize("make", [lambda e: asof_join(e, e, "k", "t", "t", ["v"]), lambda e: range_join(e, e, "v", "v", "t", 1.0), lambda e: salted_join(e, e.select("k"), "k"), lambda e: top_k(e, ["k"], [F.col("v")], 2), lambda e: sessions(e, "k", "t", 5), lambda e: exponential_average(e, "k", "v", "v", 0.5, "s"), lambda e: nearest_match(e, e, "k", "v", "v")], ids=["asof", "range", "salted", "top_k", "sessions", "average", "nearest"])
def test_operators_on_empty_tables(spark, make):
    assert make(spark.createDataFrame([], "k string, t int, v int")).count() == 0


def test_sessions_of_one_time_stay_together(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 0), ("a", 10), ("a", 30), ("b", None)], "k string, s int").withColumn("at", F.timestamp_seconds("s"))
    assert sorted((r["k"], r["s"] or 0, r["session"]) for r in sessions(rows, "k", "at", 15).collect()) == [("a", 0, 0), ("a", 0, 0), ("a", 10, 0), ("a", 30, 1), ("b", 0, 0)]


@pytest.mark.parametrize(("name", "node"), [("join_hint_broadcast", "BroadcastHashJoin"), ("join_hint_merge", "SortMergeJoin"), ("join_hint_hash", "ShuffledHashJoin")])
def test_hints_choose_the_join(spark, name, node):
    assert node in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_sample_is_about_its_share(spark):
    rows = spark.range(20000)
    assert abs(rows.sample(0.25, 7).count() - 5000) < 400 and rows.sample(0.25, 7).count() == rows.sample(0.25, 7).count()


def test_calendar_parts_and_bounds(spark):
    spark.dataSource.register(Calendar)
    load = lambda first, last, stretch: spark.read.format("calendar").option("from", first).option("to", last).option("stretch", stretch).load()
    days = load("2024-02-27", "2024-03-02", "2")
    assert days.rdd.getNumPartitions() == 3 and [str(r["day"]) for r in days.orderBy("day").collect()] == ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02"]
    assert load("2024-02-02", "2024-02-01", "2").count() == 0


def test_vectorised_functions_on_nulls(spark):
    words = spark.createDataFrame([("Abacus Bell",), (None,), ("",)], "w string")
    assert [r[0] for r in words.select(skeleton("w")).collect()] == ["abcsbll", None, ""]
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), (None, 1, 5.0)], "k string, n int, x double")
    got = sorted(((r["k"] or "", r["n"]), r["s"]) for r in exponential_average(rows, "k", "n", "x", 0.5, "s").collect())
    assert got == [(("", 1), 5.0), (("a", 1), 1.0), (("a", 2), 1.0), (("a", 3), 2.0)]
