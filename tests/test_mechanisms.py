"""The journal connector, layouts, functions of the user's own and samples: failures, restarts, plans, nulls and clashing names."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from oracle import SF
from tessera.functions.vectorised import exponential_average, nearest_match, plain_letters, spread, sql_functions
from tessera.operators.sampling import bottom_k
from tessera.plans import mechanisms
from tessera.ship import shipped
from tessera.sources.journal import Folder, Journal, JournalReader
from tessera.sources.tables import scratch
from tessera.streaming.events import _run


@pytest.fixture
def journal(spark):
    shipped(spark).dataSource.register(Journal)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = scratch(spark)
    rows = spark.range(1000).select("id", F.concat(F.lit("n"), F.col("id") % 10).alias("name"), F.when(F.col("id") % 4 > 0, F.col("id") / 3).alias("x"))
    put = lambda df: df.write.format("journal").mode("append").option("path", path).save()
    return path, rows, put, lambda: spark.read.format("journal").schema(rows.schema).option("path", path).load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_journal_round_trip_with_filters(journal):
    path, rows, put, read = journal
    put(rows.where("id < 500").repartitionByRange(4, "id"))
    put(rows.where("id >= 500").repartitionByRange(4, "id"))
    put(rows.limit(0))
    assert len(Folder(path).commits()) == 2
    for where in ("true", "id = 777", "id > 990 AND name = 'n3'", "x > 300", "x IS NULL AND id <= 40", "name < 'n1'", "id % 7 = 3", "NOT id = 5"):
        assert sorted(read().where(where).collect()) == sorted(rows.where(where).collect()), where
    reader = JournalReader(Folder(path), rows.schema)
    assert list(reader.pushFilters([EqualTo(("id",), 777), GreaterThan(("x",), 1.5)])) == [GreaterThan(("x",), 1.5)]
    assert len(reader.partitions()) == 1 < len(Folder(path).segments())
    assert not list(JournalReader(Folder(path), rows.schema).pushFilters([LessThanOrEqual(("name",), "n5")]))


def test_journal_keeps_nothing_of_a_failed_write(spark, journal):
    path, rows, put, read = journal
    put(rows)
    bad = rows.repartitionByRange(4, "id").withColumn("id", F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        put(bad)
    assert read().count() == 1000
    # tasks that were killed with the job may leave a file each
    folder, at = Folder(path), os.path.join(path.removeprefix("file:"), "segments")
    assert len(folder.commits()) == 1 and folder.vacuum() <= 4 and folder.vacuum() == 0
    assert sorted(f"segments/{f}" for f in os.listdir(at)) == sorted(s.name for s in folder.segments())
    assert read().count() == 1000
    with pytest.raises(Exception, match="appended"):
        rows.write.format("journal").mode("overwrite").option("path", path).save()


def test_journal_stream_goes_on_after_a_restart(spark, journal):
    path, rows, put, _ = journal
    out, checkpoint = scratch(spark), scratch(spark)
    for low in (0, 300, None, 600):  # once nothing is new
        if low is not None:
            put(rows.where(f"id >= {low} AND id < {low + 300}"))
        _run(spark.readStream.format("journal").schema(rows.schema).option("path", path).load(), out, checkpoint)
    found = spark.read.schema(rows.schema).parquet(out)
    assert found.count() == 900 == found.select("id").distinct().count()


def test_dynamic_pruning_and_buckets(spark):
    assert "dynamicpruning" in plan(mechanisms.pruned_partitions(spark, SF))
    joined = plan(mechanisms.bucketed(spark, SF))
    assert "SortMergeJoin" in joined and "Exchange" not in joined


def test_sql_functions_are_inlined(spark):
    sql_functions(spark)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_extendedprice", "l_discount")
    found = plan(lines.where("net_price(l_extendedprice, l_discount) > 100 AND net_price(l_orderkey, 0) < 9").select("l_orderkey"))
    assert "net_price" not in found and "PushedFilters" in found
    assert spark.sql("SELECT net_price(10, 0.5), net_price(10, 0.5, 1), net_price(NULL, 0)").first()[:] == (5.0, 10.0, None)


def test_arrow_functions_on_nulls(spark):
    rows = spark.createDataFrame([(1, "Crème brûlée Ångström", 1.0), (1, None, None), (1, "", 3.0), (1, "ß日本", 8.0), (2, "x", None)], "k int, t string, v double")
    assert {r[0] for r in rows.select(plain_letters("t")).collect()} == {"Creme brulee Angstrom", None, "", "ß日本", "x"}
    assert {r["k"]: r["s"] for r in rows.groupBy("k").agg(spread("v").alias("s")).collect()} == {1: 2.0, 2: None}


def test_exponential_average_and_nearest_match_bear_nulls_and_clashes(spark):
    at = lambda m: None if m is None else datetime.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([("a", at(1), 1.0, 5), ("a", at(3), None, 5), ("a", at(2), 3.0, 5), (None, at(1), 2.0, 5), ("b", None, None, 5)], "k string, t timestamp_ntz, v double, s int")
    got = {(r["k"], r["v"]): r["_s"] for r in exponential_average(rows, "k", "t", "v", 0.5, "s").collect()}
    assert got == {("a", 1.0): 1.0, ("a", 3.0): 2.0, ("a", None): 2.0, (None, 2.0): 2.0, ("b", None): None}
    right = spark.createDataFrame([("a", at(0), 7), ("a", at(4), 9), ("a", at(4), 8), ("a", None, 1), (None, at(1), 2)], "k string, t timestamp_ntz, x int")
    near = sorted((str(r["k"]), str(r["t"]), r["x"]) for r in nearest_match(rows, right, "k", "t", "x").collect())
    assert near == [("None", str(at(1)), None), ("a", str(at(1)), 7), ("a", str(at(2)), 7), ("a", str(at(3)), 8), ("b", "None", None)]


def test_bottom_k_is_stable_and_weighs(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "rare").alias("g"), F.lit(1).alias("weight"), F.lit(2).alias("place"))
    one, more = bottom_k(rows, ["g"], "id", 40, 1), bottom_k(rows.repartition(11), ["g"], "id", 90, 1)
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(one) < ids(more) and ids(one) == ids(bottom_k(rows.repartition(3), ["g"], "id", 40, 1)) != ids(bottom_k(rows, ["g"], "id", 40, 2))
    assert {r["g"]: (r["n"], round(r["w"])) for r in one.groupBy("g").agg(F.count("*").alias("n"), F.sum("_weight").alias("w")).collect()} == {"hot": (40, 2700), "rare": (40, 150), None: (40, 150)}
    assert bottom_k(rows, ["g"], "id", 10_000).count() == 3000 and bottom_k(rows.limit(0), ["g"], "id", 3).count() == 0
    assert "WindowGroupLimit" in plan(one)
    with pytest.raises(ValueError):
        bottom_k(rows, ["g"], "id", 0)
