"""Ordered scans and exact quantiles against windows and plain Python, with a key that has nine tenths of all rows."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oracle import SF
from tessera.operators.grouping import sessions
from tessera.operators.joins import asof_join
from tessera.operators.quantiles import exact_quantiles
from tessera.operators.scans import Slices, asof_scan, running, session_scan


@pytest.fixture(scope="module")
def hot(spark):
    """Events of which nine tenths have one key, some no key, some no value, and many share a time."""
    key = F.when(F.col("event_id") % 10 < 9, 0).when(F.col("event_id") % 100 != 9, F.col("user_id"))
    return spark.read.parquet(f"{SF}/events.parquet").select("event_id", key.alias("k"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 13).alias("v"), F.lit(1).alias("session"), F.lit(2).alias("key"), "event_type")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("kind", ["sum", "count", "min", "max", "last"])
def test_running_equals_a_window(hot, kind):
    over = Window.partitionBy("k").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = {"sum": F.sum("v"), "count": F.count("v"), "min": F.min("v"), "max": F.max("v"), "last": F.last("v", True)}[kind]
    same(running(hot, ["k"], ["ts", "event_id"], {"key": (kind, "v")}, 16), hot.withColumn("_key", plain.over(over)))


def test_asof_scan_equals_the_window_form(hot):
    left, right = hot.where("event_type = 'purchase'"), hot.where("event_type = 'click'").select("k", "ts", F.col("event_id").alias("click"))
    same(asof_scan(left, right, "k", "ts", "ts", ["click"], slices=16), asof_join(left, right, "k", "ts", "ts", ["click"]))
    assert asof_scan(left.limit(0), right, "k", "ts", "ts", ["click"]).count() == 0
    assert asof_scan(left, right.limit(0), "k", "ts", "ts", ["click"]).where("asof_click IS NOT NULL").count() == 0


def test_session_scan_equals_the_window_form(hot):
    rows = hot.withColumn("ts", F.when(F.col("event_id") % 50 > 0, F.col("ts")))
    same(session_scan(rows, "k", "ts", 7200, 16), sessions(rows, "k", "ts", 7200))
    assert session_scan(rows, "k", "ts", 7200).agg(F.max("_session")).first()[0] >= 30


def test_a_hot_key_is_dealt_evenly_and_needs_no_further_exchange(hot):
    found = Slices(hot, ["k"], ["ts", "event_id"], 16)
    rows = found.fold(found.rows, "n", "count", F.col("row.v"))
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == found.count > 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "shufflepartitionidpassthrough" in plan and "hashpartitioning" not in plan and "Window" in plan


def test_scans_on_an_empty_table(hot):
    empty = hot.limit(0)
    assert running(empty, ["k"], ["ts"], {"n": ("sum", "v")}).count() == session_scan(empty, "k", "ts", 60).count() == 0


def test_exact_quantiles(spark):
    rnd = random.Random(5)
    groups = {"a": [rnd.randrange(50) for _ in range(999)] + [7] * 3000, "b": [1, 2], "c": [3], None: [rnd.random() * 9 for _ in range(100)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)] * 9 + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p90": 0.9, "high": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", shares, slices=8).collect()}
    steps = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", shares, discrete=True).collect()}
    assert set(got) == {*groups, "d"} and got["d"]["n"] == 0 and got["d"]["mid"] is None
    for g, vs in groups.items():
        vs = sorted(vs)
        for name, q in shares.items():
            place = q * (len(vs) - 1)
            lo, hi = vs[int(place + 1e-9)], vs[min(int(place + 1e-9) + 1, len(vs) - 1)]
            assert got[g][name] == pytest.approx(lo + (place - int(place + 1e-9)) * (hi - lo))
            assert steps[g][name] == vs[max(0, -(-int(q * 100) * len(vs) // 100) - 1)]
        assert got[g]["n"] == len(vs)
    assert exact_quantiles(df, [], "v", {"mid": 0.5}).first()["mid"] == 7
    with pytest.raises(ValueError):
        exact_quantiles(df, [], "v", {"mid": 1.5})


def test_session_scan_by_hand(spark):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = spark.createDataFrame([(1, at(m)) for m in (0, 10, 40, 50, 200)] + [(2, at(5)), (2, None)], "k int, t timestamp_ntz")
    assert sorted((r["k"], str(r["t"]), r["session"]) for r in session_scan(rows, "k", "t", 1200).collect()) == sorted([(1, str(at(0)), 0), (1, str(at(10)), 0), (1, str(at(40)), 1), (1, str(at(50)), 1), (1, str(at(200)), 2), (2, str(at(5)), 0), (2, "None", 0)])
