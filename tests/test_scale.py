"""Recursion, stored sketches and state: circles, repeats, replaced days, error bounds, merged and expired sessions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import sketches as S
from tessera.operators.recursion import chain_ends, closure, subtree_sums
from tessera.plans.registry import QUERIES
from tessera.sources.tables import scratch
from tessera.streaming.state import PROVIDER, FirstSeen, TimedSessions, rocksdb


def test_closure_ends_in_circles_and_finds_least_depths(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(90)] + [(1, 2), (2, 3), (3, 1), (7, 7), (7, 7), (None, 5), (5, None)]
    to = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            to[a].add(b)
    expected = set()
    for root in (1, 7, 20, 99):
        depth, now, d = {root: 0}, {root}, 0
        while now:
            d += 1
            now = {b for a in now for b in to[a]} - set(depth)
            depth |= dict.fromkeys(now, d)
        expected |= {(root, n, k) for n, k in depth.items()}
    frame = spark.createDataFrame(edges, "a long, b long")
    roots = spark.createDataFrame([(1,), (7,), (20,), (99,), (1,), (None,)], "root long")
    found = closure(frame, roots, "a", "b")
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    assert closure(frame.limit(0), roots.limit(0), "a", "b").count() == 0
    with pytest.raises(RuntimeError):
        closure(frame, roots, "a", "b", max_rounds=1)


def test_chain_ends(spark):
    links = [(i, i - 1 if i % 700 else None) for i in range(700)] + [(1000, 1001), (1001, 1002), (1002, 1001), (1003, 1003), (1004, 5000), (1005, 1004), (None, 3), (1006, 699), (1006, 2000)]
    got = {r["node"]: (r["root"], r["depth"], r["in_circle"]) for r in chain_ends(spark.createDataFrame(links, "n long, p long"), "n", "p").collect()}
    assert all(got[i] == (0, i, False) for i in range(700))
    assert all(got[i] == (None, None, True) for i in (1000, 1001, 1002, 1003))
    assert got[1004] == (5000, 1, False) and got[1005] == (5000, 2, False) and got[5000] == (5000, 0, False) and got[1006] == (0, 700, False)
    assert len(got) == 700 + 8


def test_subtree_sums(spark):
    rnd = random.Random(8)
    parent = {i: None if i < 3 else rnd.randrange(i) for i in range(80)}
    value = {i: rnd.randrange(100) for i in range(80)}
    expected = defaultdict(lambda: [0, 0])
    for i in parent:
        at = i
        while at is not None:
            expected[at][0] += 1
            expected[at][1] += value[i]
            at = parent[at]
    rows = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "i long, p long, v long")
    assert {r["node"]: [r["n"], r["v"]] for r in subtree_sums(rows, "i", "p", ["v"]).collect()} == dict(expected)


@pytest.fixture(scope="module")
def sold(spark):
    rows = spark.range(60_000).select(
        F.expr("timestamp_ntz'2024-03-01' + make_interval(0, 0, 0, CAST(id % 10 AS INT))").alias("at"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("kind"),
        F.when(F.col("id") % 50 > 0, F.col("id")).alias("who"), F.pmod(F.hash("id"), F.lit(1000)).alias("price"), F.concat(F.lit("item"), F.floor(F.sqrt(F.col("id") % 400))).alias("item"),
    )
    store = S.SketchStore(spark, scratch(spark), ["kind"])
    days = S.daily_sketches(rows, "at", ["kind"], "who", "price", "item")
    store.put(days)
    store.put(days.where("day = DATE '2024-03-04'"))  # again: nothing is counted twice
    return rows, store


def test_sketches_merged_over_days_stay_near(sold):
    rows, store = sold
    part = rows.where("at >= TIMESTAMP_NTZ'2024-03-02' AND at < TIMESTAMP_NTZ'2024-03-08'")
    exact = {r["kind"]: r for r in part.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("who").alias("who")).collect()}
    got = {r["kind"]: r for r in store.merged("2024-03-02", "2024-03-07").select("kind", "n", S.distinct("ids").alias("who"), S.quantile("amounts", 0.9).alias("p90"), S.rank("amounts", F.lit(500.0)).alias("r")).collect()}
    for kind, r in exact.items():
        assert got[kind]["n"] == r["n"] and abs(got[kind]["who"] - r["who"]) < 0.06 * r["who"]
        share = part.where(F.col("kind") == kind).agg(F.avg((F.col("price") <= got[kind]["p90"]).cast("int"))).first()[0]
        assert abs(share - 0.9) < 0.02 and abs(got[kind]["r"] - 0.5) < 0.03
    whole = store.merged(by=[]).select("n", S.distinct("ids").alias("who"), S.heavy("items", 3).alias("top")).first()
    assert whole["n"] == 60_000 and abs(whole["who"] - 58_800) < 0.06 * 58_800
    best = [(r["item"], r["n"]) for r in rows.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(3).collect()]
    assert [tuple(x) for x in whole["top"]] == best


def test_sketches_have_set_algebra(sold):
    rows, store = sold
    both = store.merged("2024-03-01", "2024-03-01", by=[]).select(F.col("ids").alias("x")).crossJoin(store.merged("2024-03-01", "2024-03-02", by=[]).select(F.col("ids").alias("y")))
    r = both.select(S.in_both(F.col("x"), F.col("y")).alias("both"), S.only_first(F.col("y"), F.col("x")).alias("more"), S.in_either(F.col("x"), F.col("y")).alias("either")).first()
    first = rows.where("at < TIMESTAMP_NTZ'2024-03-02'").select("who").distinct().where("who IS NOT NULL").count()
    second = rows.where("at < TIMESTAMP_NTZ'2024-03-03'").select("who").distinct().where("who IS NOT NULL").count()
    assert abs(r["both"] - first) < 0.08 * first and abs(r["either"] - second) < 0.06 * second and abs(r["more"] - (second - first)) < 0.08 * second


def test_sketches_read_only_the_days_asked_for(sold):
    plan = sold[1].days("2024-03-03", "2024-03-04")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


class Held:
    """A state variable of any kind, in a dictionary."""

    def __init__(self):
        self.of = {}

    def get(self):
        return list(self.of.get("list", [])) if "list" in self.of else self.of.get("value") or []

    def put(self, rows):
        self.of["list"] = list(rows)

    def clear(self):
        self.of.clear()

    def exists(self):
        return "value" in self.of

    def update(self, value):
        self.of["value"] = value

    def containsKey(self, k):
        return k in self.of

    def getValue(self, k):
        return self.of[k]

    def updateValue(self, k, v):
        self.of[k] = v

    def removeKey(self, k):
        del self.of[k]

    def keys(self):
        return iter(list(self.of))

    def iterator(self):
        return iter(list(self.of.items()))


class Handle:
    def __init__(self):
        self.timers, self.vars = set(), {}

    def _state(self, name, *_, **__):
        return self.vars.setdefault(name, Held())

    getListState = getMapState = getValueState = _state

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Fired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_sessions_merge_in_any_order_and_leave_no_state():
    import pandas as pd

    handle, one = Handle(), TimedSessions(10_000_000)
    one.init(handle)
    feed = lambda *rows: list(one.handleInputRows(("k",), iter([pd.DataFrame([(s * 1_000_000, kind) for s, kind in rows], columns=["at_us", "kind"])]), None))
    assert feed((100, "a"), (130, "b"), (105, "a")) == []
    assert handle.timers == {115_000, 140_000}
    feed((114, "c"), (122, "d"))  # joins both sessions to one
    assert handle.timers == {140_000}
    feed((200, "a"))
    out = pd.concat(one.handleExpiredTimer(("k",), None, Fired(140_000)))
    assert out.values.tolist() == [["k", 100_000_000, 130_000_000, 5, 4, 1]]
    out = pd.concat(one.handleExpiredTimer(("k",), None, Fired(210_000)))
    assert out.values.tolist() == [["k", 200_000_000, 200_000_000, 1, 1, 2]]
    assert not handle.vars["open"].get() and not handle.vars["kinds"].of and handle.vars["left"].of == {"value": (2,)}


def test_rocksdb_setting_comes_back(spark):
    before = spark.conf.get(PROVIDER, None)
    with rocksdb(spark):
        assert "RocksDB" in spark.conf.get(PROVIDER)
    assert spark.conf.get(PROVIDER, None) == before


def test_a_call_costs_as_many_messages_however_many_sessions_are_open():
    """Every call to a state variable or timer is a message to the JVM; the watermark closes all it has passed at once."""
    import pandas as pd

    class Told(Held):
        calls = 0

        def __getattribute__(self, name):
            if name not in ("of", "calls") and not name.startswith("__"):
                Told.calls += 1
            return super().__getattribute__(name)

    class Watermark:
        def getCurrentWatermarkInMs(self):
            return 300_000_000

    for n in (3, 400):
        handle, one = Handle(), TimedSessions(10_000_000)
        handle._state = handle.getListState = handle.getMapState = handle.getValueState = lambda name, *_, of=handle.vars, **__: of.setdefault(name, Told())
        one.init(handle)
        Told.calls = 0
        list(one.handleInputRows(("k",), iter([pd.DataFrame([(i * 100_000_000, kind) for i in range(n) for kind in "ab"], columns=["at_us", "kind"])]), None))
        assert Told.calls + len(handle.timers) <= 8
        Told.calls = 0
        out = pd.concat(one.handleExpiredTimer(("k",), Watermark(), Fired(10_000)))
        assert out.values.tolist() == [["k", i * 100_000_000, i * 100_000_000, 2, 2, i + 1] for i in range(min(n, 2900))]
        assert Told.calls <= 12 and not list(one.handleExpiredTimer(("k",), Watermark(), Fired((n - 1) * 100_000 + 10_000)))


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """12,000 users, more than a sketch has entries: all sign up on two days, every third has an error."""
    base = str(tmp_path_factory.mktemp("many"))
    users = spark.range(12_000).withColumnRenamed("id", "user_id")
    signups = users.select("user_id", F.explode(F.expr("array(timestamp_ntz'2024-01-10', timestamp_ntz'2024-01-15')")).alias("ts"), F.lit("signup").alias("event_type"))
    errors = users.where("user_id % 3 = 0").select("user_id", F.expr("timestamp_ntz'2024-01-20'").alias("ts"), F.lit("error").alias("event_type"))
    outside = users.select(F.col("user_id") + 50_000, F.expr("timestamp_ntz'2024-01-21'").alias("ts"), F.lit("error").alias("event_type"))
    rows = signups.union(errors).union(outside)
    rows.select(F.monotonically_increasing_id().alias("event_id"), "ts", "user_id", "event_type", F.lit(1.0).alias("value")).write.parquet(f"{base}/events.parquet")
    return base


def test_distinct_users_are_exact_beyond_the_entries_of_a_sketch(spark, many_users):
    got = {tuple(r) for r in QUERIES["sketch_people"](spark, many_users).select("event_type", "n", "users").collect()}
    assert got == {("signup", 24_000, 12_000), ("error", 4_000, 4_000)}


def test_overlaps_are_exact_beyond_the_entries_of_a_sketch(spark, many_users):
    assert QUERIES["sketch_overlap"](spark, many_users).first().asDict() == {"in_both": 4_000, "only_signup": 8_000, "in_either": 12_000}


def test_first_seen_reads_and_appends_once_a_call():
    import pandas as pd
    from pyspark.sql.types import LongType

    calls, kept = [], []

    class Kept:
        def get(self):
            calls.append("get")
            return iter(list(kept))

        def appendValue(self, row):
            calls.append("append")
            kept.append(row)

    class Own:
        def getListState(self, name, schema, ttlDurationMs=None):
            assert ttlDurationMs == 1000
            return Kept()

    one = FirstSeen(1000, LongType())
    one.init(Own())
    feed = lambda *frames: [tuple(r) for f in one.handleInputRows((0,), iter([pd.DataFrame(f, columns=["key", "id"]) for f in frames]), None) for r in f.values.tolist()]
    rows = [(k, i) for k in (1, 2) for i in range(300)]
    assert feed(rows + rows, rows) == rows and calls == ["get", "append"]
    assert feed([(1, 5), (3, 5), (2, 300)], [(3, 5)]) == [(3, 5), (2, 300)] and calls == ["get", "append"] * 2
    assert feed(rows) == [] and calls == ["get", "append", "get", "append", "get"]
