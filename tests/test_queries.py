"""Every registered query against its oracle, and that the comparison can fail."""

import pytest

from oracle import SF, connect, rows_of_oracle, rows_of_query
from tessera.plans.registry import ORACLES, QUERIES

#: Results that may be empty at this size.
MAY_BE_EMPTY = {"tpch_q18", "having"}


@pytest.fixture(scope="module")
def con():
    return connect()


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got, expected = rows_of_query(QUERIES[name](spark, SF)), rows_of_oracle(con, ORACLES[name])
    assert got == expected
    assert got[1] or name in MAY_BE_EMPTY


def test_the_comparison_sees_a_changed_value(spark, con):
    sql = ORACLES["join_cross"].replace("n_name", "upper(n_name) || 'x' AS n_name")
    assert rows_of_query(QUERIES["join_cross"](spark, SF)) != rows_of_oracle(con, sql)


def test_stream_dedup_keeps_no_rows_on_the_driver(spark):
    def sinks():
        return {t.name for t in spark.catalog.listTables() if t.name.startswith("sink_")}

    before = sinks()
    assert QUERIES["stream_dedup"](spark, SF).count() == 5 and QUERIES["stream_daily"](spark, SF).count()
    assert sinks() == before


def test_join_full_holds_all_rows_of_both_tables(spark):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("orders", "lineitem"))
    keys, returned = {r["o_orderkey"] for r in orders}, [r["l_orderkey"] for r in lines if r["l_returnflag"] == "R"]
    hit = [k for k in returned if k in keys]
    expected = [(k, k) for k in hit] + [(k, None) for k in keys - set(hit)] + [(None, r["l_orderkey"]) for r in lines if r["l_returnflag"] != "R" or r["l_orderkey"] not in keys]
    got = [(r["o_orderkey"], r["l_orderkey"]) for r in QUERIES["join_full"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_late_events_are_late(spark):
    """Counted with the late delivery in time the first days would hold twice as much."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    first = {r["day"]: r["n"] for r in QUERIES["stream_late"](spark, SF).collect()}
    late = events.where("ts < timestamp_ntz'2024-01-05'").count()
    assert late and sum(first.values()) == events.where("ts < date_trunc('DAY', (SELECT max(ts) FROM {e}))".format(e="parquet.`" + SF + "/events.parquet`")).count()


def test_lateral_ranks_by_its_order(spark):
    """Numbered in the order in which rows come out of a shuffle, a customer's two orders are right by luck alone."""
    plan = QUERIES["lateral"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number() windowspecdefinition" in line]
    assert windows and all("o_totalprice" in line and "o_orderkey" in line.split("o_totalprice", 1)[1] for line in windows)


def test_recursion_goes_beyond_a_million_rows(spark, tmp_path):
    spark.range(1_100_000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert sum(r["n"] for r in QUERIES["recursive_cte"](spark, str(tmp_path)).collect()) == 1_100_000


def test_digests_hold_the_checksum(spark):
    found = QUERIES["digests"](spark, SF)
    assert found.columns == ["p_partkey", "h", "s", "bits", "x", "b", "inner_text", "c"] and found.where("c").count() == found.count()
    assert "crc32" in found._jdf.queryExecution().analyzed().toString()


def test_no_sketch_is_made_for_each_distinct_value(spark):
    """An aggregate that makes sketches has no more groups than the result."""
    lines = QUERIES["approx_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    made = [line for line in lines if "Aggregate(keys=" in line and ("approx_count_distinct" in line or "hll_sketch_agg" in line)]
    assert made and all("l_partkey" not in line.split("keys=[")[1].split("]")[0] for line in made)


@pytest.mark.parametrize("name", ["percentiles", "statistics"])
def test_quantiles_of_a_flag_are_no_single_aggregate(spark, name):
    """Spark's exact percentiles send all values of a group to one task."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median" not in plan


def test_no_xml_file_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr("tessera.sources.tables.FILE_ROWS", 40)
    found = QUERIES["format_xml"](spark, SF)
    assert found.count() == 150 and len(found.inputFiles()) >= 4
