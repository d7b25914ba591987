"""Survey section 5 invariants on the driver tables (sf0.01)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01


@pytest.fixture(scope="module")
def panel(spark):
    from aftershock.plans.recovery import recovery_panel
    return recovery_panel(spark, SF01).cache()


def test_rows_are_storms_times_tickers(spark, panel):
    from aftershock.plans import proxies
    n_storms = proxies.storms(spark, SF01).count()
    n_tickers = proxies.long_prices(spark, SF01).select("ticker").distinct().count()
    assert panel.count() == n_storms * n_tickers
    per = panel.groupBy("event_name").agg(F.countDistinct("ticker").alias("n")).select("n").distinct().collect()
    assert [r.n for r in per] == [n_tickers]


def test_recovery_invariants(panel):
    bad = panel.where(
        (F.col("recovery_price") < F.col("pre_shock_price"))
        | (F.col("recovery_date") < F.col("shock_date"))
        | (F.col("pre_shock_date") >= F.col("shock_date"))
        | ((F.col("benchmark_available") == 0) != F.col("pre_shock_price").isNull())
        | ((F.col("recovery_days") == -1) != (F.col("recovered_by_end") == 0))
        | (F.col("recovery_days") < -1))
    assert bad.count() == 0


def test_flags_monotone(spark):
    from aftershock.plans.recovery import recovery_flags
    f = recovery_flags(spark, SF01)
    assert f.where((F.col("rec_1d") > F.col("rec_7d")) | (F.col("rec_7d") > F.col("rec_30d"))
                   | (F.col("rec_30d") > F.col("rec_180d"))).count() == 0


def test_chrono_split_keeps_events_whole(spark):
    from aftershock.plans.modelling import chrono_group_split
    from aftershock.sources.tables import table
    orders = table(spark, SF01, "orders")
    s = chrono_group_split(spark, SF01).join(orders.select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_custkey") % 97 != 0, F.col("o_custkey")).alias("event")), "o_orderkey")
    assert s.count() == orders.count()  # the orders without an event are there
    first = s.groupBy("event").agg(F.countDistinct("split").alias("n"), F.first("split").alias("split"),
                                   F.min("o_orderdate").alias("d"))
    assert first.where(F.col("n") > 1).count() == 0
    last_train = first.where(F.col("split") == "train").agg(F.max("d")).first()[0]
    first_test = first.where(F.col("split") == "test").agg(F.min("d")).first()[0]
    assert last_train <= first_test


def test_splits_keep_null_groups_and_labels(spark):
    from aftershock.operators.filters import prefer_within_group
    from aftershock.operators.split import chrono_group_split, stratified_split
    df = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 9, None), (3, "b", 2, "x"), (4, None, 3, None),
                                (5, None, None, "y"), (6, "c", None, "y")], "id int, g string, t int, y string")
    got = {r["id"]: r["split"] for r in chrono_group_split(df, ["g"], ["t"], 0.75).collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "train", 5: "train", 6: "test"}
    assert stratified_split(df, "id", "y", 1).count() == 6
    assert sorted(r["id"] for r in prefer_within_group(df, ["g"], F.col("y") == "y").collect()) == [1, 2, 3, 5, 6]


def test_stratified_split_exact_share(spark):
    from aftershock.plans.modelling import stratified_split
    s = stratified_split(spark, SF01)
    for r in s.groupBy("quality").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum((F.col("split") == "train").cast("int")).alias("tr")).collect():
        assert r.tr == -(-4 * r.n // 5)  # ceil(0.8 n)


def test_top_n_per_group_and_joins(spark):
    import datetime as dt
    from aftershock.operators.dedup import top_n_per_group
    from aftershock.operators.joins import left_join_fill, membership_flag, semi
    df = spark.createDataFrame([("a", 3.0), ("a", None), ("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double")
    top = top_n_per_group(df, ["k"], [F.col("v").desc_nulls_last()], 3)
    got = sorted((r.k, r.v) for r in top.collect())
    assert got == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)]
    days = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 2, 3)], "d date")
    storms = spark.createDataFrame([(dt.date(2020, 1, 2),), (None,)], "s date")
    flags = {r.d.day: r.f for r in membership_flag(days, "d", storms, "s", "f").collect()}
    assert flags == {1: False, 2: True, 3: False}
    left = spark.createDataFrame([("x",), ("y",)], "feature string")
    right = spark.createDataFrame([("x", 1)], "feature string, sel int")
    assert {r.feature: r.sel for r in left_join_fill(left, right, "feature", {"sel": 0}).collect()} == {"x": 1, "y": 0}
    assert [r.feature for r in semi(left, right, "feature", anti=True).collect()] == ["y"]
