"""The comparison of learners (D14) on a small frame, seeded hashes, and pivot lists from the data."""

import datetime as dt
import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from aftershock.functions.hashing import seeded_hash, seeded_hash_sql
from aftershock.operators import compare as learners
from aftershock.operators.compare import Settings
from aftershock.operators.reshape import distinct_values, pivot_first
from aftershock.plans import compare
from aftershock.session import ship_package

QUICK = Settings(splits=2, folds=3, penalties=10, trees=4, rounds=2, depth=2, sizes=(3,), rfe_folds=2, inner_folds=2, draws=2, partitions=4)


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(6)
    rows = []
    for event in range(12):
        for firm in range(16):
            price = rng.gauss(0, 1)
            late = int(price + rng.gauss(0, 0.7) > 0.4)
            numbers = [float(event % 5), 1995.0 + event, 1.0 + event % 12, 2.0, 3.0, rng.random(), rng.random(), rng.random(),
                       float(firm), price, rng.random(), rng.random()]
            rows.append((f"{event}|T{firm}", str(event), str(dt.date(1995, 1, 1) + dt.timedelta(40 * event)), 0.03 + 0.04 * (firm % 2),
                         *numbers, ("South", "West")[firm % 2], late, 1 - late, late, 1))
    schema = "row_id string, event_name string, start_date string, upstream double, " + ", ".join(
        f"{c} double" for c in compare.NUMERIC) + ", region string, " + ", ".join(f"{c} int" for c in compare.OUTCOMES)
    return spark.createDataFrame(rows, schema)


def test_grid_gives_and_writes_the_five_tables(spark, frame, tmp_path):
    out = compare.run_grid(frame, ["upstream"], ["rec_1d", "rec_180d"], QUICK, path=str(tmp_path))
    assert set(out) == {"auc_pr_table", "multisplit_features", "rf_shap_features", "xgb_shap_features", "feature_comparison"}
    # an outcome with one class only has no cell
    assert {(r["cohort"], r["outcome"]) for t in out.values() for r in t.collect()} == {("upstream", "rec_1d")}
    auc = {r["Model"]: r["ROC_AUC"] for r in out["auc_pr_table"].collect()}
    assert set(auc) == {"logit", "forest", "boosted"} and auc["forest"] > 0.6 and auc["logit"] >= 0.5
    features = out["feature_comparison"].collect()
    assert len({r["Feature"] for r in features}) == len(features) == out["multisplit_features"].count() >= len(compare.NUMERIC)
    best = [r["Feature"] for r in features if r["MultiSplit_Rank"] == 1]
    assert best == ["pre_shock_price"]
    for name, t in out.items():
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == t.count()


def test_storms_stay_whole_and_the_latest_are_test_rows(frame):
    found = compare.cell(frame, "full", "rec_7d", QUICK)
    events = {r["row_id"].split("|")[0] for r in found.test.collect()}
    assert events == {"9", "10", "11"}
    table = found.prediction_table()
    assert table.count() == 48 and set(table.columns) == {"row_id", "y_true", "score_logit", "score_forest", "score_boosted"}
    synthetic = found.balanced.groupBy("y").count().collect()
    assert len({r["count"] for r in synthetic}) == 1 or abs(synthetic[0]["count"] - synthetic[1]["count"]) < 150


def test_learners_run_side_by_side_on_one_split_of_a_cohort(frame, monkeypatch):
    met, splits = threading.Barrier(3, timeout=60), []

    def meeting(fn):
        def run(*args):
            met.wait()   # the selection and both eliminations of a cell
            return fn(*args)
        return run

    for name in ("selection_table", "rfe"):
        monkeypatch.setattr(learners, name, meeting(getattr(learners, name)))
    whole = compare.chrono_group_split
    monkeypatch.setattr(compare, "chrono_group_split", lambda *args: splits.append(args) or whole(*args))
    out = compare.run_grid(frame, ["full"], ["rec_1d", "rec_7d"], QUICK, ["auc_pr_table"])
    assert [(r["outcome"], r["Model"]) for r in out["auc_pr_table"].orderBy("outcome").collect() if r["Model"] == "logit"] == [
        ("rec_1d", "logit"), ("rec_7d", "logit")]
    assert len(splits) == 1 and out["auc_pr_table"].count() == 6


def test_cells_side_by_side_send_the_package_once():
    class Context:
        def __init__(self):
            self.sent = []

        def addPyFile(self, name):
            self.sent.append(name)
            time.sleep(0.2)   # Spark copies the file; a second one of its name is an error meanwhile

    session = SimpleNamespace(sparkContext=Context())
    with ThreadPoolExecutor(4) as side:
        list(side.map(ship_package, [session] * 4))
    assert len(session.sparkContext.sent) == 1


def test_seeded_hash_equals_the_sql(spark):
    rows = [(i, t) for i, t in enumerate(["a", "", "é", None, "x" * 99])]
    got = spark.createDataFrame(rows, "i int, t string").select("i", seeded_hash("t", 7).alias("h"), seeded_hash("i", 8).alias("g")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE x (i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", rows)
    want = con.execute(f"SELECT i, {seeded_hash_sql('t', 7)}, {seeded_hash_sql('i', 8)} FROM x ORDER BY i").fetchall()
    assert sorted(map(tuple, got)) == want and all(0 <= h < 1 << 60 for _, h, _ in want)


def test_pivot_takes_its_values_from_the_data(spark):
    long = spark.createDataFrame([(1, 2003, 1.0), (1, 2001, 2.0), (2, None, 3.0), (2, 1999, 4.0)], "k int, year int, v double")
    assert distinct_values(long, "year") == [1999, 2001, 2003] and distinct_values(long, "year", descending=True)[0] == 2003
    wide = pivot_first(long, ["k"], "year", None, ["v"])
    assert wide.columns == ["k", "v_1999", "v_2001", "v_2003"]
    assert sorted(map(tuple, wide.collect())) == [(1, None, 2.0, 1.0), (2, 4.0, None, None)]
    with pytest.raises(ValueError, match="more than 2 distinct"):
        distinct_values(long, "year", at_most=2)
