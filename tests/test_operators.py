import datetime as dt
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aftershock.functions.constants import UPSTREAM_CUTOFF, nace_to_sector, state_to_region
from aftershock.functions.dates import parse_date
from aftershock.functions.text import normalize_company_name, zfill
from aftershock.operators.aggregate import null_profile
from aftershock.operators.columns import label_by_sets, map_values, syntactic_names
from aftershock.operators.dedup import first_by
from aftershock.operators.entity import apply_overrides, match_names, prepare_directory, prepare_firms
from aftershock.operators.facts import annual_series
from aftershock.operators.filters import cohort_split, prefer_within_group
from aftershock.operators.flags import horizon_flags
from aftershock.operators.joins import null_safe_join, substring_or_equal_join, window_join
from aftershock.operators.metrics import pr_auc, roc_auc, roc_points
from aftershock.operators.ranking import ordinal
from aftershock.operators.reshape import melt_pattern, separate_rows
from aftershock.operators.selection import aggregate_pvalues
from aftershock.operators.stress import tail_overwrite
from aftershock.sources.csv import read_macro, read_position, require_columns
from aftershock.sources.json_facts import parse_company_facts


def test_name_normaliser(spark):
    rows = [("A & B CO., Inc.",), ("THE X GROUP",), ("  ",), (None,), ("Acme N.V.",), ("Costco Wholesale Corp",)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(normalize_company_name("n")).collect()]
    assert got == ["A AND B", "X", "", "", "ACME", "COSTCO WHOLESALE"]


def _dir(spark, rows):
    return prepare_directory(spark.createDataFrame(rows, "sec_company_name string, ticker string, cik long, pos long"))


def _firms(spark, names):
    return prepare_firms(spark.createDataFrame([(n, i) for i, n in enumerate(names)],
                                               "orbis_company_name string, pos long"))


def test_exact_then_fuzzy_threshold_91_92(spark):
    d = _dir(spark, [("ABCDEFGHIJKL", " abc ", 1, 0), ("ABCDEFGHIJK", "xyz", 2, 1), ("A & B Co.", "ab", 3, 2),
                     ("A AND B", "ab2", 4, 3)])
    f = _firms(spark, ["ABCDEFGHIJKX", "ABCDEFGHIJX", "a & b inc", "nothing like it"])
    got = {r.orbis_company_name: r for r in match_names(f, d, 92, False, "levenshtein").collect()}
    assert got["ABCDEFGHIJKX"].match_score == 92 and got["ABCDEFGHIJKX"].review_flag == "auto_ok"
    assert got["ABCDEFGHIJKX"].ticker == "ABC"                      # upper/trim of the directory ticker
    assert got["ABCDEFGHIJX"].review_flag == "unmatched"            # score 91 < 92
    assert got["a & b inc"].match_method == "exact_normalized" and got["a & b inc"].cik == "3"  # first row wins
    assert got["nothing like it"].match_method == "unmatched"


def test_block_ratio_and_review_rows(spark):
    d = _dir(spark, [("ABCDEFGHIJK", "abc", 1, 0), ("ZEBRA MATERIALS", "zeb", 2, 1)])
    got = {r.orbis_company_name: (r.match_score, r.review_flag, r.ticker)
           for r in match_names(_firms(spark, ["ABCDEFGHIJ", "ZEBRA METALS", "QQQ"]), d).collect()}
    assert got == {"ABCDEFGHIJ": (95, "auto_ok", "ABC"), "ZEBRA METALS": (81, "review", "ZEB"), "QQQ": (None, "unmatched", None)}


def _typos(rnd, words, n):
    names = sorted({" ".join(rnd.sample(words, 3)) for _ in range(n)})
    out = []
    for name in names[:2 * n // 3]:
        for _ in range(rnd.choice([1, 1, 2, 3])):
            i = rnd.randrange(len(name))
            name = rnd.choice([name[:i] + rnd.choice("XYZ") + name[i + 1:], name[:i] + name[i + 1:], name[:i] + "X" + name[i:]])
        out.append(name.strip())
    return names, sorted(set(out) - set(names))


@pytest.mark.parametrize("method", ["blocks", "levenshtein"])
def test_fuzzy_equals_exhaustive_search(spark, method):
    from difflib import SequenceMatcher, get_close_matches
    words = ["RED", "BLUE", "GEAR", "WIDGET", "ANVIL", "HOT", "COLD", "RING", "PLATE", "STEAM", "NORTHERN"]
    dnames, fnames = _typos(random.Random(7), words, 200)
    d = _dir(spark, [(n, f"t{i}", i, i) for i, n in enumerate(dnames)])
    got = {r.normalized_orbis_name: (r.match_score, normalised[r.matched_sec_name], r.review_flag)
           for normalised in [{n: normalize_py(spark, n) for n in dnames}]
           for r in match_names(_firms(spark, fnames), d, method=method).where(F.col("match_method") == "fuzzy").collect()}

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]

    targets = sorted({normalize_py(spark, n) for n in dnames})
    checked = 0
    for fn in {normalize_py(spark, n) for n in fnames}:
        if fn in targets:
            continue
        if method == "blocks":
            dn = get_close_matches(fn, targets, n=1, cutoff=0.0)[0]
            best = (round(100 * SequenceMatcher(None, fn, dn).ratio()), dn)
        else:
            best = max((int(np.round(100 * (1 - lev(fn, dn) / max(len(fn), len(dn))))), dn) for dn in targets)
        if best[0] >= 92:
            assert got[fn] == (*best, "auto_ok")
            checked += 1
        elif fn in got:
            assert got[fn][2] == "review" and got[fn][0] < 92
    assert checked > 20


@pytest.mark.parametrize("method", ["blocks", "levenshtein"])
def test_review_rows_are_the_best_of_the_whole_directory(spark, monkeypatch, method):
    from difflib import SequenceMatcher, get_close_matches
    from aftershock.operators import entity
    monkeypatch.setattr(entity, "FIRM_BLOCK", 16)
    monkeypatch.setattr(entity, "NAME_BLOCK", 50)
    rnd = random.Random(11)
    words = ["RED", "BLUE", "GEAR", "WIDGET", "ANVIL", "HOT", "COLD", "RING", "PLATE", "STEAM", "NORTHERN"]
    targets = sorted({" ".join(rnd.sample(words, 3)) for _ in range(150)})
    firms = {"XY", "A", "ZZQ", "AXNXVXIXL", "1 2 3"}  # that share no 3-gram
    for name in rnd.sample(targets, 60):
        letters = list(name)
        for i in rnd.sample(range(len(letters)), len(letters) // rnd.choice([2, 3, 4])):
            letters[i] = rnd.choice("XYZQ")
        firms.add(normalize_py(spark, "".join(letters)))
    d = _dir(spark, [(n, f"t{i}", i, i) for i, n in enumerate(targets)])
    got = {r.normalized_orbis_name: r for r in match_names(_firms(spark, sorted(firms)), d, method=method).collect()}
    if method == "levenshtein":
        pairs = spark.createDataFrame([(f, t) for f in firms for t in targets], "fn string, dn string")
        best = {r.fn: (r.match_score, r.dn) for r in entity._best(entity._scored(pairs, method)).collect()}
    checked = 0
    for fn in firms:
        if method == "blocks":
            dn = get_close_matches(fn, targets, n=1, cutoff=0.0)[0]
            score, ratio = round(100 * SequenceMatcher(None, fn, dn).ratio()), SequenceMatcher(None, dn, fn).ratio()
        else:
            score, dn = best[fn]
            ratio = score
        if ratio == 0:
            assert got[fn].review_flag == "unmatched" and got[fn].match_score is None
        else:
            assert (got[fn].match_score, got[fn].matched_sec_name) == (score, dn)
            assert got[fn].review_flag == ("auto_ok" if score >= 92 else "review")
            checked += score < 92
    assert checked > 40


_NORMAL: dict = {}


def normalize_py(spark, name):
    if name not in _NORMAL:
        _NORMAL[name] = spark.createDataFrame([(name,)], "n string").select(normalize_company_name("n")).first()[0]
    return _NORMAL[name]


def test_overrides_later_wins_and_new_names_appended(spark):
    d = _dir(spark, [("ALPHA CORP", "alp", 1, 0), ("BETA INC", "bet", 2, 1)])
    m = match_names(_firms(spark, ["Alpha Corp."]), d)
    ov = spark.createDataFrame([("Alpha Corp.", "bet", "9", 0), ("Alpha Corp.", "alp", "7", 1), ("Gamma", "BET", "5", 2)],
                               "orbis_company_name string, ticker string, cik string, pos long")
    got = {r.orbis_company_name: r for r in apply_overrides(m, ov, d).collect()}
    assert got["Alpha Corp."].ticker == "ALP" and got["Alpha Corp."].cik == "7" and got["Alpha Corp."].match_score == 999
    assert got["Gamma"].matched_sec_name == "BETA INC" and got["Gamma"].review_flag == "manual_ok"


def test_horizon_flags(spark):
    days = [None, -1, 0, 1, 2, 7, 8, 30, 31, 180, 181]
    df = spark.createDataFrame([(d,) for d in days], "d int")
    got = [tuple(r) for r in horizon_flags(df, "d", (1, 7, 30, 180)).collect()]
    for d, *flags in got:
        if d is None:
            assert flags == [None] * 4
        else:
            assert flags == [int(d != -1 and d <= k) for k in (1, 7, 30, 180)]
            assert flags == sorted(flags)  # monotone in k


def test_cohort_cutoff_is_inclusive_and_null_only_full(spark):
    df = spark.createDataFrame([(1, UPSTREAM_CUTOFF), (2, 1.0), (3, None)], "id int, up double")
    got = sorted((r.id, r.cohort) for r in cohort_split(df, "up", UPSTREAM_CUTOFF).collect())
    assert got == [(1, "full"), (1, "upstream"), (2, "downstream"), (2, "full"), (3, "full")]


def test_parse_dates(spark):
    df = spark.createDataFrame([("2017-08-25",), ("2017/8/25",), ("1/1/2015",), ("bad",), (None,)], "s string")
    got = [r[0] for r in df.select(parse_date("s")).collect()]
    assert got == [dt.date(2017, 8, 25), dt.date(2017, 8, 25), dt.date(2015, 1, 1), None, None]


def test_zfill_keeps_long_values(spark):
    got = [r[0] for r in spark.createDataFrame([("111",), ("0111",), ("12345",), (None,)], "s string")
           .select(zfill("s", 4)).collect()]
    assert got == ["0111", "0111", "12345", None]


def test_auc_with_ties_matches_rank_formula_and_one_class_is_null(spark):
    rnd = random.Random(3)
    rows = [(float(rnd.randint(0, 5)), rnd.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = roc_auc(df, "s", "y").first()["roc_auc"]
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-6
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert roc_auc(one, "s", "y").first()["roc_auc"] is None
    pts = roc_points(df, "s", "y").orderBy(F.desc("threshold")).collect()
    assert pts[-1]["tpr"] == 1.0 and pts[-1]["fpr"] == 1.0


def test_pr_auc_interpolated_integral(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 1), (0.3, 0), (0.3, 0), (0.1, 1)]
    got = pr_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["pr_auc"]
    # Davis-Goadrich interpolation between successive thresholds, worked by hand
    P = 4
    pts = [(0, 0), (1, 0), (2, 1), (3, 1), (3, 3), (4, 3)]
    area = 0.0
    for (ta, fa), (tb, fb) in zip(pts, pts[1:]):
        if tb == ta:
            continue
        s = (fb - fa) / (tb - ta)
        k = fa - s * ta
        u = 1 + s
        seg = (tb - ta) / u if k == 0 else (tb - ta) / u - k / (u * u) * math.log((tb + fb) / (ta + fa))
        area += seg / P
    assert abs(got - round(area, 6)) < 1e-9


def test_first_by_desc_dates_nulls_last(spark):
    rows = [("a", dt.date(2020, 1, 1), 1), ("a", dt.date(2021, 1, 1), 2), ("a", None, 3), ("b", None, 4)]
    df = spark.createDataFrame(rows, "k string, d date, v int")
    got = {r.k: r.v for r in first_by(df, ["k"], [("d", True), ("v", False)]).collect()}
    assert got == {"a": 2, "b": 4}


def test_separate_rows_keeps_null_and_positions(spark):
    df = spark.createDataFrame([(1, "Texas, Ohio,Utah"), (2, None), (3, "Iowa")], "id int, s string")
    got = sorted((r.id, r.pos, r.s) for r in separate_rows(df, "s").collect())
    assert got[:3] == [(1, 0, "Texas"), (1, 1, "Ohio"), (1, 2, "Utah")]
    assert (2, None, None) in got and (3, 0, "Iowa") in got


def test_melt_pattern_greedy_and_non_matching(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, None)], "id int, assets_current_2019 double, `upstream(2020)` double, x double")
    got = {r.metric: (r.year, r.value) for r in
           melt_pattern(df, ["id"], r"^(.*)_(\d{4})$", ["metric", "year"], casts={"year": "int"}).collect()}
    assert got["assets_current"] == (2019, 1.0)
    assert got[None] == (None, 2.0) or got[None] == (None, None)


def test_substring_or_equal_join_vs_brute_force(spark):
    firms = [(i, r) for i, r in enumerate(["nation_1", "nation_12", "asia", "x", None])]
    storms = [("s1", "nation_12 coast", "asia"), ("s2", "nation_3", "europe"), ("s3", None, "x")]
    f = spark.createDataFrame(firms, "id int, region string")
    s = spark.createDataFrame(storms, "ev string, loc string, ctry string")
    got = sorted((r.ev, r.id) for r in substring_or_equal_join(f, s, "region", "loc", "ctry").collect())
    want = sorted((ev, i) for ev, loc, c in storms for i, r in firms
                  if r is not None and ((loc is not None and r in loc) or r == c))
    assert got == want


def test_window_join_inclusive(spark):
    ev = spark.createDataFrame([("e", dt.date(2020, 1, 10))], "ev string, d date")
    se = spark.createDataFrame([(dt.date(2020, 1, i), float(i)) for i in range(1, 31)], "date date, v double")
    got = sorted(r.offset_days for r in window_join(ev, se, "d", "date", 2, 2).collect())
    assert got == [-2, -1, 0, 1, 2]


def test_review_and_result_tables(spark, tmp_path):
    from aftershock.sources.sinks import write_results, write_review_tables
    m = match_names(_firms(spark, ["ZEBRA METALS", "ALPHA"]), _dir(spark, [("ZEBRA MATERIALS", "z", 1, 0), ("ALPHA", "a", 2, 1)]))
    write_review_tables(m, str(tmp_path / "names"))
    assert spark.read.parquet(str(tmp_path / "names" / "mapping")).count() == 2
    assert [r.review_flag for r in spark.read.parquet(str(tmp_path / "names" / "needs_review")).collect()] == ["review"]
    auc = spark.createDataFrame([("full", "rec_1d", 0.5), ("upstream", "rec_1d", 0.6)], "cohort string, outcome string, auc double")
    write_results({"auc": auc}, str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results" / "auc")).where("cohort = 'upstream'").first()["auc"] == 0.6


def test_nan_close_is_missing(spark):
    from aftershock.operators.asof import recovery_search
    nan = float("nan")
    prices = spark.createDataFrame([("T", dt.date(2020, 1, i + 1), c) for i, c in enumerate([10.0, 5.0, nan, 11.0])],
                                   "ticker string, date date, close double")
    storms = spark.createDataFrame([("s", dt.date(2020, 1, 2))], "event_name string, shock_date date")
    r = recovery_search(prices, storms).first()
    assert (r.recovery_price, r.recovery_days) == (11.0, 2)


def test_independent_columns(spark):
    from pyspark.ml.linalg import Vectors
    from aftershock.operators.learn import independent_columns
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        a, b = rnd.random(), rnd.random()
        rows.append((Vectors.dense([a, 7.0, b, a + 2 * b, rnd.random()]),))
    assert independent_columns(spark.createDataFrame(rows, ["x"]), "x", [0, 1, 2, 3, 4]) == [0, 2, 4]


def test_prefer_within_group(spark):
    df = spark.createDataFrame([("a", "FY", 1), ("a", "Q1", 2), ("b", "Q1", 3)], "k string, fp string, v int")
    got = sorted(r.v for r in prefer_within_group(df, ["k"], F.col("fp") == "FY").collect())
    assert got == [1, 3]


def test_null_safe_join_matches_null_keys(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, k string")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, v int")
    got = sorted((r.id, r.v) for r in null_safe_join(a, b, ["k"]).collect())
    assert got == [(1, 10), (2, 20)]


def test_ordinal_is_global_position(spark):
    rows = [(i, random.Random(i).random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v double")
    got = {r.id: r.o for r in ordinal(df, ["v", "id"], "o").collect()}
    want = {i: k + 1 for k, (v, i) in enumerate(sorted((v, i) for i, v in rows))}
    assert got == want


def test_tail_overwrite_counts(spark):
    df = spark.createDataFrame([(i, float(i * 3)) for i in range(100)], "id int, v double")
    got = tail_overwrite(df, "v", "id", 0.05, 0.08, 180.0).collect()
    assert sum(r.recovery_days == 0 for r in got) == 5
    assert sum(r.recovery_days > 180 for r in got) == 8
    assert max(r.recovery_days for r in got if 0 < r.recovery_days <= 180) <= 180


def test_aggregate_pvalues_matches_numpy(spark):
    rnd = random.Random(5)
    ps = [rnd.random() ** 3 for _ in range(10)]
    df = spark.createDataFrame([("f", p) for p in ps], "feature string, p double")
    levels = [round(0.05 + 0.01 * i, 2) for i in range(96)]
    r = aggregate_pvalues(df, "feature", "p", levels).first()
    q = np.quantile(ps, levels)
    ratios = q / np.array(levels)
    assert abs(r["p_agg"] - min(1.0, 4 * ratios.min())) < 1e-9
    assert r["d_min"] == levels[int(np.argmin(ratios))]


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    got = {r.column: (r.null_count, r.null_pct) for r in null_profile(df).collect()}
    assert got == {"a": (1, 50.0), "b": (2, 100.0)}


def test_lookups():
    m = nace_to_sector()
    assert len(m) == 87 and m["33"] == 16 and m["01"] == 1 and "04" not in m
    r = state_to_region()
    assert r["Texas"] == "South" and "Puerto Rico" not in r


def test_label_by_sets_and_map_values(spark):
    df = spark.createDataFrame([("Texas",), ("Puerto Rico",), (None,)], "s string")
    got = [r[0] for r in df.select(label_by_sets("s", {"South": ["Texas"]}, "Other")).collect()]
    assert got == ["South", "Other", "Other"]
    got = [r[0] for r in df.select(map_values("s", {"Texas": "TX"})).collect()]
    assert got == ["TX", None, None]


def test_syntactic_names_and_require_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Cash flow / Operating revenue` int, `2019x` int")
    assert syntactic_names(df).columns == ["Cash.flow...Operating.revenue", "X2019x"]
    with pytest.raises(ValueError):
        require_columns(df, ["missing"])


def _facts_doc(cik, facts):
    return json.dumps({"cik": cik, "facts": facts})


def test_facts_rules(spark):
    f = lambda end, form, filed, fp="FY", val=1.0: {"end": end, "val": val, "form": form, "filed": filed, "fy": 2020, "fp": fp}
    docs = [
        # amended vs original in the same year: the original wins; quarter rows dropped since FY exist
        _facts_doc(1, {"us-gaap": {"Assets": {"units": {"USD": [
            f("2020-12-31", "10-K/A", "2021-06-01", val=2.0), f("2020-12-31", "10-K", "2021-02-01", val=1.0),
            f("2020-09-30", "10-Q", "2020-11-01", fp="Q3", val=9.0),
            f("2019-12-31", "10-K", "2020-02-01", fp="Q4", val=5.0)]}}}}),
        # only-quarter series keeps its rows; empty USD list wins over shares -> tag empty -> next tag
        _facts_doc(2, {"us-gaap": {
            "RevenueFromContractWithCustomerExcludingAssessedTax": {"units": {"USD": [], "shares": [
                f("2020-12-31", "10-K", "2021-02-01")]}},
            "Revenues": {"units": {"USD": [f("2020-12-31", "10-K", "2021-02-01", fp="Q4", val=7.0)]}}}}),
        # missing taxonomy -> nothing
        _facts_doc(3, {"dei": {"Assets": {"units": {"USD": [f("2020-12-31", "10-K", "2021-02-01")]}}}}),
        "{not json",
    ]
    raw = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "doc string, json string")
    parsed, failed = parse_company_facts(raw)
    assert failed.count() == 1
    got = {(r.cik, r.variable_name, r.fiscal_year): (r.value, r.source_tag) for r in annual_series(parsed).collect()}
    assert got[(1, "assets", 2020)] == (1.0, "Assets")
    assert (1, "assets", 2019) not in got              # FY rows exist in the list -> Q4 row dropped
    assert got[(2, "revenue", 2020)] == (7.0, "Revenues")
    assert not any(k[0] == 3 for k in got)


def test_position_and_macro_files(spark, tmp_path):
    """Own files in the inputs' shapes, the footer row with the mean included."""
    (tmp_path / "position.csv").write_text(
        "country,sect,t,upstreamness,source\nusa ,2,2014,2.5,ADB\nUSA,16,2015,1.5, adb\nCHN,2,2014,3.5,adb\nUSA,3,x,oops,wiod\n,,,2.0,\n")
    pos = read_position(spark, f"file://{tmp_path}/position.csv")
    assert pos.count() == 5
    kept = pos.where((F.col("country") == "USA") & (F.col("source") == "adb"))
    assert sorted((r.sect, r.year, r.upstreamness) for r in kept.collect()) == [(2, 2014, 2.5), (16, 2015, 1.5)]
    assert pos.where(F.col("country").isNull()).select("year").first()[0] is None  # the footer goes with the filter
    (tmp_path / "gdp.csv").write_text("observation_date,value\n1/1/2015,18206.0\n2016-01-01,NA\n31/12/2017,19612.1\nbad,1\n")
    gdp = read_macro(spark, str(tmp_path / "gdp.csv"), "gdpca")
    assert sorted((r.year, r.gdpca) for r in gdp.collect()) == [(2015, 18206.0), (2016, None), (2017, 19612.1)]


def test_sector_pipeline(spark):
    from aftershock.plans.sectors import (attach_to_firms, classify_firms, panel_to_wide, position_panel,
                                          sector_coverage, sector_lookup, sector_panel)
    sectors = spark.createDataFrame([("2", "Mining", "ADB "), ("2", "Mining", "adb"), ("16", "Other mfg", "adb"),
                                     ("3", "Food", "wiod")], "sect string, sect_name string, source string")
    pos = spark.createDataFrame([("usa", 2, 2014, 2.5, "adb"), ("USA", 2, 2015, 2.4, "ADB"), ("USA", 16, 2014, 1.5, "adb"),
                                 ("USA", None, 2014, 1.7, "adb"), ("USA", 2, 2013, 9.9, "adb"), ("CHN", 2, 2014, 9.9, "adb")],
                                "country string, sect int, year int, upstreamness double, source string")
    firms = spark.createDataFrame([
        ("Devon Energy", "US", None, "DVN"), ("Cheese Co", "US", "111", "CHZ"), ("Widgets", "US", "3312", "WID"),
        ("Foreign", "DE", "0610", "FOR"), ("Plain", "US", "text", "PLN")],
        "company_name string, country_iso string, nace string, ticker string")
    lk = sector_lookup(sectors)
    assert lk.count() == 2
    cls = {r.ticker: r for r in classify_firms(firms, lk).collect()}
    assert cls["DVN"].adb_sector_code == 2 and cls["DVN"].adb_sector_name == "Mining"   # name rule fill
    assert cls["CHZ"].nace_code_4d == "0111" and cls["CHZ"].adb_sector_code == 1
    assert cls["WID"].adb_sector_code == 16 and "FOR" not in cls
    assert cls["PLN"].adb_sector_code is None
    panel = sector_panel(classify_firms(firms, lk), position_panel(pos, lk))
    got = sorted((r.ticker, r.year) for r in panel.where(F.col("ticker") == "DVN").collect())
    assert got == [("DVN", 2014), ("DVN", 2015)]
    cov = sector_coverage(panel).first()
    assert cov.unique_companies == 4 and cov.incomplete_companies == 4
    wide = panel_to_wide(panel, [2014, 2015])
    assert wide.columns[-4:] == ["upstream(2014)", "downstream(2014)", "upstream(2015)", "downstream(2015)"]
    j = {r.ticker: r for r in attach_to_firms(firms.select("ticker", "company_name"), wide).collect()}
    assert j["WID"]["upstream(2014)"] == 1.5 and j["WID"]["upstream(2015)"] is None
    assert j["DVN"]["upstream(2015)"] is None   # null NACE key: the pivot drops the firm (T11)


def test_shapley_constant_feature_gets_zero(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    from aftershock.operators.attribution import shapley_importance
    rnd = random.Random(11)
    rows = []
    for i in range(120):
        a = rnd.random()
        rows.append((i, Vectors.dense([a, 1.0, rnd.random()]), int(a + 0.2 * rnd.random() > 0.6)))
    df = spark.createDataFrame(rows, ["id", "features", "y"])
    m = LogisticRegression(featuresCol="features", labelCol="y").fit(df)
    got = {r.feature: r.mean_abs_shap for r in shapley_importance(m, df, "features", "id", ["a", "const", "noise"],
                                                                    nsim=10).collect()}
    assert got["const"] == 0.0 and got["a"] > got["noise"]


def test_domain_firm_pipeline(spark):
    from aftershock.plans.firms import firm_disaster, firm_metrics_long, predictors
    from pyspark.sql import types as T
    cols = ["ticker", "company_name", "BRANCH - State or province (in US or Canada)", "assets_2019",
            "assets_current_2019", "revenue_2019", "Number of employees\nLast avail. yr 2019",
            "upstream(2019)", "downstream(2019)", "liabilities_2019"]
    schema = T.StructType([T.StructField(c, T.StringType() if i < 3 or i in (5, 6) else T.DoubleType())
                           for i, c in enumerate(cols)])
    sheet = spark.createDataFrame([("AAA", "Alpha", "TX, OH, ZZ", 10.0, 4.0, "1,200", "35", 2.1, 1.1, 9.0),
                                   ("BBB", "Beta", "TX", 20.0, 5.0, "bad", None, 1.5, 1.4, 9.0)], schema)
    lng = firm_metrics_long(sheet)
    got = {(r.ticker, r.States, r.metric): r.value for r in lng.collect()}
    assert got[("AAA", "Texas", "revenue")] == 1200.0 and got[("BBB", "Texas", "revenue")] is None
    assert got[("AAA", "Ohio", "Number of employees")] == 35.0
    assert ("AAA", "Texas", "assets_current") in got and not any(k[2] == "liabilities" for k in got)
    assert not any(k[1] is None for k in got)   # unknown abbreviation ZZ dropped
    ev = spark.createDataFrame([("Storm A", "2019-08-25", "2019/8/30", "Ohio, Texas", 5.0),
                                ("Storm B", "2019-09-01", "2019-09-01", "Maine", 1.0),
                                ("Old", "2010-01-01", "2010-01-02", "Texas", 1.0)],
                               "event_name string, start_date string, end_date string, affected_states string, total_damage_adjusted double")
    fd = firm_disaster(ev, lng, ["assets", "assets_current", "revenue", "Number of employees"])
    rows = {(r.ticker, r.event_name): r for r in fd.collect()}
    assert rows[("AAA", "Storm A")].affected_states == "Ohio"      # first state position wins (T13)
    assert rows[("BBB", "Storm A")].revenue is None and rows[("AAA", "Storm A")].upstream == 2.1
    assert (None, "Storm B") in rows and not any(k[1] == "Old" for k in rows)
    rec = spark.createDataFrame([("Storm A", "AAA", None, 10.0, 3, 1, 1)],
                                "event_name string, ticker string, pre_shock_date date, pre_shock_price double, "
                                "recovery_days int, benchmark_available int, recovered_by_end int")
    gdp = spark.createDataFrame([(2019, 1.0)], "year int, gdpca double")
    inf = spark.createDataFrame([(2019, 2.0)], "year int, inflation double")
    pr = {(r.ticker, r.event_name): r for r in predictors(fd, rec, gdp, inf).collect()}
    a = pr[("AAA", "Storm A")]
    assert a.duration == 5 and a.rec_7d == 1 and a.rec_1d == 0 and a.region == "Midwest" and a.gdpca == 1.0
    assert ("BBB", "Storm A") in pr and pr[("BBB", "Storm A")].region == "South"
    assert not any(k[0] is None for k in pr)


def test_category_ordinal_and_sample_rows(spark):
    from aftershock.operators.stress import category_ordinal, sample_rows
    df = spark.createDataFrame([(1, "West"), (2, "Midwest"), (3, None), (4, "West")], "id int, region string")
    got = {r.id: r.o for r in category_ordinal(df, "region", "o").collect()}
    assert got == {1: 2.0, 2: 1.0, 3: None, 4: 2.0}
    big = spark.createDataFrame([(i,) for i in range(100)], "id int")
    a = [r.id for r in sample_rows(big, 10, 4101, "id").collect()]
    b = [r.id for r in sample_rows(big.repartition(7), 10, 4101, "id").collect()]
    assert len(a) == 10 and a == b


def test_exact_quantiles_match_numpy(spark):
    from aftershock.operators.aggregate import exact_quantiles
    rnd = random.Random(9)
    vals = [rnd.choice([1.0, 2.0, 2.0, 5.5]) * rnd.random() * 100 for _ in range(777)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    want = np.quantile([v for v in vals if v is not None], [0.0, 0.25, 0.5, 0.75, 1.0])
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_directory_layouts_and_csv_io(spark, tmp_path):
    from aftershock.sources.csv import read_csv, read_optional
    from aftershock.sources.json_facts import directory_rows
    from aftershock.sources.sinks import write_csv
    fields = spark.createDataFrame([(["cik", "name", "ticker"], [["320193", "Apple Inc.", "AAPL"], ["1", "X", "x"]])],
                                   "fields array<string>, data array<array<string>>")
    got = sorted(tuple(r) for r in directory_rows(fields).collect())
    assert got == [("1", "X", "x"), ("320193", "Apple Inc.", "AAPL")]
    recs = spark.createDataFrame([(320193, "Apple Inc.", "AAPL")], "cik long, name string, ticker string")
    assert directory_rows(recs).first()["cik"] == "320193"
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    out = str(tmp_path / "out_csv")
    write_csv(df, out, na_text="NA")
    back = read_csv(spark, out, "a int, b string", na_text="NA")
    assert sorted(tuple(r) for r in back.collect()) == [(1, None), (2, "b")]
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("orbis_company_name", T.StringType())])
    assert read_optional(spark, str(tmp_path / "absent.csv"), schema).count() == 0
    (tmp_path / "there.csv").write_text("orbis_company_name\nAlpha\n")
    for path in (f"{tmp_path}/there.csv", f"file://{tmp_path}/there.csv"):
        assert read_optional(spark, path, schema, ["orbis_company_name"]).count() == 1


def test_smote_neighbours_and_counts(spark):
    from pyspark.ml.linalg import Vectors
    from aftershock.operators.learn import smote
    rnd = random.Random(2)
    rows = [(i, Vectors.dense([rnd.random(), rnd.random()]), 0) for i in range(60)]
    rows += [(100 + i, Vectors.dense([5 + (i % 5) * 0.1, 5 + (i // 5) * 0.1]), 1) for i in range(20)]
    out = smote(spark.createDataFrame(rows, ["id", "features", "y"]), "features", "y", "id", k=3, seed=1)
    syn = out.where(F.col("synthetic") == 1).collect()
    assert len(syn) == 20 * ((60 - 20) // 20)
    for r in syn:   # interpolated between minority rows: stays inside the minority square
        x, y = r.features
        assert 4.99 <= x <= 5.41 and 4.99 <= y <= 5.31 and r.y == 1


def test_yes_no_and_drop_report(spark):
    from aftershock.operators.filters import drop_any_null_report
    from aftershock.operators.flags import yes_no
    df = spark.createDataFrame([(1, 1.0, 2.0), (0, None, 2.0), (None, None, None)], "y int, gdp double, infl double")
    assert [r[0] for r in df.select(yes_no("y")).collect()] == ["yes", "no", None]
    kept, report = drop_any_null_report(df, ["gdp", "infl"])
    assert kept.count() == 1
    assert {r.column: (r.null_rows, r.dropped_rows) for r in report.collect()} == {"gdp": (2, 2), "infl": (1, 2)}


def test_multisplit_selects_the_signal(spark):
    from pyspark.ml.linalg import Vectors
    from aftershock.operators.learn import multisplit_selection, smote
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 1)
        rows.append((i, Vectors.dense([a, b]), int(a + 0.3 * rnd.gauss(0, 1) > 0.8)))
    df = spark.createDataFrame(rows, ["id", "features", "y"])
    out = multisplit_selection(df, "features", "y", "id", ["signal", "noise"], splits=2,
                               lambdas=(0.05, 0.01), folds=3, seed=1,
                               balance=lambda d: smote(d, "features", "y", "id", seed=1))
    sel = {(f, s): sel for f, s, p, sel in out}
    assert sel[("signal", 0)] == 1 and sel[("signal", 1)] == 1
    assert all(0.0 <= p <= 1.0 for _, _, p, _ in out)


def test_permutation_importance_and_glm_pvalues(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    from aftershock.operators.learn import glm_pvalues, permutation_importance
    rnd = random.Random(8)
    rows = []
    for i in range(200):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 1)
        rows.append((i, Vectors.dense([a, 1.0, b]), int(a + 0.5 * rnd.gauss(0, 1) > 0)))
    df = spark.createDataFrame(rows, ["id", "features", "y"])
    m = LogisticRegression(featuresCol="features", labelCol="y").fit(df)
    imp = dict(permutation_importance(m, df, "features", "y", "id", ["signal", "const", "noise"], seed=3))
    assert imp["const"] == 0.0 and imp["signal"] > 0.1 and imp["signal"] > imp["noise"]
    p = glm_pvalues(df, "features", "y", [0, 2])
    assert p[0] < 1e-6 and 0.0 <= p[2] <= 1.0


def test_fits_of_the_learning_queries_are_spread(spark, monkeypatch):
    from aftershock.operators.learn import _cached
    from aftershock.plans import learn
    rows = spark.range(400).select("id", F.col("id").alias("doc_id"))
    spread = []

    def fits(df, *args, partitions=None, **kw):
        spread.append(_cached(rows, "doc_id", partitions).where("id % 2 = 0").rdd.glom().map(len).collect())
        return {"sizes": [(2, 0.5)], "best_size": 2} if "names" not in kw and len(args) > 4 else [("a", 0, 1.0, 0)]

    monkeypatch.setattr(learn, "_prepared", lambda *a: (rows, rows, ["a"]))
    monkeypatch.setattr(learn, "_balanced", lambda train: train)
    monkeypatch.setattr(learn, "rfe", fits)
    monkeypatch.setattr(learn, "multisplit_selection", fits)
    for query in (learn.rf_rfe, learn.gbt_rfe, learn.lasso_multisplit):
        query(spark, "").count()
    for parts in spread:
        assert len(parts) >= 64 and sum(n > 0 for n in parts) > 32
    assert len(spread) == 3


def test_prepared_rows_are_the_split_read_from_what_was_written(spark):
    from aftershock.operators.split import stratified_split
    from aftershock.plans import learn
    frame = spark.createDataFrame(
        [(i, int(i % 4 == 0), 0, "en" if i % 3 else "de", f"s{i % 5}", float(i), 1.0, float(i % 7), 0.1, 0.5) for i in range(100)],
        "doc_id long, quality int, toxic int, lang string, source string, n_chars double, n_lines double, n_words double, "
        "digit_share double, position double")
    train, test, names = learn._prepared(spark, "", frame=frame)
    want = {r.doc_id: r.split for r in stratified_split(frame, "doc_id", "quality", learn.SEED).collect()}
    got = {r.doc_id: side for side, rows in (("train", train), ("test", test)) for r in rows.collect()}
    assert got == want and train.columns == ["doc_id", "y", "features"]
    assert train.where("y = 1").count() == 20 and len(train.first().features) == len(names)
    assert all("/design-" in f for f in train.inputFiles())


def test_logit_predicts_on_the_selected_columns(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    from aftershock.operators.learn import logit_predict
    from aftershock.plans import learn
    rnd = random.Random(5)
    rows = [(i, Vectors.dense([rnd.gauss(0, 1), rnd.gauss(0, 1)])) for i in range(200)]
    df = spark.createDataFrame([(i, x, int(x[0] + rnd.gauss(0, 1) > 0.5)) for i, x in rows], ["doc_id", "features", "y"])
    share = df.agg(F.avg("y")).first()[0]
    assert {r.score for r in logit_predict(df, df, "features", "y", []).collect()} == {share}
    one = [r.score for r in logit_predict(df, df, "features", "y", [0]).orderBy("doc_id").collect()]
    order = sorted(range(200), key=lambda i: rows[i][1][0])
    assert all(one[a] < one[b] for a, b in zip(order, order[1:]))  # the other column has no part in it

    table = spark.createDataFrame([("b", 1), ("a", 0)], "feature string, Selected int")
    seen = []
    monkeypatch.setattr(learn, "_prepared", lambda *a: (df, df, ["a", "b"]))
    monkeypatch.setattr(learn, "_balanced", lambda train: train)
    monkeypatch.setattr(learn, "_selection", lambda *a: table)
    monkeypatch.setattr(learn, "_logit", lambda train, test, f, y, cols: seen.append(cols) or test.withColumn("score", F.lit(0.5)))
    learn.logit_predict(spark, "").count()
    assert seen == [[1]]


def test_years_outside_the_pivot_list_are_an_error(spark, monkeypatch):
    from aftershock.plans import reshape
    long = spark.createDataFrame([(1, 1995, 2.0, 1.0), (1, 2002, 3.0, 1.0)], "c_custkey int, year int, spend double, orders double")
    monkeypatch.setattr(reshape, "panel_long", lambda *a: long.where("year < 2002"))
    queries = (reshape.panel_wide, reshape.pivot_panel_first, reshape.pivot_wide_years_desc)
    assert all(q(spark, "").collect()[0]["c_custkey"] == 1 for q in queries)
    monkeypatch.setattr(reshape, "panel_long", lambda *a: long)
    for q in queries:
        with pytest.raises(Exception, match="not in the pivot list: 2002"):
            q(spark, "").collect()
