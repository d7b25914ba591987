"""Modelling support on driver tables: metrics (M14-M16), splits (W9, M2),
outcome stress (A15, X19, W10, L5), p-value aggregation (A16, M7, M8) and the
feature comparison table (J8, W8, M20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.functions.hashing import seeded_hash_sql
from aftershock.functions.constants import (QUANTILE_LEVELS, SEED, STRESS_BASE, STRESS_CLAMP,
                                            STRESS_INTERACTIONS, STRESS_TAILS, STRESS_WEIGHTS)
from aftershock.operators.metrics import pr_auc as _pr, roc_auc as _roc, roc_points as _points
from aftershock.operators.selection import aggregate_pvalues, compare_features, rank_features
from aftershock.operators.split import chrono_group_split as _chrono, stratified_split as _strat
from aftershock.operators.stress import linear_score as _lin, sample_groups as _sample, tail_overwrite as _tail
from aftershock.operators.stress import category_ordinal, sample_rows as _sample_rows, zscores
from aftershock.sources.tables import table

# proxy variables of the stress score: damage <- spend, duration <- orders,
# liquidity_ratio <- account balance; the other weighted variables are absent (z = 0)
STRESS_PROXY = {"damage": "z_spend", "duration": "z_orders", "liquidity_ratio": "z_acctbal",
                "region_ordinal": "z_segment_ord"}
SAMPLE_GROUPS = 10
N_SPLITS_PROXY = 10


def _scored(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id")


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roc(_scored(spark, sf_dir), "n_chars", "quality")


def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pr(_scored(spark, sf_dir), "n_chars", "quality")


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(_scored(spark, sf_dir), "n_chars", "quality")


def chrono_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events = customers, each with many order dates; customers divisible by 97
    are one event without a name; the earliest 80% of events train."""
    event = F.when(F.col("o_custkey") % 97 != 0, F.col("o_custkey")).alias("event")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", event)
    return _chrono(o, ["event"], ["o_orderdate"]).select("o_orderkey", "split")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strat(table(spark, sf_dir, "labels"), "doc_id", "quality", SEED).select("doc_id", "quality", "split")


def _customer_features(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).cast("double").alias("orders"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    c = category_ordinal(c, "c_mktsegment", "segment_ord").drop("c_mktsegment")  # X22
    return c.join(o, "c_custkey", "left")


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zscores(_customer_features(spark, sf_dir), ["acctbal", "spend", "orders"])
    return z.select("c_custkey", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in ["acctbal", "spend", "orders"]])


def _linear(spark, sf_dir) -> DataFrame:
    z = zscores(_customer_features(spark, sf_dir), ["acctbal", "spend", "orders", "segment_ord"])
    return _lin(z, STRESS_BASE, STRESS_WEIGHTS, STRESS_INTERACTIONS, STRESS_PROXY, STRESS_CLAMP)


def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear(spark, sf_dir).select("c_custkey", "score")


def tail_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tail(_linear(spark, sf_dir), "score", "c_custkey", STRESS_TAILS["zero_share"],
              STRESS_TAILS["long_share"], STRESS_TAILS["cap"])
    flags = {f"rec_{k}d": (F.col("recovery_days") <= k).cast("int") for k in (1, 7, 30, 180)}
    return t.withColumns(flags).select("c_custkey", "score", "recovery_days", *flags)


def sample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("event_date"))
    return _sample(o, "event_date", SAMPLE_GROUPS)


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: a seeded sample of 10 orders (hash order, reproducible)."""
    return _sample_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, SEED, "o_orderkey")


def _split_pvalues(spark, sf_dir) -> DataFrame:
    """One p-value per (feature, split), as the multi-split procedure makes:
    feature = market segment, split = customer key mod 10, p = mean of
    clamp(balance / 10000, 0, 1) over the customers of that cell."""
    c = table(spark, sf_dir, "customer")
    return (c.groupBy(F.col("c_mktsegment").alias("feature"), (F.col("c_custkey") % N_SPLITS_PROXY).alias("split"))
            .agg(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000))).alias("p")))


def pvalue_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = aggregate_pvalues(_split_pvalues(spark, sf_dir), "feature", "p", QUANTILE_LEVELS)
    return agg.select("feature", F.round("p_agg", 6).alias("p_agg"), "d_min", "n_values")


def _importance_tables(spark, sf_dir):
    sp = _split_pvalues(spark, sf_dir)
    per_split = sp.withColumnRenamed("p", "mp")
    vim = per_split.groupBy("feature").agg(
        (F.sum((F.col("mp") < 0.5).cast("int")) / F.lit(float(N_SPLITS_PROXY))).alias("VIM"))
    p = aggregate_pvalues(sp, "feature", "p", QUANTILE_LEVELS).select("feature", F.col("p_agg").alias("pValue"))
    ms = vim.join(p, "feature").withColumnRenamed("feature", "Feature")
    ms = ms.withColumn("MultiSplit_Selected", ((F.col("VIM") > 0.75) & (F.col("pValue") < 0.05)).cast("int"))
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rf = (c.join(n, c.c_nationkey == n.n_nationkey)
          .groupBy(F.col("n_name").alias("Feature")).agg((F.avg(F.abs("c_acctbal")) / 1000).alias("RF_SHAP")))
    xgb = c.groupBy(F.col("c_mktsegment").alias("Feature")).agg(
        (F.avg(F.abs(F.col("c_acctbal") - 4500)) / 1000).alias("XGB_SHAP"))
    return ms, rf, xgb


def feature_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 ranks per table, J8 left-join chain from the distinct union of
    feature names, missing selection flag -> 0."""
    ms, rf, xgb = _importance_tables(spark, sf_dir)
    ms = rank_features(ms, [F.col("VIM").desc(), F.col("pValue").asc(), F.col("Feature")], "MultiSplit_Rank")
    rf = rank_features(rf, [F.col("RF_SHAP").desc(), F.col("Feature")], "RF_SHAP_Rank")
    xgb = rank_features(xgb, [F.col("XGB_SHAP").desc(), F.col("Feature")], "XGB_SHAP_Rank")
    r = {c: F.round(c, 6) for c in ["VIM", "pValue", "RF_SHAP", "XGB_SHAP"]}
    return compare_features(ms, rf, xgb).withColumns(r)


QUERIES = {
    "roc_auc": roc_auc,
    "pr_auc": pr_auc,
    "roc_points": roc_points,
    "chrono_group_split": chrono_group_split,
    "stratified_split": stratified_split,
    "zscore": zscore,
    "linear_score": linear_score,
    "tail_overwrite": tail_overwrite,
    "sample_groups": sample_groups,
    "sample_rows": sample_rows,
    "pvalue_quantile": pvalue_quantile,
    "feature_compare": feature_compare,
}

_SC = """d AS (SELECT CAST(dd.n_chars AS DOUBLE) AS score, l.quality AS y FROM labels l
             JOIN documents dd ON dd.doc_id = l.doc_id WHERE dd.n_chars IS NOT NULL AND l.quality IS NOT NULL),
g AS (SELECT score, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
             CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM d GROUP BY score),
c AS (SELECT score, pos, neg,
             sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM g),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)"""

_FEAT = """cf AS (SELECT c.c_custkey, c.c_acctbal AS acctbal, o.spend, o.orders,
    CAST(dense_rank() OVER (ORDER BY c.c_mktsegment) AS DOUBLE) AS segment_ord FROM customer c LEFT JOIN
  (SELECT o_custkey, sum(o_totalprice) AS spend, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1) o
  ON o.o_custkey = c.c_custkey),
st AS (SELECT avg(acctbal) ma, stddev_samp(acctbal) sa, avg(spend) ms, stddev_samp(spend) ss,
              avg(orders) mo, stddev_samp(orders) so, avg(segment_ord) mg, stddev_samp(segment_ord) sg FROM cf),
z AS (SELECT c_custkey,
  coalesce(CASE WHEN sa > 0 THEN (acctbal - ma) / sa END, 0) AS z_acctbal,
  coalesce(CASE WHEN ss > 0 THEN (spend - ms) / ss END, 0) AS z_spend,
  coalesce(CASE WHEN so > 0 THEN (orders - mo) / so END, 0) AS z_orders,
  coalesce(CASE WHEN sg > 0 THEN (segment_ord - mg) / sg END, 0) AS z_segment_ord FROM cf, st)"""


def _lin_sql() -> str:
    terms = [f"{STRESS_BASE}"]
    for name, w in STRESS_WEIGHTS.items():
        if name in STRESS_PROXY:
            terms.append(f"({w}) * {STRESS_PROXY[name]}")
    for a, b, w in STRESS_INTERACTIONS:
        if a in STRESS_PROXY and b in STRESS_PROXY:
            terms.append(f"({w}) * {STRESS_PROXY[a]} * {STRESS_PROXY[b]}")
    lo, hi = STRESS_CLAMP
    return (f"lin AS (SELECT c_custkey, greatest({lo}, least({hi}, round_even({' + '.join(terms)}, 0))) AS score "
            f"FROM z)")


_LEVELS = "CAST([" + ", ".join(str(x) for x in QUANTILE_LEVELS) + "] AS DOUBLE[])"
_PV = f"""sp AS (SELECT c_mktsegment AS feature, c_custkey % 10 AS split,
                   avg(greatest(0.0, least(1.0, c_acctbal / 10000))) AS p FROM customer GROUP BY 1, 2),
qa AS (SELECT feature, quantile_cont(p, {_LEVELS}) AS q, count(p) AS n_values FROM sp GROUP BY 1),
ra AS (SELECT feature, n_values, list_transform(range(1, 97), lambda i: q[i] / ({_LEVELS})[i]) AS r FROM qa),
pa AS (SELECT feature, n_values, least(1.0, 4 * list_min(r)) AS p_agg,
              ({_LEVELS})[list_position(r, list_min(r))] AS d_min FROM ra)"""

ORACLE = {
    "stratified_split": f"""
SELECT doc_id, quality,
       CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {seeded_hash_sql("doc_id", SEED)}, doc_id)
                 <= ceil(0.8 * count(*) OVER (PARTITION BY quality)) THEN 'train' ELSE 'test' END AS split
FROM labels""",
    "sample_rows": f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {seeded_hash_sql("o_orderkey", SEED)}, o_orderkey LIMIT 10""",
    "roc_auc": f"""WITH {_SC}
SELECT round(CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(neg * (tp - pos + 0.5 * pos)) / (max(P) * max(N)) END, 6)
         AS roc_auc, CAST(coalesce(max(P), 0) AS BIGINT) AS n_pos, CAST(coalesce(max(N), 0) AS BIGINT) AS n_neg
FROM c, t""",
    "pr_auc": f"""WITH {_SC},
s AS (SELECT pos, neg, tp, fp, tp - pos AS tpa, fp - neg AS fpa,
             CAST(neg AS DOUBLE) / nullif(pos, 0) AS sl FROM c),
a AS (SELECT CASE WHEN pos = 0 THEN 0.0
                  WHEN fpa - sl * tpa = 0 THEN pos / (1 + sl)
                  ELSE pos / (1 + sl) - (fpa - sl * tpa) / ((1 + sl) * (1 + sl))
                       * ln(CAST(tp + fp AS DOUBLE) / (tpa + fpa)) END AS seg FROM s)
SELECT round(CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(seg) / max(P) END, 6) AS pr_auc FROM a, t""",
    "roc_points": f"""WITH {_SC}
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr FROM c, t""",
    "chrono_group_split": """
WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_custkey % 97 <> 0 THEN o_custkey END AS event FROM orders),
ev AS (SELECT event, min(o_orderdate) AS d FROM o GROUP BY 1),
n AS (SELECT count(*) AS n FROM ev),
r AS (SELECT event, row_number() OVER (ORDER BY d NULLS LAST, event NULLS LAST) AS k FROM ev)
SELECT o.o_orderkey, CASE WHEN r.k <= floor(0.8 * n.n) THEN 'train' ELSE 'test' END AS split
FROM o JOIN r ON r.event IS NOT DISTINCT FROM o.event, n""",
    "zscore": f"""WITH {_FEAT}
SELECT c_custkey, round(z_acctbal, 6) AS z_acctbal, round(z_spend, 6) AS z_spend, round(z_orders, 6) AS z_orders
FROM z""",
    "linear_score": f"WITH {_FEAT}, {_lin_sql()} SELECT c_custkey, score FROM lin",
    "tail_overwrite": f"""WITH {_FEAT}, {_lin_sql()},
n AS (SELECT count(*) AS n FROM lin),
r AS (SELECT c_custkey, score, row_number() OVER (ORDER BY score, c_custkey) AS lo,
             row_number() OVER (ORDER BY score DESC, c_custkey) AS hi FROM lin),
t AS (SELECT c_custkey, score,
        CASE WHEN lo <= greatest(1, round_even({STRESS_TAILS['zero_share']} * n, 0)) THEN 0.0
             WHEN hi <= greatest(1, round_even({STRESS_TAILS['long_share']} * n, 0))
               THEN greatest(score, {STRESS_TAILS['cap'] + 1})
             ELSE least(score, {STRESS_TAILS['cap']}) END AS recovery_days FROM r, n)
SELECT c_custkey, score, recovery_days, """ + ", ".join(
        f"CAST(recovery_days <= {k} AS INTEGER) AS rec_{k}d" for k in (1, 7, 30, 180)) + " FROM t",
    "sample_groups": f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS event_date FROM orders
WHERE CAST(o_orderdate AS DATE) IN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders
                                    ORDER BY d LIMIT {SAMPLE_GROUPS})""",
    "pvalue_quantile": f"WITH {_PV}\nSELECT feature, round(p_agg, 6) AS p_agg, d_min, n_values FROM pa",
    "feature_compare": f"""WITH {_PV},
vim AS (SELECT feature, sum(CASE WHEN mp < 0.5 THEN 1 ELSE 0 END) / 10.0 AS VIM FROM
        (SELECT feature, split, p AS mp FROM sp) x GROUP BY 1),
ms AS (SELECT v.feature AS Feature, v.VIM, pa.p_agg AS pValue,
              CAST(v.VIM > 0.75 AND pa.p_agg < 0.05 AS INTEGER) AS MultiSplit_Selected,
              row_number() OVER (ORDER BY v.VIM DESC, pa.p_agg ASC, v.feature) AS MultiSplit_Rank
       FROM vim v JOIN pa ON pa.feature = v.feature),
rf AS (SELECT Feature, RF_SHAP, row_number() OVER (ORDER BY RF_SHAP DESC, Feature) AS RF_SHAP_Rank FROM
       (SELECT n.n_name AS Feature, avg(abs(c.c_acctbal)) / 1000 AS RF_SHAP FROM customer c
        JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1) a),
xg AS (SELECT Feature, XGB_SHAP, row_number() OVER (ORDER BY XGB_SHAP DESC, Feature) AS XGB_SHAP_Rank FROM
       (SELECT c_mktsegment AS Feature, avg(abs(c_acctbal - 4500)) / 1000 AS XGB_SHAP FROM customer GROUP BY 1) b),
names AS (SELECT Feature FROM ms UNION SELECT Feature FROM rf UNION SELECT Feature FROM xg)
SELECT names.Feature, round(ms.VIM, 6) AS VIM, round(ms.pValue, 6) AS pValue, CAST(ms.MultiSplit_Rank AS INTEGER)
         AS MultiSplit_Rank, coalesce(ms.MultiSplit_Selected, 0) AS MultiSplit_Selected,
       round(rf.RF_SHAP, 6) AS RF_SHAP, CAST(rf.RF_SHAP_Rank AS INTEGER) AS RF_SHAP_Rank,
       round(xg.XGB_SHAP, 6) AS XGB_SHAP, CAST(xg.XGB_SHAP_Rank AS INTEGER) AS XGB_SHAP_Rank
FROM names LEFT JOIN ms ON ms.Feature = names.Feature LEFT JOIN rf ON rf.Feature = names.Feature
LEFT JOIN xg ON xg.Feature = names.Feature""",
}
