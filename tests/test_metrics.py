import numpy as np
import pytest
from pyspark.sql import functions as F

from ligandspark.operators import metrics as M

SCORES = [0.9, 0.8, 0.8, 0.4, 0.3, 0.1, 0.05]
LABELS = [1, 0, 1, 1, 0, 0, 1]


def _df(spark, scores=SCORES, labels=LABELS, g=None):
    rows = [(float(s), int(y), 0 if g is None else g[i]) for i, (s, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "p double, y int, g int")


@pytest.mark.parametrize("forced", [False, True])
def test_ranking_fixture(spark, request, forced):
    if forced:
        request.getfixturevalue("buckets")
    r = M.ranking_metrics(_df(spark), ["g"], "p", "y").first()
    assert r["roc_auc"] == pytest.approx(0.625)
    assert r["average_precision"] == pytest.approx(0.747024, abs=1e-6)
    assert r["pr_auc_trapezoid"] == pytest.approx(0.769345, abs=1e-6)


def _brute_auc(s, y):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _brute_ap(s, y):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap = 0.0
    for t in order:
        tp = sum(1 for a, b in zip(s, y) if a >= t and b == 1)
        fp = sum(1 for a, b in zip(s, y) if a >= t and b == 0)
        pos_t = sum(1 for a, b in zip(s, y) if a == t and b == 1)
        ap += pos_t / P * tp / (tp + fp)
    return ap


def test_ranking_random_groups_bucketed(spark, buckets):
    rng = np.random.RandomState(3)
    n = 600
    g = [0 if i < 200 else int(rng.randint(1, 5)) for i in range(n)]   # a hot group
    s = list(np.round(rng.rand(n), 2))                                  # many ties
    y = [int(v) for v in (rng.rand(n) < 0.3)]
    res = {r["g"]: r for r in M.ranking_metrics(_df(spark, s, y, g), ["g"], "p", "y").collect()}
    for key in set(g):
        ss = [a for a, k in zip(s, g) if k == key]
        yy = [b for b, k in zip(y, g) if k == key]
        assert res[key]["roc_auc"] == pytest.approx(_brute_auc(ss, yy), abs=1e-12)
        assert res[key]["average_precision"] == pytest.approx(_brute_ap(ss, yy), abs=1e-12)


def test_auc_properties(spark):
    a = M.ranking_metrics(_df(spark), [], "p", "y").first()["roc_auc"]
    neg = _df(spark).withColumn("p", -F.col("p"))
    b = M.ranking_metrics(neg, [], "p", "y").first()["roc_auc"]
    mono = _df(spark).withColumn("p", F.exp(F.col("p") * 3))
    c = M.ranking_metrics(mono, [], "p", "y").first()["roc_auc"]
    assert b == pytest.approx(1 - a) and c == pytest.approx(a)
    perfect = M.ranking_metrics(_df(spark, [0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0]), [], "p", "y").first()
    assert perfect["roc_auc"] == 1.0 and perfect["average_precision"] == 1.0
    assert perfect["pr_auc_trapezoid"] == 1.0


def test_single_class_auc_null(spark):
    r = M.ranking_metrics(_df(spark, [0.2, 0.7], [1, 1]), [], "p", "y").first()
    assert r["roc_auc"] is None


def test_specificity_without_negatives_and_thresholds(spark):
    d = _df(spark, [0.5, 0.9], [1, 1])
    r7 = M.report7(d, ["g"], "p", "y").first()
    assert r7["specificity"] == 1.0 and r7["recall"] == 0.5     # 0.5 is not > 0.5
    r9 = M.report9(d, ["g"], "p", "y").first()
    assert r9["rec"] == 1.0 and r9["sp"] is None                 # 0.5 >= 0.5


def test_loss_finite_at_extremes(spark):
    d = spark.createDataFrame([(800.0, 0), (-800.0, 1), (800.0, 1)], "x double, y int")
    vals = [r[0] for r in d.select(M.weighted_bce(F.col("x"), F.col("y"), 2.0)).collect()]
    assert all(np.isfinite(vals)) and vals[0] == pytest.approx(800.0) and vals[1] == pytest.approx(1600.0)


def test_regression_metrics(spark):
    d = spark.createDataFrame([(1.0, 1.5, 1.0), (2.0, 2.0, 1.0), (4.0, 3.0, 0.0)], "y double, p double, mask double")
    r = M.regression_metrics(M.masked(d), [], "y", "p").first()
    assert r["n"] == 2 and r["l1_mean"] == pytest.approx(0.25) and r["mse"] == pytest.approx(0.125)
    with pytest.raises(ValueError):
        M.compute_metric(d, "accuracy")


def test_only_hot_groups_split(spark, monkeypatch):
    """Grouped scan with the real hot-group rule: one group above the row
    threshold is split into ranges, the small ones are not; results exact."""
    from ligandspark.plans import scan
    monkeypatch.setattr(scan, "RANGE_ROWS", 100)
    rng = np.random.RandomState(9)
    n = 400
    g = [0 if i < 250 else int(rng.randint(1, 6)) for i in range(n)]
    s = list(np.round(rng.rand(n), 3))      # > 100 distinct scores in group 0, some ties
    y = [int(v) for v in (rng.rand(n) < 0.4)]
    d = _df(spark, s, y, g)
    counts = M.score_counts(d, ["g"], "p", "y")
    per = {r["g"]: r["c"] for r in counts.groupBy("g").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert per[0] > 100 and all(v <= 100 for k, v in per.items() if k != 0)
    b = scan.assign_ranges(counts, ["g"], "_score").df
    nb = {r["g"]: r["nb"] for r in b.groupBy("g").agg(F.countDistinct("_range").alias("nb")).collect()}
    assert nb[0] > 1 and all(v == 1 for k, v in nb.items() if k != 0)
    res = {r["g"]: r for r in M.metrics_from_curve(M.curve_from_counts(counts, ["g"]), ["g"]).collect()}
    for key in set(g):
        ss = [a for a, k in zip(s, g) if k == key]
        yy = [b for b, k in zip(y, g) if k == key]
        assert res[key]["roc_auc"] == pytest.approx(_brute_auc(ss, yy), abs=1e-12)
        assert res[key]["average_precision"] == pytest.approx(_brute_ap(ss, yy), abs=1e-12)
