"""Rows that used to get lost or wrong: NULL keys, large means, NaN scores, zero vectors, repeated ids."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ligandspark.operators import embed, history, knn, pivots
from ligandspark.operators import metrics as M
from ligandspark.operators.centroid import fold_centroid_scores
from ligandspark.operators.folds import stratified_folds
from ligandspark.functions.wavelets import wavelet_np
from ligandspark.operators.wavelet_layer import WaveletLayer
from ligandspark.plans.scan import RANGE_CONF, prefix_scan


@pytest.mark.parametrize("rows", [1_000_000, 20, 3, 1])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("grouped", [True, False])
def test_scan_is_a_plain_window(spark, rows, descending, grouped):
    rng = np.random.RandomState(1)
    data = [(None if i % 11 == 0 else int(rng.choice([0, 0, 0, 1, 2])),
             None if i % 7 == 0 else float("nan") if i % 31 == 0 else float(rng.randint(0, 40)),
             i, int(rng.randint(1, 5))) for i in range(120)]
    df = spark.createDataFrame(data, "g int, k double, i int, v int")
    by = ["g"] if grouped else []
    got = prefix_scan(df, by, "k", tiebreak=["i"], sums=["v"], maxes=["i"], mins=["v"], row_number="rn",
                      descending=descending, rows=rows)
    order = F.col("k").desc() if descending else F.col("k").asc()
    w = Window.partitionBy(*by).orderBy(order, "i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("cum_v"), F.max("i").over(w).alias("runmax_i"),
                     F.min("v").over(w).alias("runmin_v"), F.count(F.lit(1)).over(w).alias("rn"))
    cols = ["i", "cum_v", "runmax_i", "runmin_v", "rn"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert set(got.columns) == set(want.columns)


def test_scan_exclusive_in_ranges(spark):
    df = spark.createDataFrame([(0, float(i), i) for i in range(30)], "g int, k double, v int")
    got = prefix_scan(df, ["g"], "k", sums=["v"], maxes=["v"], inclusive=False, rows=4).orderBy("v").collect()
    assert [r["cum_v"] for r in got] == [sum(range(i)) for i in range(30)]
    assert [r["runmax_v"] for r in got] == [None, *range(29)]


def test_early_stop_jobs_when_split(spark):
    df = spark.createDataFrame([(r, e, float((e * 7) % 13)) for r in range(3) for e in range(1, 40)],
                               "run int, epoch int, score double")
    plain = sorted(map(tuple, history.early_stop(df, "run", "epoch", "score", 5).collect()))
    spark.conf.set(RANGE_CONF, "5")
    try:
        tracker, group = spark.sparkContext.statusTracker(), "early-stop-jobs"
        spark.sparkContext.setJobGroup(group, group)
        split = sorted(map(tuple, history.early_stop(df, "run", "epoch", "score", 5).collect()))
        jobs = tracker.getJobIdsForGroup(group)
    finally:
        spark.conf.unset(RANGE_CONF)
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert split == plain and len(jobs) <= 16       # with a job per shuffle and broadcast; once 81


def test_nan_scores_never_win(spark):
    rows = [(1, 1, 0.5), (1, 2, float("nan")), (1, 3, None), (1, 4, 0.9), (2, 1, float("nan"))]
    df = spark.createDataFrame(rows, "run int, epoch int, score double")
    best = {r["run"]: (r["best_epoch"], r["best_score"]) for r in history.best_epoch(df, "run", "epoch", "score").collect()}
    assert best == {1: (4, 0.9), 2: (None, None)}
    stop = {r["run"]: r["best_epoch"] for r in history.early_stop(df, "run", "epoch", "score", 10).collect()}
    assert stop == {1: 4, 2: None}
    run = [r["running_best"] for r in history.running_best(df.where("run = 1"), "run", "epoch", "score")
           .orderBy("epoch").collect()]
    assert run == [0.5, 0.5, 0.5, 0.9]


def test_centroids_at_a_large_mean(spark):
    rng = np.random.RandomState(2)
    x = rng.standard_normal((300, 3))
    x[:, 0] += 1e8
    y, fold = (rng.rand(300) < 0.5).astype(int), np.arange(300) % 3
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), int(fold[i])) for i in range(300)],
                               "id int, features array<double>, y int, fold int")
    got = {r["id"]: r["logit"] for r in fold_centroid_scores(df).collect()}
    for f in range(3):
        tr = fold != f
        m, s = x[tr].mean(0), x[tr].std(0)
        z = (x - m) / s
        pos, neg = z[tr & (y == 1)].mean(0), z[tr & (y == 0)].mean(0)
        for i in np.flatnonzero(fold == f):
            want = ((z[i] - neg) ** 2).sum() - ((z[i] - pos) ** 2).sum()
            assert got[i] == pytest.approx(want, abs=1e-4)


def test_r2_at_a_large_mean_and_missing_predictions(spark):
    rng = np.random.RandomState(3)
    y = 1e9 + rng.standard_normal(200)
    p = y + 0.2 * rng.standard_normal(200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    want = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert M.regression_metrics(df, [], "y", "p").first()["r2"] == pytest.approx(want, abs=1e-3)
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (5.0, float("nan")), (None, 1.0), (2.0, 3.7320508)],
                               "y double, p double")
    r = M.regression_metrics(df, [], "y", "p").first()
    assert (r["n"], r["n_dropped"]) == (2, 3) and r["mse"] == pytest.approx(2.0, abs=1e-6)


def test_null_labels_get_folds(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(20)], "id long, y int")
    for shuffle in (False, True):
        rows = stratified_folds(df, "y", "id", 4, shuffle=shuffle).collect()
        assert sorted(r["id"] for r in rows) == list(range(20)) and {r["fold"] for r in rows} == {0, 1, 2, 3}


def test_zero_and_nan_vectors_keep_their_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [float("nan"), 1.0]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, f array<double>")
    for metric in ("cosine", "euclidean"):
        got = knn.knn_neighbours(df, "id", "f", 4, metric=metric).collect()
        assert sorted((r["qid"], r["rank"]) for r in got) == [(i, k) for i in range(1, 6) for k in range(1, 5)]
    cos = {(r["qid"], r["rid"]): -r["dist"] for r in knn.knn_neighbours(df, "id", "f", 4, metric="cosine").collect()}
    assert cos[(1, 2)] == 0 and cos[(2, 4)] == 0 and cos[(2, 5)] == -1


def test_closest_is_a_stable_sort():
    rng = np.random.RandomState(4)
    for n in (1, 5, 40):
        q, r = rng.randint(0, 3, (50, 2)).astype(float), rng.randint(0, 3, (n, 2)).astype(float)
        r[rng.rand(n) < 0.1, 1] = np.nan
        bad = rng.rand(50, n) < 0.2
        d = ((q[:, None, :] - r[None, :, :]) ** 2).sum(axis=2)
        d = np.where(np.isnan(d), np.inf, d)
        for k in (1, 3, 10):
            qi, ri, dist = pivots.closest(q, r, k, bad.copy(), False)
            want = [(i, int(j), d[i, j]) for i in range(50)
                    for j in [j for j in np.argsort(d[i], kind="stable") if not bad[i, j]][:k]]
            assert list(zip(qi.tolist(), ri.tolist(), dist.tolist())) == want


def test_embedding_once_per_row_with_repeated_ids(spark):
    seen = spark.sparkContext.accumulator(0)

    def enc(texts):
        seen.add(len(texts))
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "CC", "train"), (1, "CCC", "train"), (None, "O", "test")],
                               "id long, s string, split string")
    good, bad, obs = embed.featurize_smiles(df, "id", "s", encoder=enc, dim=1)
    assert good.count() == 3 and bad.count() == 0 and good.count() == 3 and obs.get["rows"] == 3 and seen.value == 3
    good, bad, _ = embed.featurize_smiles(df, "id", "s", dim=4)
    assert good.count() == 3 and bad.count() == 0


def test_whole_error_text_is_kept(spark):
    def enc(texts):
        raise ValueError("x" * 1000)

    df = spark.createDataFrame([(1, "a")], "id long, t string")
    assert len(embed.embed_rows(df, "t", enc, 1).first()["error"]) == len("ValueError: ") + 1000


def test_wide_layer_works_in_small_blocks():
    rng = np.random.RandomState(0)
    x, layer = rng.standard_normal((20, 400)), WaveletLayer.init(400, 64)
    apart = WaveletLayer(layer.weights, rng.uniform(0.5, 1.5, (64, 400)), rng.uniform(-0.1, 0.1, (64, 400)))
    for one in (layer, apart):
        z = (x[:, None, :] - one.translation) / one.scale
        want = (wavelet_np(one.wavelet, z) * one.weights).sum(axis=2)
        for size in (1, 20_000, 1 << 25):
            assert np.allclose(one.pre_activation_np(x, size), want)
