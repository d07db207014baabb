import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligandspark.functions import wavelets as W
from ligandspark.operators import history as H
from ligandspark.operators import knn as K
from ligandspark.operators.select import MemoObjective, magpie_search


def _stateful(scores, patience):
    best, counter, stop, best_epoch = None, 0, None, None
    for e, s in enumerate(scores, start=1):
        if best is None or s > best:
            best, counter, best_epoch = s, 0, e
        else:
            counter += 1
            if counter >= patience and stop is None:
                stop = e
                break
    return stop, best_epoch, best


@pytest.mark.parametrize("forced", [False, True])
def test_early_stop_matches_loop(spark, request, forced):
    if forced:
        request.getfixturevalue("buckets")
    rng = np.random.RandomState(5)
    rows, expect = [], {}
    for run in range(30):
        n = int(rng.randint(1, 40))
        sc = list(np.round(rng.rand(n), 1))     # many equal scores
        expect[run] = _stateful(sc, 3)
        rows += [(run, e + 1, float(s)) for e, s in enumerate(sc)]
    df = spark.createDataFrame(rows, "run int, epoch long, score double")
    got = {r["run"]: r for r in H.early_stop(df, "run", "epoch", "score", 3).collect()}
    for run, (stop, be, bs) in expect.items():
        assert got[run]["stop_epoch"] == stop
        if stop is not None:
            assert got[run]["best_epoch"] == be and got[run]["best_score"] == bs


def test_knn_brute_force_multi_block(spark):
    rng = np.random.RandomState(1)
    X = np.round(rng.rand(60, 4), 1)     # duplicates and ties
    lab = rng.randint(0, 3, 60)
    fold = np.arange(60) % 3
    df = spark.createDataFrame([(int(i), [float(v) for v in X[i]], int(lab[i]), int(fold[i])) for i in range(60)],
                               "id long, f array<double>, label int, fold int")
    neigh = K.knn_neighbours(df, "id", "f", 3, "label", "fold", block_rows=16)   # 4 blocks
    pred = {r["qid"]: r["pred"] for r in K.knn_vote(neigh).collect()}
    for q in range(60):
        cand = [(round(float(((X[q] - X[r]) ** 2).sum()), 9), r) for r in range(60) if fold[r] != fold[q]]
        top = [r for _, r in sorted(cand)[:3]]
        votes = np.bincount(lab[top], minlength=3)
        assert pred[q] == int(np.argmax(votes))


def test_empty_mask_cost_one(spark):
    df = spark.createDataFrame([(i, [float(i)], i % 2, i % 3) for i in range(9)],
                               "id long, f array<double>, label int, fold int")
    c = K.subset_cost(df, "id", "f", "label", "fold", np.zeros((1, 1))).first()
    assert c["cost"] == 1.0


def test_rbmo_memo_and_bounds():
    calls = []

    def obj(p):
        calls.append(len(p))
        return ((p > 0.5).sum(axis=1) - 3.0) ** 2

    memo = MemoObjective(obj)
    best, pos, curve = vars(magpie_search(memo, 0.0, 1.0, 8, members=10, rounds=5, seed=1)).values()
    assert ((pos >= 0) & (pos <= 1)).all()
    assert best == min(memo.cache.values())
    assert all(np.diff(curve) <= 0)
    assert memo.evaluations <= 10 * 6


def test_wavelet_limits(spark):
    xs = [0.0, 0.5, -0.5, 1.0, -1.0, 2.0, -2.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(W.meyer(F.col("x"))).collect()]
    want = [math.sin(math.pi * abs(x)) * (1.0 if abs(x) <= 0.5 else 0.0) for x in xs]
    assert got == pytest.approx(want, abs=1e-12)
    sh = df.select(W.shannon(F.col("x"), F.lit(0), F.lit(1))).first()[0]
    assert sh == 1.0
    with pytest.raises(ValueError):
        W.wavelet("haar", F.col("x"))


def test_tta_positional_blocks(spark):
    """Copies laid out as aug_times consecutive blocks of n samples; the
    ensemble averages logits, labels and masks per sample, then sigmoid."""
    from ligandspark.operators.ensemble import positional_sample, tta_ensemble
    n, aug = 3, 2
    logits = [0.0, 1.0, -1.0, 2.0, 3.0, 1.0]          # block 0 then block 1
    rows = [(i, logits[i], 1.0 if i % n == 1 else 0.0, 1.0) for i in range(n * aug)]
    df = spark.createDataFrame(rows, "pos long, logit double, y double, mask double")
    df = df.withColumn("sample", positional_sample(F.col("pos"), n))
    got = {r["sample"]: r for r in tta_ensemble(df, "sample").collect()}
    assert got[0]["logit"] == pytest.approx(1.0) and got[1]["logit"] == pytest.approx(2.0)
    assert got[2]["logit"] == pytest.approx(0.0) and got[2]["p"] == pytest.approx(0.5)
    assert got[1]["mean_y"] == 1.0 and got[0]["n_copies"] == 2


def test_select_features_with_spark_objective(spark):
    from ligandspark.operators.select import feature_subset_objective, magpie_search
    rng = np.random.RandomState(4)
    X = rng.rand(36, 6)
    lab = (X[:, 0] > 0.5).astype(int)          # dimension 0 carries the label
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(lab[i]), i % 3) for i in range(36)],
                               "id long, f array<double>, label int, fold int")
    obj, layout = feature_subset_objective(df, "id", "f", "label", "fold")
    best, pos, curve = vars(magpie_search(obj, 0.0, 1.0, 6, members=10, rounds=2, seed=3)).values()
    assert best == min(obj.cache.values())
    assert len(obj.cache) == obj.evaluations          # each distinct mask evaluated once
    assert all(0.0 <= v <= 1.0 + 0.005 for v in obj.cache.values())
    layout.release()
    idx = [int(i) for i in np.where(pos > 0.5)[0]]
    assert all(0 <= i < 6 for i in idx)
