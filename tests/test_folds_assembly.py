import numpy as np
import pytest
from pyspark.sql import functions as F

from ligandspark.operators.assemble import fit_standardizer, unmatched_keys, concat_blocks
from ligandspark.operators.folds import stratified_folds


def _deal(labels, n):
    """Reference rule: classes by first appearance, label-sorted rows dealt
    round-robin for quotas, class rows fill folds in row order."""
    first = {}
    for i, l in enumerate(labels):
        first.setdefault(l, i)
    classes = sorted(first, key=first.get)
    enc = [classes.index(l) for l in labels]
    order = sorted(enc)
    alloc = np.zeros((n, len(classes)), dtype=int)
    for g, c in enumerate(order):
        alloc[g % n, c] += 1
    folds = [None] * len(labels)
    for c in range(len(classes)):
        fl = np.repeat(np.arange(n), alloc[:, c])
        idx = [i for i, e in enumerate(enc) if e == c]
        for i, f in zip(idx, fl):
            folds[i] = int(f)
    return folds


@pytest.mark.parametrize("forced", [False, True])
def test_unshuffled_matches_dealing(spark, request, forced):
    if forced:
        request.getfixturevalue("buckets")
    labels = [2] * 1 + [0] * 2 + [1] * 7
    rng = np.random.RandomState(0)
    labels = list(rng.permutation(labels))
    df = spark.createDataFrame([(i, int(l)) for i, l in enumerate(labels)], "id long, label int")
    got = {r["id"]: r["fold"] for r in stratified_folds(df, "label", "id", 3).collect()}
    assert [got[i] for i in range(len(labels))] == _deal(labels, 3)
    sizes = np.bincount(list(got.values()), minlength=3)
    assert sizes.max() - sizes.min() <= 1


def test_shuffled_every_row_once(spark, buckets):
    df = spark.createDataFrame([(i, i % 3) for i in range(97)], "id long, label int")
    out = stratified_folds(df, "label", "id", 5, shuffle=True, seed=47).collect()
    assert sorted(r["id"] for r in out) == list(range(97))
    per = np.bincount([r["fold"] for r in out], minlength=5)
    assert per.max() - per.min() <= 1


def test_standardizer(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([4.0, 5.0],)], "features array<double>")
    st = fit_standardizer(df)
    assert st.scales[0] == pytest.approx(1.247219, abs=1e-6) and st.scales[1] == 1.0
    z = [r[0] for r in st.transform(df).collect()]
    assert z[0][1] == 0.0 and sum(v[0] for v in z) == pytest.approx(0.0)


def test_unmatched_report(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "row_id int, features array<double>")
    b = spark.createDataFrame([(2, [3.0]), (3, [4.0])], "row_id int, features array<double>")
    rep = {(r["row_id"], r["side"]) for r in unmatched_keys(a, b, ["row_id"]).collect()}
    assert rep == {(1, "left_only"), (3, "right_only")}
    j = concat_blocks(a, b, ["row_id"]).collect()
    assert [(r["row_id"], r["features"]) for r in j] == [(2, [2.0, 3.0])]
