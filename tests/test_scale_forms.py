"""The forms that carry the operators to large inputs: CSV by name, pivot joins,
kept layouts, one-scan fold models, merged moments, trained wavelets, meter
states, tiles and ranges."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ligandspark.functions.wavelets import WAVELETS, wavelet_np, wavelet_slope_np
from ligandspark.operators import ensemble, knn, pivots, stripes, train, wavelet_train
from ligandspark.operators import metrics as M
from ligandspark.operators.accumulate import MeterState
from ligandspark.operators.assemble import fit_standardizer
from ligandspark.operators.partials import Moments, union, vector_moments, vector_sum
from ligandspark.plans import scan
from ligandspark.sources import io as IO


# --- CSV by name ------------------------------------------------------------

def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_columns_are_found_by_name(spark, tmp_path):
    put(tmp_path, "f.csv", 'SMILES,Label,Feature_2,note,Feature_1\nCC,1,20,"a, ""b""",10\nO,0,40,,30\n')
    rows = IO.read_numbered_features(spark, f"{tmp_path}/f.csv", 2).collect()
    assert sorted((r["label"], r["features"]) for r in rows) == [(0, [30.0, 40.0]), (1, [10.0, 20.0])]
    text = T.StructType([T.StructField("note", T.StringType())])
    assert sorted(r[0] or "" for r in IO.read_csv(spark, f"{tmp_path}/f.csv", text).collect()) == ["", 'a, "b"']


def test_a_missing_column_raises(spark, tmp_path):
    put(tmp_path, "f.csv", "Label,Feature_1\n1,2\n")
    with pytest.raises(ValueError, match="Feature_2"):
        IO.read_numbered_features(spark, f"{tmp_path}/f.csv", 2)


def test_files_of_one_table_with_other_headers_raise(spark, tmp_path):
    put(tmp_path / "t", "a.csv", "Feature_1,Label\n10,1\n")
    put(tmp_path / "t", "b.csv", "Label,Feature_1\n0,30\n")
    with pytest.raises(Exception, match="(?i)header"):
        IO.read_numbered_features(spark, f"{tmp_path}/t", 1).collect()


@pytest.mark.parametrize("bad", ["x,5", "1,y", "1", "1,2,3"])
def test_malformed_rows_fail_or_go_aside(spark, tmp_path, bad):
    put(tmp_path, "f.csv", f"Label,Feature_1\n1,10\n{bad}\n0,30\n")
    path = f"{tmp_path}/f.csv"
    got = IO.read_numbered_features(spark, path, 1, malformed="quarantine").collect()
    assert sorted((r["label"], r["features"]) for r in got) == [(0, [30.0]), (1, [10.0])]
    scan_ = IO.read_csv(spark, path, IO.feature_schema([], "Feature_", 1), malformed="quarantine")
    aside = IO.malformed_rows(scan_).collect()
    assert [r["row"] for r in aside] == [bad] and aside[0]["file"].endswith("f.csv")
    if bad in ("x,5", "1,y"):
        with pytest.raises(Exception, match="(?i)malformed"):
            IO.read_numbered_features(spark, path, 1).collect()
    with pytest.raises(ValueError, match="quarantine"):
        IO.read_csv(spark, path, IO.feature_schema([], "Feature_", 1), malformed="drop")


def test_a_malformed_row_of_a_dimension_keeps_its_position(spark, tmp_path):
    put(tmp_path, "drugs.csv", "name,d\na,1\nb,oops\nc,3\n")
    put(tmp_path, "targets.csv", "t,name\n5,x\n")
    put(tmp_path, "interactions.csv", "label,target_id,drug_id\n1,0,2\n")
    one = lambda n: T.StructType([T.StructField(n, T.DoubleType())])
    fact, drugs, targets = IO.read_star(spark, str(tmp_path), ["d"], ["t"], one("d"), one("t"), malformed="quarantine")
    assert sorted((r["drug_id"], r["drug_features"]) for r in drugs.collect()) == [(0, [1.0]), (2, [3.0])]
    assert [tuple(r) for r in fact.collect()] == [(1, 2, 0)] and targets.count() == 1


def test_split_pair_of_files_with_other_orders(spark, tmp_path):
    put(tmp_path, "train.csv", "id,f_1,f_2\n1,10,20\n")
    put(tmp_path, "test.csv", "f_2,extra,id,f_1\n40,z,2,30\n")
    schema = IO.feature_schema([("id", T.LongType())], "f_", 2, label=None)
    got = sorted(tuple(r) for r in IO.read_split_pair(spark, str(tmp_path), schema).collect())
    assert got == [(1, 10.0, 20.0, "train"), (2, 30.0, 40.0, "test")]


# --- pivot joins ------------------------------------------------------------

def vectors(kind, n=260, d=5, seed=3):
    rng = np.random.RandomState(seed)
    if kind == "clusters":
        return rng.randint(0, 6, n)[:, None] * 50.0 + rng.rand(n, d)
    if kind == "grid":
        return np.round(rng.rand(n, d), 1) * (rng.rand(n, d) < 0.5)       # ties, zero rows
    x = rng.standard_normal((n, d))
    if kind == "copies":
        x[: n // 2] = x[0]
    if kind == "odd":
        x[::7] = 0.0
        x[3::11, 1] = np.nan
    return x


def table(spark, x, fold=None):
    rows = [(i, [float(v) for v in r], i % 3, i % 4) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, f array<double>, label int, fold int").repartition(3)


def brute_neighbours(x, k, fold, cosine):
    x = pivots.units(x) if cosine else x
    out = {}
    for q in range(len(x)):
        d = -(x @ x[q]) if cosine else ((x - x[q]) ** 2).sum(axis=1)
        d = np.round(np.where(np.isnan(d), np.inf, d), 9)
        near = sorted((float(d[r]) + 0.0, r) for r in range(len(x)) if r != q and (fold is None or fold[r] != fold[q]))[:k]
        out[q] = near
    return out


@pytest.mark.parametrize(("kind", "metric", "own"), [
    ("clusters", "euclidean", "fold"), ("clusters", "cosine", None), ("grid", "euclidean", None), ("grid", "cosine", "fold"),
    ("normal", "euclidean", None), ("copies", "euclidean", "fold"), ("odd", "euclidean", None), ("odd", "cosine", "fold")])
def test_pivot_join_is_exact(spark, kind, metric, own):
    x, k = vectors(kind), 3 if own else 4
    df, fold = table(spark, x), np.arange(len(x)) % 4
    got = {}
    for r in knn.knn_neighbours(df, "id", "f", k, "label", own, metric, block_rows=24).collect():
        got.setdefault(r["qid"], []).append((r["rank"], round(r["dist"], 9) + 0.0, r["rid"], r["rlabel"]))
    for q, near in brute_neighbours(x, k, fold if own else None, metric == "cosine").items():
        mine = [g[1:] for g in sorted(got[q])]
        assert [m[1] for m in mine] == [r for _, r in near]
        assert np.allclose([m[0] for m in mine], [d for d, _ in near]) and all(m[2] == m[1] % 3 for m in mine)


def test_far_blocks_are_skipped(spark):
    x = vectors("clusters", 600)
    join = pivots.PivotJoin(pivots.prepared(table(spark, x), "id", "f"), False, False, block_rows=50)
    join.neighbours(3).count()
    report = join.report()
    assert report["pairs_skipped"] > 0.6 and report["blocks"] > 10
    assert report["rows_sent"] < 0.5 * report["rows"] * report["blocks"]


@pytest.mark.parametrize(("kind", "least"), [("normal", 0.5), ("copies", 0.95), ("odd", -0.2), ("grid", 0.95), ("grid", 0.0)])
def test_threshold_join_is_exact(spark, kind, least):
    x = vectors(kind, 150)
    pairs, members = pivots.cosine_at_least(table(spark, x), "id", "f", least, block_rows=20)
    cls, first = {}, {}
    for i, r in enumerate(x):
        cls[i] = first.setdefault(repr(r.tolist()), i)
    assert {r["id"]: r["class_id"] for r in members.collect()} == cls
    u, reps = pivots.units(x), sorted(set(cls.values()))
    want = {(a, b): float(u[a] @ u[b]) for a in reps for b in reps if a < b and round(float(u[a] @ u[b]), 9) >= least}
    got = pairs.collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
    assert all(abs(r["cos"] - want[r["a"], r["b"]]) < 1e-8 for r in got)


def test_joins_of_empty_and_tiny_tables(spark):
    empty = table(spark, np.zeros((0, 2)))
    assert knn.knn_neighbours(empty, "id", "f", 3).count() == 0
    assert knn.knn_neighbours(table(spark, np.ones((1, 2))), "id", "f", 3).count() == 0
    assert pivots.cosine_at_least(empty, "id", "f", 0.9)[0].count() == 0


def test_one_layout_serves_many_masks(spark):
    x = vectors("normal", 90, 6)
    df = table(spark, x)
    layout = knn.PairLayout(df, "id", "f", "label", "fold", block_rows=20).keep()
    rng = np.random.RandomState(0)
    shuffles = []
    for _ in range(3):
        masks = (rng.rand(6, 3) < 0.6).astype(float)
        masks[:, 2] = 0.0
        got = {r["cand"]: r["cost"] for r in layout.costs(masks).collect()}
        fold, label = np.arange(90) % 4, np.arange(90) % 3
        for c in range(3):
            if not masks[:, c].any():
                assert got[c] == 1.0
                continue
            near = brute_neighbours(x * masks[:, c], 3, fold, False)
            hit = np.array([np.bincount([label[r] for _, r in near[q]], minlength=3).argmax() == label[q] for q in range(90)])
            acc = np.mean([hit[fold == f].mean() for f in range(4)])
            assert got[c] == pytest.approx(1 - acc + 0.005 * masks[:, c].sum() / 6)
        shuffles.append(layout.rows.storageLevel.useDisk)
    assert shuffles == [True] * 3
    layout.release()
    assert not layout.rows.storageLevel.useDisk


# --- moments, fold models ---------------------------------------------------

def test_moments_skip_nan_and_keep_digits(spark):
    rng = np.random.RandomState(5)
    x = 1e8 + rng.standard_normal((400, 3))
    x[rng.rand(400, 3) < 0.2] = np.nan
    x[:, 2] = 7.0
    df = spark.createDataFrame([([float(v) for v in r], i % 2) for i, r in enumerate(x)], "f array<double>, k int").repartition(7)
    for found, rows in ((vector_moments(df, "f")[None], x), (vector_moments(df, "f", "k")[1], x[1::2])):
        assert np.array_equal(found.n, (~np.isnan(rows)).sum(axis=0))
        assert np.allclose(found.mean, np.nanmean(rows, axis=0), rtol=0, atol=1e-7)
        assert np.allclose(found.std, np.nanstd(rows, axis=0), rtol=1e-9, atol=1e-12)
    st = fit_standardizer(df, "f")
    assert st.scales[2] == 1.0 and st.means[2] == 7.0
    parts = [Moments.of(x[i:i + 50]) for i in range(0, 400, 50)]
    assert np.allclose(union(parts).std, np.nanstd(x, axis=0), rtol=1e-9)
    assert "Generate" not in df.select("f")._jdf.queryExecution().executedPlan().toString()


def test_partial_sums_over_two_levels(spark):
    df = spark.range(1000).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("f")).repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        from ligandspark.operators.partials import matrix
        assert vector_sum(df, ["f"], lambda c: matrix(c[0]).sum(axis=0)).tolist() == [499500.0, 1000.0]
        assert vector_moments(df, "f")[None].mean.tolist() == pytest.approx([499.5, 1.0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert vector_sum(df.where("false"), ["f"], lambda c: np.zeros(1)) is None and vector_moments(df.where("false"), "f") == {}


def labelled(spark, n=240, d=4, seed=8):
    rng = np.random.RandomState(seed)
    x = rng.standard_normal((n, d)) * [1, 5, 0.2, 1] + [0, 10, 0, 3]
    x[:, 3] = 3.0                                       # a constant feature
    y = (x[:, 0] + x[:, 1] / 5 - 2 + rng.standard_normal(n) > 0.5).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), i % 3) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "id long, f array<double>, y int, fold int").repartition(5)


def objective(x, y, pw, scale, w, b, reg=train.REG):
    z, share = x @ w + b, np.where(y == 1, pw, 1.0)
    loss = (share * (np.logaddexp(0, z) - y * z)).sum() / share.sum()
    return loss + reg * ((w * scale) ** 2).sum() / 2


@pytest.mark.parametrize("per_fold", [False, True])
def test_fold_models_equal_single_fits(spark, per_fold):
    x, y, df = labelled(spark)
    weights = train.training_weights(df, "fold", "y")
    models = train.fit_folds(df, "f", "y", "fold", weights, per_fold=per_fold)
    for f, m in models.items():
        rows = np.arange(len(y)) % 3 != f
        xs, ys = x[rows], y[rows]
        assert weights[f] == pytest.approx((ys == 0).sum() / (ys == 1).sum())
        share = np.where(ys == 1, weights[f], 1.0)
        if per_fold:
            scale = xs.std(axis=0)
        else:
            mean = (share[:, None] * xs).sum(axis=0) / share.sum()
            free = share.sum() - (share ** 2).sum() / share.sum()
            scale = np.sqrt((share[:, None] * (xs - mean) ** 2).sum(axis=0) / free)
        best = objective(xs, ys, weights[f], scale, m.coefficients, m.intercept)
        for j in range(5):                              # no small step makes it better
            for step in (1e-3, -1e-3):
                w, b = m.coefficients.copy(), m.intercept
                if j < 4:
                    w[j] += step / max(scale[j], 1e-9) if scale[j] > 1e-9 else 0.0
                else:
                    b += step
                assert objective(xs, ys, weights[f], scale, w, b) >= best - 1e-9
        if not per_fold:
            one = train.fit_weighted(df.where(F.col("fold") != f), "f", "y", weights[f])
            assert np.allclose(one.coefficients, m.coefficients, atol=1e-4) and one.intercept == pytest.approx(m.intercept, abs=1e-3)


def test_a_single_fit_equals_the_library(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    _, _, df = labelled(spark)
    own = train.fit_weighted(df, "f", "y", 2.5)
    d = df.select(array_to_vector("f").alias("features"), F.col("y").cast("double").alias("label"),
                  F.when(F.col("y") == 1, 2.5).otherwise(1.0).alias("w"))
    lib = LogisticRegression(weightCol="w", regParam=train.REG, maxIter=200, tol=1e-10).fit(d)
    assert np.allclose(own.coefficients, lib.coefficients.toArray(), atol=1e-4)
    assert own.intercept == pytest.approx(lib.intercept, abs=1e-3)


def test_cross_validation_saves_and_scores(spark, tmp_path):
    x, y, df = labelled(spark)
    preds, models, _ = train.cross_validate(df, "f", "y", "fold", per_fold=True, save_to=f"{tmp_path}/m")
    rows = preds.collect()
    assert sorted(r["id"] for r in rows) == list(range(len(y)))
    for r in rows[:20]:
        m = models[r["fold"]]
        assert r["logit"] == pytest.approx(float(np.dot(m.coefficients, r["f"]) + m.intercept))
    back = {r["fold"]: r["weights"] for r in train.load_models(spark, f"{tmp_path}/m").collect()}
    assert back == {f: list(m.coefficients) for f, m in models.items()}
    again = train.independent_test(df.limit(7), train.load_models(spark, f"{tmp_path}/m"), "f", "model")
    assert again.count() == 21
    # no positive at all: weight 1, and a model that says so
    none = df.withColumn("y", F.lit(0))
    preds, _, w = train.cross_validate(none, "f", "y", "fold")
    assert set(w.values()) == {1.0} and preds.agg(F.max("p")).first()[0] < 0.1


# --- trained wavelets -------------------------------------------------------

@pytest.mark.parametrize("name", WAVELETS)
def test_slopes_are_derivatives(name):
    z = np.random.RandomState(1).uniform(-2.5, 2.5, (40, 6))
    h = 1e-6
    want = (wavelet_np(name, z + h, None, 6) - wavelet_np(name, z - h, None, 6)) / (2 * h)
    assert np.allclose(wavelet_slope_np(name, z, None, 6), want, atol=1e-5)


@pytest.mark.parametrize("name", ["dog", "mexican_hat", "shannon"])
def test_gradient_equals_finite_differences(spark, name):
    rng = np.random.RandomState(2)
    x, y = rng.standard_normal((80, 3)), rng.randint(0, 2, 80)
    df = spark.createDataFrame([([float(v) for v in r], int(t)) for r, t in zip(x, y)], "f array<double>, y int").repartition(4)
    model = wavelet_train.WaveletClassifier(rng.uniform(-1, 1, 3), rng.uniform(0.6, 1.5, 3), rng.uniform(-0.3, 0.3, 3),
                                            1.3, 0.2, name)

    def loss(v):
        m = model.at(v)
        u, _ = m.parts(x)
        z = m.gain * (u - u.mean()) / np.sqrt(u.var() + 1e-5) + m.bias
        return (np.where(y == 1, 2.0, 1.0) * (np.logaddexp(0, z) - y * z)).mean()

    v = model.vector()
    got, g, m = wavelet_train.loss_and_gradient(df, "f", "y", model, 2.0)
    assert got == pytest.approx(loss(v)) and m.n[0] == 80
    steps = np.eye(len(v)) * 1e-6
    assert np.allclose(g, [(loss(v + s) - loss(v - s)) / 2e-6 for s in steps], atol=1e-6)


def test_training_moves_scales_and_lowers_the_loss(spark):
    rng = np.random.RandomState(3)
    x = rng.uniform(-2, 2, (300, 2))
    y = (np.abs(x[:, 0]) < 0.7).astype(int)             # no line parts the classes
    df = spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, f array<double>, y int")
    start = wavelet_train.WaveletClassifier.init(2, "mexican_hat")
    model = wavelet_train.fit(df, "f", "y", start, float((y == 0).sum() / (y == 1).sum()), steps=15, rate=0.15)
    assert model.history[-1] < 0.8 * model.history[0]
    assert not np.allclose(model.scale, start.scale) and not np.allclose(model.translation, start.translation)
    auc = M.ranking_metrics(wavelet_train.score(df, "f", model), [], "p", "y").first()["roc_auc"]
    assert auc > 0.9


# --- meter states, tiles, ranges --------------------------------------------

PRED = "run string, task string, logit double, y double, mask double"


def test_meter_state_is_free_of_order_split_and_retries(spark, tmp_path):
    rng = np.random.RandomState(4)
    rows = [("r", f"t{i % 2}", float(np.round(rng.randn(), 1)), float(rng.rand() < 0.4), float(rng.rand() < 0.9))
            for i in range(300)]
    make = lambda part: spark.createDataFrame(part, PRED)
    whole = MeterState(spark, f"{tmp_path}/whole")
    whole.add(0, make(rows))
    want = sorted(map(tuple, whole.counts().collect()))
    parts = MeterState(spark, f"{tmp_path}/parts")
    assert parts.counts().count() == 0
    parts.add(2, make(rows[200:]))
    parts.add(1, make(rows[:90]))
    parts.add(1, make(rows[:90]))                       # the same batch again
    parts.compact()
    parts.add(2, make(rows[200:]))                      # and after the compaction
    parts.add(3, make(rows[90:200]))
    assert sorted(map(tuple, parts.counts().collect())) == want
    parts.compact()
    parts.compact()
    again = MeterState(spark, f"{tmp_path}/parts")
    assert sorted(map(tuple, again.counts().collect())) == want and len(os.listdir(f"{tmp_path}/parts/base")) == 1
    assert sorted(map(tuple, again.metrics().collect())) == sorted(map(tuple, whole.metrics().collect()))


def test_diversity_of_large_batches_in_tiles(spark):
    rng = np.random.RandomState(6)
    x = rng.standard_normal((130, 4))
    x[:60] = x[0]
    df = spark.createDataFrame([(None if i < 10 else i % 13 // 12, [float(v) for v in x[i]]) for i in range(130)],
                               "b int, f array<double>")
    whole = {r["b"]: r for r in ensemble.batch_diversity(df, "b", "f").collect()}
    tiled = {r["b"]: r for r in ensemble.batch_diversity(df, "b", "f", tile=7).collect()}
    assert set(whole) == {None, 0, 1}
    for k, r in whole.items():
        assert tiled[k]["batch_rows"] == r["batch_rows"] and tiled[k]["diversity"] == pytest.approx(r["diversity"])


def test_any_number_of_variants(spark):
    rows = [(1, v, [1.0, float(v)]) for v in range(1500)] + [(2, 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "s int, v int, features array<double>")
    assert ensemble.variant_cosines(df, "s", "v").count() == 1499


def test_binary_search_in_sorted_arrays(spark):
    rng = np.random.RandomState(7)
    values = sorted(set(np.round(rng.rand(37) * 10, 1)))
    xs = [*values, *(v + 0.05 for v in values), -1.0, 99.0]
    df = spark.createDataFrame([([float(v) for v in values], float(x)) for x in xs], "b array<double>, x double")
    got = [r[0] for r in df.select(scan.at_most("b", F.col("x"), len(values))).collect()]
    assert got == [int(np.searchsorted(values, x, side="right")) for x in xs]
    assert spark.createDataFrame([([], 1.0)], "b array<double>, x double").select(scan.at_most("b", F.col("x"), 0)).first()[0] == 0


def test_many_ranges_of_one_group_plan_quickly(spark):
    n = 100_000
    spark.range(1).count()
    df = spark.range(n).select(F.col("id").cast("double").alias("k"), F.lit(1).alias("one"))
    t = time.time()
    out = scan.prefix_scan(df, [], "k", sums=["one"], rows=1)
    planned = time.time() - t
    got = out.agg(F.sum((F.col("cum_one") == F.col("k") + 1).cast("int"))).first()[0]
    assert got == n and out.columns == ["k", "one", "cum_one"] and planned < 60


# --- stripes ------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["normal", "copies", "odd", "scale"])
def test_rows_that_stream_past_a_stripe_give_its_nearest(kind):
    rng = np.random.default_rng(5)
    x = vectors("normal" if kind == "scale" else kind, 500, 6)
    x = x * 1e-3 + rng.integers(0, 3, 500)[:, None] * 1e6 if kind == "scale" else x
    ids, fold, q = np.arange(500), np.arange(500) % 3, np.arange(0, 500, 2)
    state = stripes.Nearest(x[q], ids[q], fold[q], 4, False)
    order = rng.permutation(500)
    for s in range(0, 500, 90):
        p = order[s:s + 90]
        state.meet(x[p], ids[p], fold[p], s)
    for i, near in brute_neighbours(x, 4, fold, False).items():
        if i % 2 == 0:
            assert state.there[i // 2].all() and [r for _, r in near] == state.rid[i // 2].tolist()
            assert np.allclose([d for d, _ in near], state.dist[i // 2])


def test_a_row_moves_once_for_each_stripe_whatever_the_rows(spark):
    # by block pairs the copies grew with the square of the rows
    assert stripes.stripes_of(615_000, stripes.STRIPE_ROWS, 12) <= 38
    df = table(spark, vectors("normal", 240))
    layout = knn.PairLayout(df, "id", "f", "label", "fold", block_rows=40)
    assert layout.rows.count() == 240 * (1 + layout.stripes.count)
    held = layout.rows.select(F.spark_partition_id().alias("p"), "_to", "_ref").collect()
    assert all(r["p"] == r["_to"] for r in held)        # a task for each stripe
    assert sum(not r["_ref"] for r in held) == 240      # a query is held once


@pytest.mark.parametrize("kind", ["normal", "clusters"])
def test_pairs_over_a_threshold_carry_class_sizes_and_are_not_shuffled(spark, kind):
    x = vectors(kind, 200)
    x[150:] = x[100]
    pairs, _ = pivots.cosine_at_least(table(spark, x), "id", "f", 0.9, block_rows=30)
    got = {(r["a"], r["b"]): (r["n_a"], r["n_b"]) for r in pairs.collect()}
    assert len(got) == pairs.count() and got
    assert all(n == (51 if a == 100 else 1, 51 if b == 100 else 1) for (a, b), n in got.items())
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    if kind == "normal":
        # above the task that makes the pairs there is no join and no shuffle
        assert "Join" not in plan.split("MapInArrow")[0] and "Repartition" not in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("kind", ["normal", "copies", "odd"])
def test_bounds_are_drawn_in_while_rows_stream_past(kind, own, monkeypatch):
    monkeypatch.setattr(stripes, "FIRST", 32)
    monkeypatch.setattr(stripes, "TILE", (16, 96))
    rng = np.random.default_rng(8)
    x = vectors(kind, 500, 6)
    ids, fold, q = np.arange(500), np.arange(500) % 3, np.arange(0, 500, 2)
    for k in (1, 4, 40):      # more than a tile has groups, too
        state = stripes.Nearest(x[q], ids[q], fold[q] if own else None, k, False)
        order = rng.permutation(500)
        for s in range(0, 500, 230):
            p = order[s:s + 230]
            state.meet(x[p], ids[p], fold[p] if own else None, s, state.known(ids[p]))
        for i, near in brute_neighbours(x, k, fold if own else None, False).items():
            if i % 2 == 0:
                assert state.there[i // 2].all() and [r for _, r in near] == state.rid[i // 2].tolist()


def test_rows_vote_in_the_task_that_finds_their_neighbours(spark):
    """Only the hits of a fold leave a task; ids that repeat vote as one, null
    labels of neighbours as one of their own, and null labels of rows count for nothing."""
    rng = np.random.RandomState(3)
    x = np.round(rng.rand(120, 5), 1)
    ids = [i if i < 100 else i - 100 for i in range(120)]
    x[100:] = x[:20]
    label = [None if i % 11 == 0 else int(i % 3) for i in ids]
    df = spark.createDataFrame([(ids[i], [float(v) for v in x[i]], label[i], ids[i] % 4) for i in range(120)],
                               "id long, f array<double>, label int, fold int").repartition(3)
    masks = np.array([[1, 1, 0, 1, 0], [0, 1, 1, 1, 1], [1, 0, 0, 0, 0]], float).T
    layout = knn.PairLayout(df, "id", "f", "label", "fold", block_rows=25)
    voted = layout.stripes.votes(3, masks)
    assert voted.count() <= 3 * 4 * layout.stripes.count
    costs = layout.costs(masks)
    assert "Window" not in costs._jdf.queryExecution().optimizedPlan().toString()
    got = {r["cand"]: r["accuracy"] for r in costs.collect()}
    for c in range(3):
        hits = {f: [] for f in range(4)}
        for q in range(100):
            near = sorted((round(float((((x[q] - x[r]) * masks[:, c]) ** 2).sum()), 9), ids[r]) for r in range(120)
                          if ids[r] % 4 != q % 4 for _ in range(1 + (q < 20)))[:3]
            votes = [-1 if label[r] is None else label[r] for _, r in near]
            best = min(set(votes), key=lambda v: (-votes.count(v), v))
            if label[q] is not None:
                hits[q % 4].append(best == label[q])
        assert got[c] == pytest.approx(np.mean([np.mean(h) for h in hits.values()]))


@pytest.mark.parametrize("folds", ["few", "null", "many", "none"])
@pytest.mark.parametrize("kind", ["normal", "copies", "odd", "scale"])
def test_masks_that_share_components_share_a_product(kind, folds, monkeypatch):
    for name, value in {"FIRST": 16, "MASK_TILE": (40, 64), "MEASURED": 50, "HELD": 100, "PAIR": 1.0, "PAIR_MASK": 0.0}.items():
        monkeypatch.setattr(stripes, name, value)
    rng = np.random.default_rng(9)
    n, d = 300, 12
    x = vectors("normal" if kind == "scale" else kind, n, d)
    x = x * 1e-3 + rng.integers(0, 3, n)[:, None] * 1e6 if kind == "scale" else x
    x[5, 2], x[7, 4] = 1e20, np.inf
    masks = np.repeat(rng.random((d, 1)) < 0.7, 7, axis=1)
    for c in range(1, 6):
        masks[rng.choice(d, 2, replace=False), c] ^= True
    masks[:, 6] = rng.random(d) < 0.5
    ids, fold = np.arange(n), np.arange(n) % (40 if folds == "many" else 3)
    fold = np.where(ids >= 150, fold, np.nan) if folds == "null" else None if folds == "none" else fold
    q = np.arange(1, n, 3) if folds != "null" else np.arange(150, n, 3)      # of the queries no fold is null
    state = stripes.Families(x[q], ids[q], None if fold is None else fold[q], 3, masks)
    order = rng.permutation(n)
    joined = 0
    for s in range(0, n, 130):
        p = order[s:s + 130]
        state.meet(x[p], ids[p], None if fold is None else fold[p], s)
        joined = max(joined, *(len(f.masks) for f in state.families))
    assert joined > 1 or kind == "copies"
    for c, best in enumerate(state.best):
        near = brute_neighbours(np.where(masks[:, c], x, 0.0), 3, fold, False)
        for at, i in enumerate(q):
            assert [r for _, r in near[i]] == best.rid[at][best.there[at]].tolist(), (c, i)


def test_a_layout_for_masks_has_a_stripe_for_each_core_and_vectors_as_bytes(spark):
    assert stripes.stripes_of(102_564, stripes.STRIPE_ROWS, 8, 1) == 8
    x = vectors("odd", 90)
    layout = knn.PairLayout(table(spark, x), "id", "f", "label", "fold", block_rows=40)
    assert isinstance(layout.rows.schema["_f"].dataType, T.BinaryType)
    held = {r["_id"]: np.frombuffer(r["_f"]) for r in layout.rows.where("NOT _ref").collect()}
    assert len(held) == 90 and all(np.array_equal(held[i], x[i], equal_nan=True) for i in held)
