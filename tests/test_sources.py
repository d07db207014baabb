import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ligandspark.operators.assemble import star_lookup
from ligandspark.sources import io as IO


def _csv(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.option("header", True).csv(path)


def test_star_scan_positional_ids(spark):
    root = tempfile.mkdtemp(prefix="ls-star-")
    _csv(spark, [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], "d_1 double, d_2 double", os.path.join(root, "drugs.csv"))
    _csv(spark, [(7.0,), (8.0,)], "t_1 double", os.path.join(root, "targets.csv"))
    _csv(spark, [(2, 1, 1), (0, 0, 0)], "drug_id long, target_id long, label int", os.path.join(root, "interactions.csv"))
    ds = T.StructType([T.StructField("d_1", T.DoubleType()), T.StructField("d_2", T.DoubleType())])
    ts = T.StructType([T.StructField("t_1", T.DoubleType())])
    fact, drugs, targets = IO.read_star(spark, root, ["d_1", "d_2"], ["t_1"], ds, ts)
    rows = sorted((r["drug_id"], r["drug_features"], r["target_features"], r["label"])
                  for r in star_lookup(fact, drugs, targets).collect())
    assert rows == [(0, [1.0, 2.0], [7.0], 0), (2, [5.0, 6.0], [8.0], 1)]


def test_numbered_features_and_sinks(spark):
    root = tempfile.mkdtemp(prefix="ls-io-")
    path = os.path.join(root, "f.csv")
    _csv(spark, [(0.5, 1.5, 1), (2.5, 3.5, 0)], "Feature_1 double, Feature_2 double, Label int", path)
    got = sorted((r["label"], r["features"]) for r in IO.read_numbered_features(spark, path, 2).collect())
    assert got == [(0, [2.5, 3.5]), (1, [0.5, 1.5])]
    df = spark.createDataFrame([(1, "train", [1.0, 2.0]), (2, "test", [3.0, 4.0])],
                               "row_id int, split string, features array<double>")
    IO.write_feature_table(df, os.path.join(root, "out"))
    back = IO.read_split_pair(spark, os.path.join(root, "out"),
                              T.StructType([T.StructField("row_id", T.IntegerType()),
                                            T.StructField("features", T.ArrayType(T.DoubleType()))]),
                              fmt="parquet")
    assert sorted((r["split"], r["row_id"]) for r in back.collect()) == [("test", 2), ("train", 1)]
    idx = IO.write_selected_indexes(spark, [3, 0, 7], os.path.join(root, "idx"))
    assert sorted(r[0] for r in spark.read.parquet(os.path.join(root, "idx")).collect()) == [0, 3, 7]
    red = IO.reduced_table(spark.createDataFrame([([1.0, 2.0, 3.0],)], "features array<double>"), [2, 0])
    assert red.first()["features"] == [3.0, 1.0]
    pred = spark.createDataFrame([("CCO", 0.7, 1, 0.9)], "smiles string, prediction double, label int, cos_similarity double")
    IO.write_predictions(pred, os.path.join(root, "pred"))
    assert spark.read.option("header", True).csv(os.path.join(root, "pred")).count() == 1


def test_partitioned_layout_single_pass(spark):
    root = tempfile.mkdtemp(prefix="ls-part-")
    df = spark.createDataFrame([(1, "train", [1.0, 2.0]), (2, "test", [3.0, 4.0]), (3, "train", [5.0, 6.0])],
                               "row_id int, split string, features array<double>")
    out = os.path.join(root, "wide")
    IO.write_feature_table(df, out, "features", prefix="f_", width=2, fmt="csv", layout="partitioned")
    schema = IO.feature_schema([("row_id", T.IntegerType())], "f_", 2, label=None)
    back = IO.read_split_pair(spark, out, schema, splits=("train",), layout="partitioned")
    assert sorted((r["row_id"], r["f_2"], r["split"]) for r in back.collect()) == [(1, 2.0, "train"), (3, 6.0, "train")]
