import os

from ligandspark.operators import metrics as M
from ligandspark.functions import sequences as S
from pyspark.sql import functions as F


def test_no_python_in_sequence_functions(spark):
    d = spark.createDataFrame([("CC(=O)N",)], "s string")
    plan = d.select(S.token_ids(S.smiles_tokens(F.col("s")))).select("*")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_bucketed_ranking_has_no_single_partition_window(spark, buckets):
    d = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("g"),
                                 (F.rand(1)).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    plan = M.ranking_metrics(d, ["g"], "p", "y")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and "roc_auc" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_no_cartesian_in_ungrouped_report_and_knn(spark, buckets):
    from ligandspark.operators import knn as K
    d = spark.range(300).select(F.col("id"), (F.rand(2)).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"),
                                F.array(F.rand(3), F.rand(4)).alias("f"), (F.col("id") % 3).alias("fold"))
    for df in (M.report9(d, [], "p", "y"), K.knn_neighbours(d, "id", "f", 3, "y", "fold", block_rows=64)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
