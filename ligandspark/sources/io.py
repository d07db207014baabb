"""Scans and sinks.

* Split pairs are ``<path>/train.csv`` and ``<path>/test.csv`` (files or
  Spark output folders); the file becomes a ``split`` column.
* Schemas are explicit (no inference pass over the data), and CSV columns are
  found **by their header names**: order and extra columns do not matter, a
  missing column raises, and so does a file of the table with another header.
* A malformed CSV row (a value that does not parse, too many or too few fields)
  fails the scan, or is kept aside with ``malformed="quarantine"``.
* Feature tables are written with the array column (parquet) or, at the CSV
  boundary, as numbered wide columns built in one ``select``.
* Positional ids (the star-schema loader indexes dimension rows by their
  position in the file) come from the counts of the scanned file parts:
  consecutive, in file order, without moving rows to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ligandspark.functions.vectors import from_wide, numbered, to_wide
from ligandspark.plans.sizing import collect_small

SPLITS = ("train", "test")
BAD = "_malformed"      # raw text of a malformed row, null for a good one
# as pandas writes them: a quote inside a quoted field is doubled
CSV = {"header": "true", "quote": '"', "escape": '"'}


def feature_schema(keys: Sequence[tuple[str, T.DataType]], prefix: str, n: int,
                   label: str | None = "Label") -> T.StructType:
    fields = [T.StructField(k, t) for k, t in keys]
    fields += [T.StructField(c, T.DoubleType()) for c in numbered(prefix, n)]
    if label:
        fields.append(T.StructField(label, T.IntegerType()))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, malformed: str = "fail",
             partition: T.StructField | None = None) -> DataFrame:
    """The columns of ``schema`` of a CSV table with headers, found by name.

    One line of the table gives the order of the header's columns; the scan is
    laid out in that order (columns that are not asked for as strings, which
    are pruned) and Spark holds it against the header of every file
    (``enforceSchema=false``), so a file with another header fails instead of
    giving values of other columns.

    ``malformed="fail"`` ends the job at a malformed row; ``"quarantine"`` adds
    the column ``BAD`` with the row's text, whose values are not to be used (see
    :func:`good_rows` and :func:`malformed_rows`).  All fields of a row are read
    then, as a row with a field too many or too few is malformed."""
    if malformed not in ("fail", "quarantine"):
        raise ValueError(f"malformed rows can 'fail' or go to 'quarantine', not {malformed!r}")
    names = spark.read.options(**CSV).csv(path).columns
    if partition is not None:
        names = [c for c in names if c != partition.name]
    wanted = {f.name: f for f in schema.fields}
    missing = [c for c in wanted if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(map(repr, missing))}; its header is {', '.join(names)}")
    fields = [wanted.get(c, T.StructField(c, T.StringType())) for c in names]
    own = [*([partition] if partition is not None else [])]
    r = spark.read.options(**CSV).option("enforceSchema", "false")
    if malformed == "quarantine":
        fields.append(T.StructField(BAD, T.StringType()))
        r = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("columnPruning", "false")
        own.append(T.StructField(BAD, T.StringType()))
    else:
        r = r.option("mode", "FAILFAST")
    full = T.StructType(fields + ([partition] if partition is not None else []))
    df = r.schema(full).csv(path).select(*wanted, *[f.name for f in own])
    if malformed == "quarantine":
        # always true: Spark refuses to read the text of malformed rows alone
        df = df.where(F.xxhash64(*wanted) >= -(1 << 63))
    return df


def good_rows(df: DataFrame) -> DataFrame:
    """The rows of a quarantining scan that parsed."""
    return df.where(F.col(BAD).isNull()).drop(BAD)


def malformed_rows(df: DataFrame) -> DataFrame:
    """The text of the rows of a quarantining scan that did not parse, with the
    file that they are from, to be written aside."""
    return df.where(F.col(BAD).isNotNull()).select(
        F.col("_metadata.file_path").alias("file"), F.col(BAD).alias("row"))


def read_split_pair(spark: SparkSession, path: str, schema: T.StructType,
                    splits: Sequence[str] = SPLITS, fmt: str = "csv", layout: str = "split_files",
                    malformed: str = "fail") -> DataFrame:
    """Both splits with header, a ``split`` column, unioned by name.

    ``layout="split_files"`` reads ``<path>/train.<fmt>`` and
    ``<path>/test.<fmt>``; ``layout="partitioned"`` reads one ``split=...``
    partitioned table (a filter on ``split`` then prunes partitions).  CSV
    columns and ``malformed`` are as in :func:`read_csv`."""
    split = T.StructField("split", T.StringType())
    if layout == "partitioned":
        df = (read_csv(spark, path, schema, malformed, split) if fmt == "csv"
              else spark.read.schema(T.StructType([*schema.fields, split])).parquet(path))
        return df.where(F.col("split").isin(*splits))
    out = None
    for sp in splits:
        df = (read_csv(spark, f"{path.rstrip('/')}/{sp}.csv", schema, malformed) if fmt == "csv"
              else spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{sp}.parquet"))
        df = df.withColumn("split", F.lit(sp))
        out = df if out is None else out.unionByName(df)
    return out


def with_row_index(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Consecutive 0-based position of each row in file order.

    For a table read from files the rows are numbered by file name and place in
    the file, however Spark deals the file parts to partitions; any other table
    by its partitions.  Only one number per file part goes to the driver."""
    at = F.monotonically_increasing_id()            # partition * 2^33 + place in it
    if df.inputFiles():
        d = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                      at.alias("_at"))
        parts = sorted(d.groupBy("_f", "_b").agg(F.min("_at").alias("lo"), F.count(F.lit(1)).alias("n")).collect())
        rows, total = [], 0
        for r in parts:
            rows.append((r["_f"], r["_b"], total - r["lo"]))
            total += r["n"]
        shift = df.sparkSession.createDataFrame(rows, "_f string, _b long, _shift long")
        return d.join(F.broadcast(shift), ["_f", "_b"]).select(
            *df.columns, (F.col("_at") + F.col("_shift")).alias(name))
    counts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["p"]: r["n"] for r in counts}        # one number per scan partition
    first, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        first.append(total)
        total += sizes.get(p, 0)
    starts = F.array(*[F.lit(x) for x in first]).cast("array<bigint>")
    d = df.withColumn("_at", at)
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return d.withColumn(name, F.element_at(starts, (F.shiftright("_at", 33) + 1).cast("int")) + place).drop("_at")


def read_star(spark: SparkSession, path: str, drug_cols: Sequence[str], target_cols: Sequence[str],
              drug_schema: T.StructType, target_schema: T.StructType,
              fact_schema: T.StructType | None = None, malformed: str = "fail") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``drugs.csv``, ``targets.csv``, ``interactions.csv`` -> (fact with
    label, drug_id, target_id; drugs (drug_id, drug_features); targets
    (target_id, target_features)).  Dimension ids are row positions; a malformed
    row keeps its position, so a quarantined one moves no other id."""
    p = path.rstrip("/")
    fact_schema = fact_schema or T.StructType([
        T.StructField("drug_id", T.LongType()), T.StructField("target_id", T.LongType()),
        T.StructField("label", T.IntegerType())])
    drugs = with_row_index(read_csv(spark, f"{p}/drugs.csv", drug_schema, malformed), "drug_id")
    targets = with_row_index(read_csv(spark, f"{p}/targets.csv", target_schema, malformed), "target_id")
    fact = read_csv(spark, f"{p}/interactions.csv", fact_schema, malformed)
    if malformed == "quarantine":
        fact, drugs, targets = good_rows(fact), good_rows(drugs), good_rows(targets)
    return (fact.select("label", "drug_id", "target_id"),
            drugs.select("drug_id", from_wide(drug_cols).alias("drug_features")),
            targets.select("target_id", from_wide(target_cols).alias("target_features")))


def read_star_splits(spark: SparkSession, path: str, drug_cols, target_cols, drug_schema, target_schema,
                     malformed: str = "fail"):
    """S3: S2 over ``<path>/train`` and ``<path>/test``; returns {split: (fact, drugs, targets)}."""
    return {sp: read_star(spark, f"{path.rstrip('/')}/{sp}", drug_cols, target_cols, drug_schema, target_schema,
                          malformed=malformed)
            for sp in SPLITS}


def read_numbered_features(spark: SparkSession, path: str, length: int, prefix: str = "Feature_",
                           label: str = "Label", malformed: str = "fail") -> DataFrame:
    """``Label`` and ``Feature_1..Feature_length`` as one vector column; with
    ``malformed="quarantine"`` of the rows that parsed."""
    df = read_csv(spark, path, feature_schema([], prefix, length, label), malformed)
    if malformed == "quarantine":
        df = good_rows(df)
    return df.select(F.col(label).alias("label"), from_wide(numbered(prefix, length)).alias("features"))


def write_feature_table(df: DataFrame, path: str, features: str = "features", prefix: str | None = None,
                        width: int | None = None, fmt: str = "parquet", mode: str = "overwrite",
                        layout: str = "split_files") -> None:
    """CSV gets numbered wide columns (P2) with a header and no index column.

    ``layout="partitioned"`` writes one table partitioned by ``split`` in a
    single pass over ``df`` (the choice for large inputs);
    ``layout="split_files"`` writes ``<path>/<split>.<fmt>``, the split-pair
    layout of existing feature files, one filtered pass per split."""
    if layout == "partitioned":
        out = to_wide(df, features, prefix, width) if fmt == "csv" else df
        w = out.write.mode(mode).partitionBy("split")
        w.options(**CSV).csv(path) if fmt == "csv" else w.parquet(path)
        return
    splits = [r["split"] for r in collect_small(df.select("split").distinct(), 1000)]
    for sp in splits:
        part = df.where(F.col("split") == sp).drop("split")
        if fmt == "csv":
            part = to_wide(part, features, prefix, width)
            part.write.mode(mode).options(**CSV).csv(f"{path.rstrip('/')}/{sp}.csv")
        else:
            part.write.mode(mode).parquet(f"{path.rstrip('/')}/{sp}.parquet")


def write_selected_indexes(spark: SparkSession, indexes: Sequence[int], path: str, mode: str = "overwrite") -> DataFrame:
    """The chosen 0-based feature indexes as a one-column table."""
    df = spark.createDataFrame([(int(i),) for i in indexes], "feature_index int")
    df.coalesce(1).write.mode(mode).parquet(path)
    return df


def reduced_table(df: DataFrame, indexes: Sequence[int], features: str = "features") -> DataFrame:
    """S7 content: the selected dimensions only (renumbered 1.. when widened)."""
    return df.withColumn(features, F.array(*[F.element_at(features, int(i) + 1) for i in indexes]))


def write_reduced_tables(df: DataFrame, indexes: Sequence[int], path: str, features: str = "features",
                         prefix: str = "Feature_", fmt: str = "csv", layout: str = "split_files") -> None:
    """The selected dimensions of every split, renumbered ``prefix1..``, as a split pair."""
    write_feature_table(reduced_table(df, indexes, features), path, features, prefix, len(indexes), fmt, layout=layout)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``smiles, prediction, label, cos_similarity`` as CSV with header."""
    df.select("smiles", "prediction", "label", "cos_similarity").write.mode(mode).options(**CSV).csv(path)


def write_metric_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric rows (one per run / fold / split); rounding is for display only."""
    df.write.mode(mode).parquet(path)


def show_metric_report(df: DataFrame, digits: int = 3) -> DataFrame:
    """Display form of S9: doubles rounded to ``digits``."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
