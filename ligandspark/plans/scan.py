"""Ordered scans (running sums / maxima, ranks) without a one-task window.

A window ``partitionBy(g).orderBy(k)`` puts each group into one task, and
without a partition *everything* into one task.  Here every group is cut into
contiguous key ranges of about ``RANGE_ROWS`` rows, and the window runs within
``(group, range)`` plus the totals of the ranges before it:

1. one count per group; only groups above ``RANGE_ROWS`` rows come back (fewer
   than ``rows / RANGE_ROWS`` of them, so the number of ranges follows the data)
2. their boundaries from approximate percentiles, in one aggregation
3. range = number of boundaries <= key, by binary search in the group's sorted
   boundaries, which come from a broadcast table with one row per large group;
   equal keys share a range, so boundaries only affect balance, never the result
4. totals per (large group, range) -> running totals -> broadcast (fewer than
   ``2 * rows / RANGE_ROWS`` + groups rows) -> window within (group, range).

The plan is the same at every size: groups up to ``RANGE_ROWS`` rows are one
range.  NULL groups are groups, and NULL keys sort as in a plain window (first
when ascending, last when descending).  Sums, counts and maxima / minima are
associative, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_ROWS = 1_000_000                      # rows of one range, about
RANGE_CONF = "ligandspark.scan.range_rows"  # session setting that overrides it
RANGE = "_range"


def range_rows(df: DataFrame, given: int | None = None) -> int:
    return int(given or df.sparkSession.conf.get(RANGE_CONF, None) or RANGE_ROWS)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe broadcast join on ``keys``; the right side's other columns are added."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    return left.join(F.broadcast(renamed), on, how).drop(*[f"_k_{k}" for k in keys])


ALL = "_all"        # the one group of a table that has no groups


def at_most(sorted_values: str, x: Column, longest: int) -> Column:
    """How many of an ascending array column's values (at most ``longest``) are
    ``<= x``, by binary search: 17 steps for 100,000 values."""
    steps = F.lit([1 << b for b in range(max(0, longest.bit_length() - 1), -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(sorted_values, n + step - 1) <= x, n + step)
                       .otherwise(n))


@dataclass
class Ranged:
    """A table whose rows carry their range (column ``_range``)."""
    df: DataFrame
    by: list[str]
    key: str
    descending: bool
    large: DataFrame | None     # keys of the groups that have several ranges

    def derive(self, df: DataFrame) -> Ranged:
        """The same ranges for a narrow transformation of the table."""
        return Ranged(df, self.by, self.key, self.descending, self.large)


def assign_ranges(df: DataFrame, by: Sequence[str], key: str, descending: bool = False,
                  rows: int | None = None) -> Ranged:
    """Add ``_range``: contiguous, order-preserving ranges of ``key`` per group;
    with ``descending`` range 0 holds the largest keys."""
    if not by:                              # one group; its key is 0, but no literal, so joins on it stay hash joins
        return assign_ranges(df.withColumn(ALL, F.pmod(F.hash(key), F.lit(1))), [ALL], key, descending, rows)
    by, rows = list(by), range_rows(df, rows)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    large = counts.collect()                # fewer than rows-of-df / rows of them
    if not large:
        return Ranged(df.withColumn(RANGE, F.lit(0)), by, key, descending, None)
    spark = df.sparkSession
    # groups of one size class (a power of two of ranges) share a list of percentiles
    classes = [math.ceil(math.log2(-(-r["_n"] // rows))) for r in large]
    schema = T.StructType([df.schema[c] for c in by] + [T.StructField("_class", T.IntegerType())])
    keys = spark.createDataFrame([(*[r[c] for c in by], k) for r, k in zip(large, classes, strict=True)], schema)
    k = F.col(key).cast("double")
    held = same_keys(df.select(*by, k.alias("_v")), keys, by, "inner")
    # parsed at once: a call for each of 100,000 literals would take a minute
    cuts = [F.expr(f"percentile_approx(if(_class = {c}, _v, null), array({', '.join(f'{i / 2 ** c!r}D' for i in range(1, 2 ** c))}), "
                   f"{max(10_000, 20 * 2 ** c)})") for c in sorted(set(classes)) if c]
    bounds = held.groupBy(*by).agg(F.array_sort(F.array_distinct(F.coalesce(*cuts))).alias("_b")).collect()
    schema = T.StructType([df.schema[c] for c in by] + [T.StructField("_b", T.ArrayType(T.DoubleType()))])
    table = spark.createDataFrame([(*[r[c] for c in by], list(r["_b"] or [])) for r in bounds], schema)
    longest = max((len(r["_b"] or []) for r in bounds), default=0)
    d = same_keys(df, table, by)
    below = at_most("_b", k, longest)
    if descending:
        below = F.when(k.isNull(), F.size("_b")).otherwise(F.size("_b") - below)
    else:
        below = F.when(k.isNull(), 0).otherwise(below)
    d = d.withColumn(RANGE, F.when(F.col("_b").isNull(), 0).otherwise(below).cast("int")).drop("_b")
    return Ranged(d, by, key, descending, keys.drop("_class"))


def scan_ranges(
    ranged: Ranged, tiebreak: Sequence[str | Column] = (), sums: Sequence[str] = (), maxes: Sequence[str] = (),
    mins: Sequence[str] = (), row_number: str | None = None, inclusive: bool = True,
) -> DataFrame:
    """Running aggregates per group in key order; see :func:`prefix_scan`.
    ``_range`` stays, so that a further scan can use the same ranges."""
    df, by = ranged.df, ranged.by
    if row_number:
        df = df.withColumn("_one", F.lit(1))
        sums = [*sums, "_one"]
    if ranged.large is not None:
        groups = same_keys(df, ranged.large, by, "left_semi")
        totals = groups.groupBy(*by, RANGE).agg(
            *[F.sum(c).alias(f"_s_{c}") for c in sums], *[F.max(c).alias(f"_x_{c}") for c in maxes],
            *[F.min(c).alias(f"_m_{c}") for c in mins])
        # one row per range, so a window per group is small
        before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(
            *by, RANGE, *[F.sum(f"_s_{c}").over(before).alias(f"_s_{c}") for c in sums],
            *[F.max(f"_x_{c}").over(before).alias(f"_x_{c}") for c in maxes],
            *[F.min(f"_m_{c}").over(before).alias(f"_m_{c}") for c in mins])
        df = same_keys(df, totals, [*by, RANGE])
    key = F.col(ranged.key)
    order = [key.desc() if ranged.descending else key.asc(), *[F.col(t) if isinstance(t, str) else t for t in tiebreak]]
    w = Window.partitionBy(*by, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out, ahead = [], ranged.large is not None
    for c in sums:
        own = F.coalesce(F.sum(c).over(w), F.lit(0))
        out.append((own + F.coalesce(F.col(f"_s_{c}"), F.lit(0)) if ahead else own).alias(f"cum_{c}"))
    for c in maxes:
        own = F.max(c).over(w)
        out.append((F.greatest(own, F.col(f"_x_{c}")) if ahead else own).alias(f"runmax_{c}"))
    for c in mins:
        own = F.min(c).over(w)
        out.append((F.least(own, F.col(f"_m_{c}")) if ahead else own).alias(f"runmin_{c}"))
    res = df.select("*", *out)
    if row_number:
        res = res.withColumn(row_number, (F.col("cum__one") + (0 if inclusive else 1)).cast("long")).drop("_one", "cum__one")
    return res.drop(ALL, "_s__one", *[f"_s_{c}" for c in sums], *[f"_x_{c}" for c in maxes], *[f"_m_{c}" for c in mins])


def prefix_scan(
    df: DataFrame, by: Sequence[str], key: str, tiebreak: Sequence[str | Column] = (),
    sums: Sequence[str] = (), maxes: Sequence[str] = (), mins: Sequence[str] = (),
    row_number: str | None = None, descending: bool = False, inclusive: bool = True, rows: int | None = None,
) -> DataFrame:
    """Running aggregates per group in ``key`` order, distributed over ranges.

    For each column ``c`` in ``sums`` adds ``cum_c``; in ``maxes`` ``runmax_c``;
    in ``mins`` ``runmin_c``.  ``row_number`` (if given) names a 1-based rank
    column.  ``inclusive=False`` excludes the current row (strictly preceding).
    Rows with equal ``key`` are ordered by ``tiebreak``; if they are not
    distinguished the order among them is arbitrary, so callers aggregate to
    distinct keys first when they need tie-exact results."""
    ranged = assign_ranges(df, by, key, descending, rows)
    return scan_ranges(ranged, tiebreak, sums, maxes, mins, row_number, inclusive).drop(RANGE)
