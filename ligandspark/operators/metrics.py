"""Exact binary, masked multi-task and regression metrics as DataFrame jobs.

Every metric is one aggregation per group (``by``), never a collect:

* threshold metrics (confusion counts, accuracy, precision, ...) are plain
  ``count_if`` sums, combined map-side;
* ranking metrics (ROC AUC, average precision, trapezoid PR area, ROC points)
  first collapse rows to ``(group, score) -> (pos, neg)`` (map-side combine,
  so a score value held by a third of the rows is one row), then take running
  totals with :func:`ligandspark.plans.scan.prefix_scan` (bucketed, so a hot
  group is spread over many tasks).

Conventions kept from the reference: precision / recall / F1 of 0/0 are 0,
specificity without negatives is 1.0, the 7-metric report thresholds with
``p > 0.5`` and the 9-metric report with ``p >= 0.5``; AUC of a group with one
class is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandspark.plans.scan import prefix_scan

METRIC_NAMES = ("roc_auc", "l1", "rmse", "mae", "mse", "roc_prc", "r2", "return_pred_true")


def sigmoid(x: Column) -> Column:
    """Logit -> probability, in double."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))


def softplus(x: Column) -> Column:
    """log(1 + e^x) computed without overflow (finite at +-800)."""
    x = x.cast("double")
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def decision(p: Column, threshold: float = 0.5, inclusive: bool = False) -> Column:
    """Hard 0/1 decision (P5): ``p > t`` or, inclusive, ``p >= t``."""
    return F.when(p >= threshold if inclusive else p > threshold, 1).otherwise(0)


def _div(a: Column, b: Column, default) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a.cast("double") / b.cast("double"))


# --------------------------------------------------------------------------
# confusion-count metrics
# --------------------------------------------------------------------------

def _threshold_columns(tn, fp, fn, tp) -> dict[str, Column]:
    n = tn + fp + fn + tp
    return {
        "accuracy": _div(tp + tn, n, None),
        "precision": _div(tp, tp + fp, 0.0),
        "recall": _div(tp, tp + fn, 0.0),
        "f1": _div(2 * tp, 2 * tp + fp + fn, 0.0),
        "specificity": _div(tn, tn + fp, 1.0),
    }


def mcc(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Matthews correlation; 0 when any margin is 0."""
    tn, fp, fn, tp = (c.cast("double") for c in (tn, fp, fn, tp))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den)


# --------------------------------------------------------------------------
# ranking metrics
# --------------------------------------------------------------------------

def score_counts(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Collapse to one row per (group, distinct score) with pos / neg counts.

    NULL and NaN scores are dropped (Spark orders NaN above every number).
    """
    s = F.col(score).cast("double")
    g = (
        df.where(F.col(label).isin(0, 1))
        .groupBy(*by, s.alias("_score"))
        .agg(
            F.count_if(F.col(label) == 1).cast("long").alias("pos"),
            F.count_if(F.col(label) == 0).cast("long").alias("neg"),
            F.max((s.isNotNull() & ~F.isnan(s)).cast("int")).alias("_ok"),
        )
    )
    # Validity is filtered as an aggregate output: a filter on the score
    # itself would be pushed below the aggregation and below repartitions,
    # to where an expensive score is first computed (one task per scan split).
    return g.where(F.col("_ok") == 1).drop("_ok")


def ranking_curve(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Per group and distinct score (descending): pos, neg, cum_pos (= TP at
    threshold ``score``), cum_neg (= FP)."""
    return curve_from_counts(score_counts(df, by, score, label), by)


def curve_from_counts(counts: DataFrame, by: Sequence[str], rows: int | None = None) -> DataFrame:
    """:func:`ranking_curve` from a ``(by..., _score, pos, neg)`` count table
    whose scores are distinct per group (e.g. accumulated batch counts)."""
    return prefix_scan(counts, list(by), "_score", sums=["pos", "neg"], descending=True, rows=rows)


def metrics_from_curve(c: DataFrame, by: Sequence[str], threshold: float | None = None,
                       inclusive: bool = False) -> DataFrame:
    """One aggregation over a ranking curve: n_pos, n_neg, roc_auc,
    average_precision, pr_auc_trapezoid and, with ``threshold``, the
    confusion counts of ``score > t`` (or ``>= t``).

    No group totals are joined back: AUC = (P*N - sum pos*cum_neg +
    sum pos*neg/2) / (P*N) needs P and N only inside the same aggregation;
    AP and the trapezoid area use the cumulative counts of each row."""
    by = list(by)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    prec = tp / (tp + fp)
    prev_den = tp - pos + fp - neg
    prev_prec = F.when(prev_den == 0, F.lit(1.0)).otherwise((tp - pos) / prev_den)
    aggs = [
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(pos * fp).alias("_pf"), F.sum(pos * neg).alias("_pn"),
        F.sum(pos * prec).alias("_ap_num"),
        F.sum(pos * (prec + prev_prec) / 2.0).alias("_tr_num"),
    ]
    if threshold is not None:
        above = F.col("_score") >= threshold if inclusive else F.col("_score") > threshold
        aggs += [F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
                 F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp")]
    agg = c.groupBy(*by).agg(*aggs)
    P = F.col("n_pos").cast("double")
    N = F.col("n_neg").cast("double")
    cols = [
        *by, "n_pos", "n_neg",
        F.when((P > 0) & (N > 0), (P * N - F.col("_pf") + 0.5 * F.col("_pn")) / (P * N)).alias("roc_auc"),
        F.when(P > 0, F.col("_ap_num") / P).alias("average_precision"),
        F.when(P > 0, F.col("_tr_num") / P).alias("pr_auc_trapezoid"),
    ]
    if threshold is not None:
        cols += ["tp", "fp", (F.col("n_pos") - F.col("tp")).alias("fn"), (F.col("n_neg") - F.col("fp")).alias("tn")]
    return agg.select(*cols)


def ranking_metrics(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """roc_auc (A8), average_precision (A9), pr_auc_trapezoid (A10) per group."""
    return metrics_from_curve(ranking_curve(df, by, score, label), by)


def roc_points(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """ROC curve table (A11): one row per group and distinct threshold with
    fpr / tpr of ``score >= threshold``; every threshold is kept."""
    by = list(by)
    counts = score_counts(df, by, score, label)
    c = curve_from_counts(counts, by)
    if by:
        # group totals from the curve itself: its last running totals
        ends = c.groupBy(*by).agg(F.max("cum_pos").alias("P"), F.max("cum_neg").alias("N"))
        ends = ends.withColumnsRenamed({b: f"_k_{b}" for b in by})
        on = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by])
        c = c.join(ends, on).drop(*[f"_k_{b}" for b in by])
    else:
        # two numbers: brought back as literals, no join
        t = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
        c = c.withColumn("P", F.lit(t["P"] or 0)).withColumn("N", F.lit(t["N"] or 0))
    return c.select(
        *by,
        F.col("_score").alias("threshold"),
        _div(F.col("cum_neg"), F.col("N"), None).alias("fpr"),
        _div(F.col("cum_pos"), F.col("P"), None).alias("tpr"),
    )


# --------------------------------------------------------------------------
# reports
# --------------------------------------------------------------------------

def report7(df: DataFrame, by: Sequence[str], prob: str, label: str) -> DataFrame:
    """accuracy, precision, recall, f1, specificity, roc_auc, pr_auc.

    Decisions are ``prob > 0.5``; pr_auc is average precision.  Everything
    comes from one aggregation over the ranking curve (rows with a NULL / NaN
    score or a label other than 0 / 1 are not counted)."""
    by = list(by)
    r = metrics_from_curve(ranking_curve(df, by, prob, label), by, 0.5, inclusive=False)
    m = _threshold_columns(*(F.col(x) for x in ("tn", "fp", "fn", "tp")))
    return r.select(*by, *[v.alias(k) for k, v in m.items()], "roc_auc",
                    F.col("average_precision").alias("pr_auc"))


def report9(df: DataFrame, by: Sequence[str], prob: str, label: str) -> DataFrame:
    """auc, accuracy, se, sp, f1, pre, rec, err, mcc (A7); decisions ``>= 0.5``;
    se / sp rounded to 4 as in the reference, NULL for an empty class."""
    by = list(by)
    r = metrics_from_curve(ranking_curve(df, by, prob, label), by, 0.5, inclusive=True)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    m = _threshold_columns(tn, fp, fn, tp)
    return r.select(
        *by,
        F.col("roc_auc").alias("auc"),
        m["accuracy"].alias("accuracy"),
        F.round(_div(tp, tp + fn, None), 4).alias("se"),
        F.round(_div(tn, tn + fp, None), 4).alias("sp"),
        m["f1"].alias("f1"),
        m["precision"].alias("pre"),
        m["recall"].alias("rec"),
        (F.lit(1.0) - m["accuracy"]).alias("err"),
        mcc(tn, fp, fn, tp).alias("mcc"),
    )


# --------------------------------------------------------------------------
# masked multi-task metrics (Meter)
# --------------------------------------------------------------------------

def masked(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Rows a task's metric uses (P6); a missing mask counts as 1."""
    return df.where(F.coalesce(F.col(mask), F.lit(1.0)) != 0)


def regression_metrics(df: DataFrame, by: Sequence[str], y: str, pred: str) -> DataFrame:
    """Per group: n, l1_mean, l1_sum, mse, rmse, mae, r2 from one pass of sums
    (A12-A15).  The reference's ``mae`` computes the MSE; here ``mse`` is that
    value and ``mae`` is the mean absolute error.  Rows without a label or a
    prediction (NULL or NaN) are left out and counted in ``n_dropped``; ``r2``
    of constant labels is NULL."""
    yc, pc = F.nanvl(F.col(y).cast("double"), F.lit(None)), F.nanvl(F.col(pred).cast("double"), F.lit(None))
    e = yc - pc
    both = F.when(e.isNotNull(), yc)
    a = df.groupBy(*by).agg(
        F.count(e).alias("n"),
        F.count_if(e.isNull()).alias("n_dropped"),
        F.sum(F.abs(e)).alias("_sae"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(both) * F.count(e)).alias("_sst"),      # merged moments: no cancellation at large means
    )
    n = F.col("n").cast("double")
    sst = F.col("_sst")
    return a.select(
        *by,
        "n",
        "n_dropped",
        (F.col("_sae") / n).alias("l1_mean"),
        F.col("_sae").alias("l1_sum"),
        (F.col("_sse") / n).alias("mse"),
        F.sqrt(F.col("_sse") / n).alias("rmse"),
        (F.col("_sae") / n).alias("mae"),
        F.round(F.when(sst > 0, F.lit(1.0) - F.col("_sse") / sst), 4).alias("r2"),
    )


def compute_metric(df: DataFrame, metric_name: str, by: Sequence[str] = ("task",),
                   logit: str = "logit", y: str = "y", mask: str = "mask",
                   reduction: str = "mean") -> DataFrame:
    """Metric dispatch by name (A16) over a long ``(task, y, logit, mask)`` table.

    ``roc_auc`` and ``r2`` are rounded to 4 like the reference; ``roc_prc`` is
    the trapezoid PR area after the sigmoid."""
    if metric_name not in METRIC_NAMES:
        raise ValueError(f"unknown metric {metric_name!r}; expected one of {METRIC_NAMES}")
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduction!r}")
    by = list(by)
    m = masked(df, mask)
    if metric_name == "return_pred_true":
        return m.select(*by, F.col(logit).alias("y_pred"), F.col(y).alias("y_true"))
    if metric_name in ("roc_auc", "roc_prc"):
        p = m.withColumn("_p", sigmoid(F.col(logit)))
        r = ranking_metrics(p, by, "_p", y)
        if metric_name == "roc_auc":
            return r.select(*by, F.round("roc_auc", 4).alias("value"))
        return r.select(*by, F.col("pr_auc_trapezoid").alias("value"))
    r = regression_metrics(m, by, y, logit)
    col = {"l1": "l1_sum" if reduction == "sum" else "l1_mean", "rmse": "rmse",
           "mae": "mse", "mse": "mse", "r2": "r2"}[metric_name]
    return r.select(*by, F.col(col).alias("value"))


# --------------------------------------------------------------------------
# losses
# --------------------------------------------------------------------------

def weighted_bce(logit: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """Per-row BCE on logits with positive weight (A23), overflow-safe."""
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    y = y.cast("double")
    return w * y * softplus(-logit) + (F.lit(1.0) - y) * softplus(logit)
