"""Toxicity with a classifier chain of linear models.

The categories are predicted one after the other; each model sees the text
features and the probabilities of the categories before it.  While training,
those probabilities come from models that did not see the row (out-of-fold), so
a later model learns from inputs as good as it gets when it is applied.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandspark.llm.common import trimmed, written

TRAIN_ROWS = 20_000   # labelled documents that the chain is fitted on at most
EVIDENCE = 6.63       # least G statistic of a feature (chance of 1 % without a link); all over it are kept
MIN_DOCS = 3          # toxic documents that a feature must occur in
FOLDS = 5
RIDGE = 0.3
THRESHOLD = 0.5
PREFIXES = (4, 5)     # letters of the word beginnings
COUNTED = 100_000     # features that a task counts before it hands them on

# Seed words of the two finer categories (labels = a toxic
# document that holds one of them); the last category is the table's own label.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown"),
    "contempt": ("scum", "trash", "worthless", "pathetic", "disgusting"),
}
CATEGORIES = (*SEEDS, "toxic")

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct words, and beginnings of longer words, of the lower-cased whole text."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


@dataclass
class Rows:
    """Rows of 0/1 columns, of which only the ones are kept (``at`` = row and
    ``column`` of each), followed by full columns."""
    at: np.ndarray
    column: np.ndarray
    sparse: int
    full: np.ndarray

    @classmethod
    def of_hits(cls, hits: Sequence[Sequence[int]], sparse: int) -> Rows:
        sizes = np.fromiter(map(len, hits), np.int64, len(hits))
        flat = np.concatenate([np.asarray(h, np.int64) for h in hits]) if len(hits) else np.zeros(0, np.int64)
        return cls(np.repeat(np.arange(len(hits)), sizes), flat, sparse, np.zeros((len(hits), 0)))

    def __len__(self) -> int:
        return len(self.full)

    @property
    def width(self) -> int:
        return self.sparse + self.full.shape[1]

    def take(self, chosen: np.ndarray) -> Rows:
        """The rows that the mask ``chosen`` marks."""
        held = chosen[self.at]
        return Rows((np.cumsum(chosen) - 1)[self.at[held]], self.column[held], self.sparse, self.full[chosen])

    def with_column(self, values: np.ndarray) -> Rows:
        return Rows(self.at, self.column, self.sparse, np.hstack([self.full, values[:, None]]))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, np.take(w, self.column), len(self)) + self.full @ w[self.sparse:]

    def summed(self, r: np.ndarray) -> np.ndarray:
        """Per column, the sum of ``r`` over the rows times their values."""
        return np.concatenate([np.bincount(self.column, r[self.at], self.sparse), self.full.T @ r])

    def summed_squares(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, r[self.at], self.sparse), (self.full ** 2).T @ r])


@dataclass
class LinearModel:
    weights: np.ndarray
    intercept: float

    def probability(self, x: Rows) -> np.ndarray:
        z = np.clip(x.times(self.weights) + self.intercept, -30, 30)
        return 1.0 / (1.0 + np.exp(-z))


def conjugate_gradients(times, b: np.ndarray, diagonal: np.ndarray, within: float) -> np.ndarray:
    """x with ``times(x)`` = b but for a share ``within``, for a positive definite
    ``times`` with this diagonal."""
    x, r = np.zeros(len(b)), b.copy()
    z = r / diagonal
    d, rz = z.copy(), r @ z
    end = within ** 2 * rz
    for _ in range(10 * len(b) + 50):
        if rz <= end or rz == 0:
            break
        q = times(d)
        step = rz / (d @ q)
        x += step * d
        r -= step * q
        z = r / diagonal
        rz, before = r @ z, rz
        d = z + rz / before * d
    return x


def fit_linear(x: Rows, y: np.ndarray, n: np.ndarray | None = None, ridge: float = RIDGE,
               steps: int = 25, start: LinearModel | None = None) -> LinearModel:
    """Logistic regression with an L2 penalty, by Newton's method, on rows that
    stand for ``n`` equal ones each.  The steps are solved by conjugate
    gradients, the closer the smaller the gradient, so time and memory go with
    the ones of ``x``, not with its columns squared; ``start`` saves steps, the optimum is the same without.
    One class only: no weights, and an intercept from the smoothed rate."""
    n = np.ones(len(y)) if n is None else n
    rate = ((n * y).sum() + 0.5) / (n.sum() + 1.0)
    w = np.zeros(x.width + 1)
    w[-1] = np.log(rate / (1 - rate))
    if 0 < y.sum() < len(y):
        x1 = x.with_column(np.ones(len(x)))
        if start is not None:
            w = np.append(start.weights, start.intercept)
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6

        def loss(w: np.ndarray) -> float:
            z = x1.times(w)
            return float((n * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2)

        now, first = loss(w), None
        for _ in range(steps):
            p = 1.0 / (1.0 + np.exp(-np.clip(x1.times(w), -30, 30)))
            gradient = x1.summed(n * (y - p)) - penalty * w
            v = n * p * (1 - p)
            size = np.linalg.norm(gradient)
            first = size if first is None else first
            step = conjugate_gradients(lambda d: x1.summed(v * x1.times(d)) + penalty * d, gradient,  # noqa: B023
                                       x1.summed_squares(v) + penalty, min(0.1, size / first))
            part, then = 1.0, loss(w + step)
            while then > now and part > 1e-3:
                part /= 2
                then = loss(w + part * step)
            if then > now:
                break
            w, now = w + part * step, then
            if np.abs(step).max() < 1e-4:
                break
    return LinearModel(w[:-1], float(w[-1]))


@dataclass
class Chain:
    """Fitted chain: feature -> column, and a model per category in order."""
    columns: dict[str, int]
    categories: tuple[str, ...]
    models: list[LinearModel]

    def row(self, text: str | None) -> list[int]:
        get = self.columns.get
        return [c for c in map(get, features(text)) if c is not None]

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """One line per row, one column per category."""
        x = Rows.of_hits(rows, len(self.columns))
        for m in self.models:
            x = x.with_column(m.probability(x))
        return x.full


def fit_models(x: Rows | np.ndarray, y: np.ndarray, folds: np.ndarray, n: np.ndarray | None = None) -> list[LinearModel]:
    """The chain's models for the label columns of ``y``, in order."""
    models = []
    n = np.ones(len(x)) if n is None else n
    if not isinstance(x, Rows):
        x = Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, np.asarray(x, np.float64))
    for c in range(y.shape[1]):
        models.append(fit_linear(x, y[:, c], n))
        if c + 1 == y.shape[1]:
            break                               # no model follows that would read it
        held_out = np.zeros(len(x))
        for f in np.unique(folds):
            out = folds == f
            rest = ~out if (~out).any() else out
            held_out[out] = fit_linear(x.take(rest), y[rest, c], n[rest], start=models[c]).probability(x.take(out))
        x = x.with_column(held_out)
    return models


def labelled(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """At most ``limit`` labelled documents, chosen by the hash of their id:
    ``doc_id, text`` and a 0/1 column per category."""
    chosen = (labels.where("doc_id is not null and toxic is not null")
              .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = src.join(F.broadcast(chosen), "doc_id")          # at most ``limit`` rows of two numbers
    for name, words in SEEDS.items():
        held = F.lower(F.coalesce("text", F.lit(""))).rlike(r"(?<![a-z])(" + "|".join(words) + r")(?![a-z])")
        rows = rows.withColumn(name, ((F.col("toxic") == 1) & held).cast("int"))
    return rows.select("doc_id", "text", *CATEGORIES)


def fit_chain(rows: DataFrame, categories: Sequence[str] = CATEGORIES, least: float = EVIDENCE) -> Chain:
    """Fit on ``rows(doc_id, text, <category 0/1 columns>)``, a bounded sample.

    Features are counted in Spark; all with an evidence of ``least`` or more
    for the last category (G statistic, positive side: more toxic documents
    than the label rate, whatever that rate is) become columns, however many.
    The models are fitted on the driver, which holds the sample's hits only."""
    last = categories[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()),
                 pa.array([v[0] for v in seen.values()], pa.int64())], ["feature", "pos", "neg"])
            seen.clear()
            return out

        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for f in features(text.as_py()):
                    seen[f][y] += 1
                if len(seen) > COUNTED:
                    yield flush()
        yield flush()

    rows = written(rows, "labelled")                        # a bounded sample, read three times
    n = {r[last]: r["n"] for r in rows.groupBy(last).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = float(n.get(1, 0)), float(n.get(0, 0))
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    total, all_rows = a + b, pos + neg + 1.0
    rate = (pos + 0.5) / all_rows
    evidence = 2 * (a * F.log(a / (total * rate)) + b * F.log(b / (total * (1 - rate))))
    top = (rows.select("text", last).mapInArrow(trimmed(count), "feature string, pos long, neg long")
           .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
           .where((F.col("pos") >= MIN_DOCS) & (a / total > rate) & (evidence >= least))
           .select("feature").toArrow().column(0).to_pylist())
    chain = Chain({f: i for i, f in enumerate(sorted(top))}, tuple(categories), [])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [sorted(chain.row(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(hits, pa.list_(pa.int32())), *b.columns[2:]],
                ["doc_id", "hits", *categories])

    schema = "doc_id long, hits array<int>, " + ", ".join(f"{c} int" for c in categories)
    sample = (rows.select("doc_id", "text", *categories).mapInArrow(trimmed(encode), schema)
              .orderBy("doc_id", "hits", *categories).toArrow().combine_chunks())
    if not sample.num_rows:
        chain.models = [LinearModel(np.zeros(len(chain.columns) + i), -30.0) for i in range(len(categories))]
        return chain
    # rows with the same features, labels and fold are one row with a count; most hold no feature at all
    marks = zip(*[sample[c].to_pylist() for c in categories], strict=True)
    equal = Counter((i % FOLDS, h.values.to_numpy(False).astype(np.int32).tobytes(), m)
                    for i, (h, m) in enumerate(zip(sample["hits"], marks, strict=True)))
    x = Rows.of_hits([np.frombuffer(hits, np.int32) for _, hits, _ in equal], len(chain.columns))
    chain.models = fit_models(x, np.array([k[2] for k in equal], np.float64), np.array([k[0] for k in equal]),
                              np.array(list(equal.values()), np.float64))
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability column ``<prefix><category>`` for every
    category.  Whole texts are read; a null text is an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # words with evidence and their weights

    @F.pandas_udf(", ".join(f"`{c}` double" for c in chain.categories))
    def run(texts):
        import pandas as pd

        c = held.value
        out = [c.probabilities([c.row(t) for t in texts.iloc[i:i + 512]]) for i in range(0, len(texts), 512)]
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, len(c.categories))),
                            columns=list(c.categories))

    names = [prefix + c for c in chain.categories]
    scored = docs.drop(*names).withColumn("_llm_p", run(F.col(text).cast("string")))
    return scored.withColumns({n: F.col(f"_llm_p.{c}") for n, c in zip(names, chain.categories, strict=True)}
                              ).drop("_llm_p")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with ``p_insult, p_contempt, p_toxic`` and
    ``is_toxic`` (p_toxic at or over ``threshold``).

    The chain is fitted on at most ``TRAIN_ROWS`` labelled documents.  Without
    labels, or with one class only, p_toxic is the smoothed rate or near 0, and
    nothing is toxic unless that rate is.  Rows with a null id, null or empty
    text and repeated rows are scored like any other; columns with the result
    names are replaced, other columns stay."""
    chain = fit_chain(labelled(docs, labels))
    return score(docs.drop("is_toxic"), chain).withColumn("is_toxic", F.col("p_toxic") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with the same columns."""
    own = docs.withColumns({f"_llm_{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    scored = score(own, fit_chain(labelled(docs, labels)), prefix="_llm_p_")
    return scored.where(F.col("_llm_p_toxic") < threshold).select(
        *[F.col(f"_llm_{i}").alias(c) for i, c in enumerate(docs.columns)])
