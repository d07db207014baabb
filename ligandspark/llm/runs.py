"""Periodic runs of words in whole texts, found with a recompression grammar.

A run is a stretch of consecutive words with a period q that is repeated often
enough and cannot be made longer.  For each q, places a multiple of the grid's
step apart are candidates together with the places q further on: a long enough
run covers one of them (the grids of all q together have n log n places).  Two
extension queries in the grammar give the exact ends of the stretch with period
q around a candidate.  No suffix array is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandspark.llm.common import byte_batches
from ligandspark.llm.recompression import Grammar

LEAST = 6               # words of a run at least
TIMES = 4               # and periods of it at least
SLICE_BYTES = 2 << 20   # texts that share a grammar; a longer text has its own
QUERIES = 1 << 19       # extension queries answered at once

RUN = "struct<start:long,length:long,period:long>"


def find_runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Runs of each sequence of word numbers (0 and up): rows ``start, length,
    period`` by start and period; the period is the smallest one.  ``times`` is 2
    or more."""
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    n = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-n, kind="stable")           # so that the texts long enough for a period come first
    sizes = n[order]
    starts = np.cumsum(sizes + 1) - sizes           # a mark that occurs once stands before each text, and at the end
    s = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    marks = np.append(starts - 1, len(s) - 1)
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    s[marks] = top + np.arange(len(marks))
    for k, at in zip(order, starts, strict=True):
        s[at:at + n[k]] = texts[k]
    reach = np.maximum(least, times * np.arange(1, int(n.max(initial=0)) // times + 1))    # by q - 1
    texts_of = np.searchsorted(-sizes, -reach, side="right")        # texts with at least that many words
    grammar, found, waiting, held = None, [], [], 0

    def answer() -> None:
        nonlocal grammar, waiting, held
        i = np.concatenate([w[0] for w in waiting])
        q = np.concatenate([np.full(len(w[0]), w[1], np.int64) for w in waiting])
        waiting, held = [], 0
        if grammar is None:
            grammar = Grammar(s)
        for c in range(0, len(i), QUERIES):
            a, p = i[c:c + QUERIES], q[c:c + QUERIES]
            right = grammar.extend(a, a + p, 1)
            left = grammar.extend(a, a + p, -1) - 1         # the candidate itself is counted once
            start, length = a - left, left + right + p
            whole = length >= np.maximum(least, times * p)
            rows = np.stack([start[whole], length[whole], p[whole]], axis=1)
            found.append(rows[_first_of_stretch(rows)])

    for q in range(1, len(reach) + 1):
        last = texts_of[q - 1]
        if last == 0:
            break
        end = int(starts[last - 1] + sizes[last - 1])
        # places x with x and x + q in the run: reach - q of them in a row
        step = int(reach[q - 1]) - q
        x = s[int(starts[0]):end - q:step]
        hits = np.flatnonzero(x == s[int(starts[0]) + q:end:step][:len(x)])
        if len(hits):
            waiting.append((int(starts[0]) + hits * step, q))
            held += len(hits)
        if held > QUERIES:
            answer()
    if held:
        answer()
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if found:
        rows = np.concatenate(found)
        rows = rows[_first_of_stretch(rows)]
        place = np.searchsorted(starts, rows[:, 0], side="right") - 1
        rows[:, 0] -= starts[place]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0], place))]
        place = np.sort(place)
        cuts = np.searchsorted(place, np.arange(len(texts) + 1))
        for r, k in enumerate(order):
            out[k] = rows[cuts[r]:cuts[r + 1]]
    return out


def _first_of_stretch(rows: np.ndarray) -> np.ndarray:
    """Indexes of the rows of each (start, length) with its smallest period: a
    stretch that has a period of at most half its length has no other maximal
    stretch with a divisor of that period."""
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    r = rows[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:, 0] != r[:-1, 0]) | (r[1:, 1] != r[:-1, 1])
    return order[new]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stand in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (structs of ``start, length, period``, by
    start and period) and ``collapsed``, the words of the text joined by one
    blank without those that stand in a run after its first period.

    Words are parted by blanks and the characters U+0009 to U+000D only.  Whole
    texts are read; a null or empty text has no words, no runs and an empty
    ``collapsed``.  Rows are taken one by one, so null ids and repeated rows are
    rows like others; columns with the result names are replaced, other columns
    stay; no rows give no rows."""

    def one_slice(texts: list[bytes]) -> tuple[list[int], list[list[dict]], list[bytes]]:
        words = [t.split() for t in texts]
        sizes = [len(w) for w in words]
        flat = np.empty(sum(sizes), object)
        flat[:] = [x for w in words for x in w]
        numbers = pd.factorize(flat)[0] if len(flat) else np.zeros(0, np.int64)
        cuts = np.cumsum([0, *sizes])
        found = find_runs([numbers[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], least, times)
        kept = []
        for w, r in zip(words, found, strict=True):
            gone = dropped(len(w), r) if len(r) else None
            kept.append(b" ".join(w if gone is None else [x for x, g in zip(w, gone, strict=True) if not g]))
        runs = [[{"start": a, "length": b, "period": c} for a, b, c in r.tolist()] for r in found]
        return sizes, runs, kept

    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).fill_null("").cast(pa.binary())
            size = pc.binary_length(texts).to_pylist()
            for i, j in byte_batches(size, SLICE_BYTES):
                n, runs, kept = one_slice(texts.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, j - i) for c in b.columns[:-1]], pa.array(n, pa.int64()),
                     pa.array(runs, pa.list_(kind)), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*own, "n_words", "runs", "collapsed"])

    kept_columns = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    own = [f"c{i}" for i in range(len(kept_columns))]
    src = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept_columns, own, strict=True)],
                      F.col(text).cast("string").alias("_text"))
    fields = [f"`{o}` {src.schema[o].dataType.simpleString()}" for o in own]
    done = src.mapInArrow(run, ", ".join([*fields, "n_words long", f"runs array<{RUN}>", "collapsed string"]))
    return done.select(*[F.col(o).alias(c) for c, o in zip(kept_columns, own, strict=True)],
                       "n_words", "runs", "collapsed")
