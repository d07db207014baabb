"""Sequence embedding jobs with row quarantine.

The tokenization stays in the JVM (column expressions).  The vector comes from
an *encoder*:

* the built-in default, :func:`add_hashed_vector`, is a hashed unigram +
  bigram count vector (md5 -> bucket -> counts, each different gram of an Arrow
  batch hashed once), deterministic and checkable by SQL.  It is
  **not** a pretrained model embedding; no weights exist here.
* any Python callable ``encoder(pd.Series[str]) -> list[vector]`` plugs in
  through :func:`embed_rows`, which runs it in ``mapInArrow``
  (Arrow batches, model loaded once per Python worker by the callable's own
  caching).  A row whose encoding raises is kept with a NULL vector and the
  error text; it never aborts the job (P4).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 64

# Prefixes of the numbered wide columns of feature tables
# (compatible with existing wide CSV feature files).
SMILES_FEATURE_PREFIX = "k_bert_"
PROTEIN_FEATURE_PREFIX = "ProstT5_"


def hash_bucket(t: Column, dim: int) -> Column:
    """Bucket of a token: first 8 hex digits of md5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % F.lit(dim)).cast("int")


def ngrams(tokens: Column) -> Column:
    """Unigrams followed by bigrams ``a + ' ' + b`` of a token array."""
    bigrams = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(1))),
                         lambda a, b: F.concat(a, F.lit(" "), b))
    bigrams = F.filter(bigrams, lambda x: x.isNotNull())
    return F.concat(tokens, bigrams)


KNOWN_GRAMS = 1 << 18     # buckets that a task remembers


class GramBuckets:
    """Hashed uni- and bigram counts of Arrow lists of tokens.  Every different
    gram of a batch is hashed once, and buckets are remembered within a task."""

    def __init__(self, dim: int) -> None:
        self.dim, self.known = dim, {}

    def buckets(self, grams: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_GRAMS:
            self.known.clear()
        for g in grams:
            if g not in self.known:
                self.known[g] = int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % self.dim
        return np.array([self.known[g] for g in grams], np.int64)

    def counts(self, tokens: pa.ListArray) -> np.ndarray:
        """A row of ``dim`` counts for each list (zeros for NULL)."""
        n, dim = len(tokens), self.dim
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n, dtype=np.int64), sizes)
        if not len(row):
            return np.zeros((n, dim), np.int64)
        coded = tokens.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.bincount(row * dim + self.buckets(words)[code], minlength=n * dim)
        pair = (code[:-1] * len(words) + code[1:])[row[:-1] == row[1:]]
        if len(pair):
            coded = pa.array(pair).dictionary_encode()
            firsts, seconds = np.divmod(coded.dictionary.to_numpy(), len(words))
            hashed = self.buckets([f"{words[a]} {words[b]}" for a, b in zip(firsts, seconds, strict=True)])
            start = row[:-1][row[:-1] == row[1:]]
            out += np.bincount(start * dim + hashed[coded.indices.to_numpy()], minlength=n * dim)
        return out.reshape(n, dim)


def hashed_ngram_counts(df: DataFrame, id_col: str, tokens: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """Long form ``(id, dim, cnt)`` of hashed uni- and bigram counts (nonzero
    only).  Counted per row by :class:`GramBuckets`; at most ``dim`` rows per
    row are shuffled, for ids that repeat."""
    schema = T.StructType([df.schema[id_col], T.StructField("dim", T.IntegerType()), T.StructField("cnt", T.LongType())])

    def run(batches):
        grams = GramBuckets(dim)
        for b in batches:
            counts = grams.counts(b.column(1))
            row, at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(counts[row, at])],
                [id_col, "dim", "cnt"])

    return df.select(id_col, tokens).mapInArrow(run, schema).groupBy(id_col, "dim").agg(F.sum("cnt").alias("cnt"))


def add_hashed_vector(df: DataFrame, tokens: str, dim: int = DEFAULT_DIM, out: str = "features") -> DataFrame:
    """Replace a token array by its dense hashed uni- and bigram counts as
    ``array<double>``, in the row itself (no shuffle, no join, so repeated or
    NULL ids keep their rows); NULL where there is no token."""
    kept = [f for f in df.schema.fields if f.name not in (tokens, out)]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        grams = GramBuckets(dim)
        for b in batches:
            lists = b.column(b.num_columns - 1)
            counts = grams.counts(lists)
            none = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) == 0
            ends = np.arange(0, counts.size + 1, dim, dtype=np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.ravel().astype(np.float64)),
                                               mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vectors], [*b.schema.names[:-1], out])

    return df.select(*[f.name for f in kept], tokens).mapInArrow(run, schema)


def embed_rows(df: DataFrame, text_col: str, encoder: Callable[[pd.Series], list], dim: int) -> DataFrame:
    """All columns of ``df`` with ``features array<double>`` and ``error
    string``: ``encoder`` runs over ``text_col`` in Python workers, an Arrow
    batch at a time, and the other columns pass through untouched.

    If a whole batch fails, its rows are tried one by one, so only the failing
    rows get an error.  Filter *before* this call: it is an optimizer barrier."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("features", "error")]
                          + [T.StructField("features", T.ArrayType(T.DoubleType())),
                             T.StructField("error", T.StringType())])

    def encode(texts: pd.Series) -> list[list[float]]:
        vecs = [[float(x) for x in v] for v in encoder(texts)]
        if len(vecs) != len(texts) or any(len(v) != dim for v in vecs):
            raise ValueError(f"encoder returned a wrong shape; expected {len(texts)} vectors of length {dim}")
        return vecs

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pandas()
            try:
                vecs, errs = encode(texts), [None] * len(texts)
            except Exception:  # noqa: BLE001 - isolate the failing rows
                vecs, errs = [], []
                for t in texts:
                    try:
                        vecs += encode(pd.Series([t]))
                        errs.append(None)
                    except Exception as e:  # noqa: BLE001
                        vecs.append(None)
                        errs.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(vecs, pa.list_(pa.float64())), pa.array(errs, pa.string())],
                [*b.schema.names, "features", "error"])

    return df.drop("features", "error").mapInArrow(run, schema)


def embed_with_callable(
    df: DataFrame, id_col: str, text_col: str,
    encoder: Callable[[pd.Series], list], dim: int,
) -> DataFrame:
    """``id_col, features, error`` of :func:`embed_rows`."""
    return embed_rows(df.select(id_col, text_col), text_col, encoder, dim).select(id_col, "features", "error")


def split_quarantine(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows) - P3 keeps rows with a vector."""
    return (embedded.where(F.col("features").isNotNull()),
            embedded.where(F.col("features").isNull()))


def _observed(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """Attach a failure counter (P4) that is filled when the job runs."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count_if(F.col("features").isNull()).alias("failed"),
                      F.count(F.lit(1)).alias("rows")), obs


def _embedded_once(emb: DataFrame, name: str, out_path: str | None, prefix: str, width: int, fmt: str, layout: str):
    """Run the encoder once: the embedded table, errors included, is written to
    the shared folder; kept rows, quarantine, counts and sinks read it."""
    from ligandspark.session import scratch_path
    from ligandspark.sources.io import write_feature_table

    emb, obs = _observed(emb, name)
    path = scratch_path(emb.sparkSession, name)
    emb.write.parquet(path)
    good, bad = split_quarantine(emb.sparkSession.read.schema(emb.schema).parquet(path))
    if out_path:
        write_feature_table(good.drop("error"), out_path, "features", prefix=prefix, width=width, fmt=fmt,
                            layout=layout)
    return good, bad, obs


def featurize_smiles(df: DataFrame, id_col: str, smiles_col: str, out_path: str | None = None,
                     encoder: Callable[[pd.Series], list] | None = None, dim: int = DEFAULT_DIM,
                     prefix: str = SMILES_FEATURE_PREFIX, fmt: str = "parquet",
                     layout: str = "partitioned", cut: bool = False):
    """B1: per row tokenize -> encode -> embed; failures are counted over all
    splits (P4, via ``observe``) and dropped (P3); the kept rows are written
    per split (S5; CSV gets numbered wide columns, P2).

    ``encoder=None`` uses the hashed n-gram vector of the whole token sequence
    (not a pretrained model); a callable gets the SMILES strings.  ``cut=True``
    first takes the middle of long sequences (F3), as an encoder with a fixed
    number of positions needs.  Rows are embedded once each, repeated ids
    included.  Returns (kept rows, quarantined rows, observation)."""
    from ligandspark.functions import sequences as S
    text = S.cut_smiles(F.col(smiles_col)) if cut else F.col(smiles_col)
    base = df.withColumn("_text", text)
    if encoder is None:
        emb = add_hashed_vector(base.withColumn("_tok", S.smiles_tokens(F.col("_text"))), "_tok", dim).drop("_tok")
        emb = emb.withColumn("error", F.when(F.col("features").isNull(), F.lit("no tokens to embed")))
    else:
        emb = embed_rows(base, "_text", encoder, dim)
    return _embedded_once(emb.drop("_text"), "smiles_failures", out_path, prefix, dim, fmt, layout)


def featurize_protein(df: DataFrame, id_col: str, seq_col: str, out_path: str | None = None,
                      encoder: Callable[[pd.Series], list] | None = None, dim: int = DEFAULT_DIM,
                      prefix: str = PROTEIN_FEATURE_PREFIX, fmt: str = "parquet",
                      layout: str = "partitioned"):
    """B2: prepared protein strings (F7 + F8) -> encoder -> quarantine ->
    optional write.  The default encoder is the hashed n-gram vector of the
    residues (not a pretrained model)."""
    from ligandspark.functions import sequences as S
    if encoder is None:
        residues = F.split(F.regexp_replace(F.col(seq_col), S.RARE_RESIDUES, "X"), "")
        emb = add_hashed_vector(df.withColumn("_tok", F.filter(residues, lambda t: t != "")), "_tok", dim).drop("_tok")
        emb = emb.withColumn("error", F.when(F.col("features").isNull(), F.lit("empty sequence")))
    else:
        emb = embed_rows(df.withColumn("_prep", S.protein_prepare(F.col(seq_col))), "_prep", encoder, dim).drop("_prep")
    return _embedded_once(emb, "protein_failures", out_path, prefix, dim, fmt, layout)
