"""Near-duplicate vectors with spherical-cap filters from random product codes.

A filter is a direction; a vector passes it if their inner product reaches the
cap height, so close vectors pass common filters and far ones rarely do.  The
directions of one code are all concatenations of one word from each of two
random codebooks (``WORDS ** 2`` directions), which lets a vector list all its
filters without looking at each: block products are sorted and combined only
where the sum reaches the height.  Several randomly rotated codes make a miss
unlikely.  Vectors meet on common filters, and every pair is verified.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandspark.llm.common import cut, lookup, written
from ligandspark.llm.components import connected_components
from ligandspark.llm.simhash import forest

COSINE = 0.93
CODES = 10          # rotated product codes
WORDS = 512         # words of a codebook; WORDS ** 2 filters of a code
HEIGHT = 4.0        # cap height in units of 1 / sqrt(dimension)
LEAST_DIM = 64      # shorter vectors are padded with zeros
TILE = 1024         # vectors compared at once
SEED = 11


@functools.lru_cache(maxsize=4)
def product_codes(dim: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rotation and the two codebooks of each code, the same wherever they are made."""
    rng = np.random.default_rng([SEED, dim])
    out = []
    for _ in range(CODES):
        rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        books = []
        for width in (dim // 2, dim - dim // 2):
            book = rng.standard_normal((WORDS, width))
            books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
        out.append((rotation, *books))
    return out


def filters_of(units: np.ndarray) -> list[np.ndarray]:
    """For each unit vector the numbers of all filters that it passes."""
    dim = max(LEAST_DIM, units.shape[1])
    x = np.zeros((len(units), dim))
    x[:, :units.shape[1]] = units
    least = HEIGHT / math.sqrt(dim) * math.sqrt(2)       # of the sum over both blocks
    found: list[list[np.ndarray]] = [[] for _ in range(len(units))]
    for c, (rotation, first, second) in enumerate(product_codes(dim)):
        y = x @ rotation
        a, b = y[:, :dim // 2] @ first.T, y[:, dim // 2:] @ second.T
        order = np.argsort(-b, axis=1)
        sorted_b = np.take_along_axis(b, order, axis=1)
        for i in range(len(units)):
            heads = np.flatnonzero(a[i] >= least - sorted_b[i, 0])
            if len(heads):
                n = np.searchsorted(-sorted_b[i], -(least - a[i, heads]), side="right")
                head = np.repeat(heads, n)
                rank = np.arange(len(head)) - np.repeat(np.cumsum(n) - n, n)
                found[i].append((c * WORDS + head) * WORDS + order[i, rank])
    return [np.sort(np.concatenate(f)).astype(np.int32) if f else np.zeros(0, np.int32) for f in found]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """List column without nulls, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _valid(vector):
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def tile_links(ids: np.ndarray, counts: np.ndarray, units: np.ndarray, lists: list[np.ndarray], own: int,
               sides: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Verified pairs of one tile of filter ``own``, each counted only at the
    smallest filter that its two vectors share: ids with the vectors linked
    to them, and links that connect the same ids."""
    near = np.triu(units @ units.T >= least, 1)
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    some = np.flatnonzero(near.any(0) | near.any(1))
    if not len(some):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    near = near[np.ix_(some, some)]
    earlier = [x[:np.searchsorted(x, own)] for x in (lists[i] for i in some)]
    at, number = np.unique(np.concatenate(earlier), return_inverse=True)
    if len(at):
        has = np.zeros((len(some), len(at)), np.float32)
        has[np.repeat(np.arange(len(some)), [len(e) for e in earlier]), number] = 1
        near &= has @ has.T < 0.5
    n = counts[some]
    links = near @ n + near.T @ n
    a, b = np.nonzero(near)
    low, high = forest(ids[some[a]], ids[some[b]]) if len(a) else (np.zeros(0, np.int64),) * 2
    there = links > 0
    return ids[some[there]], links[there], low, high


def near_duplicates(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of
    ``vectors(vec_id, embedding, label, ...)``.

    Two vectors link if their labels are equal and not null and their cosine
    (double precision) is ``least`` or more.  A vector that is null, empty, all
    zero, or holds a null or non-finite component, links with nothing, as do
    vectors of different lengths.  Equal vectors of a label are one class, so a
    large group of copies costs one vector.  ``n_links`` counts the other rows
    linked directly; ``component_id`` is the smallest vec_id reachable.  Rows of
    equal vec_id are rows of their own with the same id; a null vec_id is never
    the smallest, and ``kept`` is then null-safe equality.  Other columns are
    ignored; no rows give no rows.  Pairs at the least cosine are missed with a
    chance of about one in a hundred; closer pairs, less."""
    emb = F.col("embedding").cast("array<float>")
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), emb.alias("embedding"),
                         F.col("label").alias("label"))
    good = F.col("label").isNotNull() & _valid(F.col("embedding"))
    key = F.concat(F.hex(F.xxhash64("embedding", "label")), F.lit(":"),
                   F.hex(F.xxhash64(F.lit(1), "label", "embedding")))
    rows = written(src.withColumn("key", F.when(good, key)), "vectors")
    classes = (rows.where("key is not null").groupBy("key")
               .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"),
                    F.first("embedding").alias("embedding"), F.first("label").alias("label"))
               .withColumn("id", F.xxhash64("key")))     # node number, also where vec_id is null or repeated

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists: list = [None] * b.num_rows
            lengths = np.diff(b.column(1).offsets.to_numpy())
            for width in np.unique(lengths):
                at = np.flatnonzero(lengths == width)
                for lo in range(0, len(at), 512):
                    part = at[lo:lo + 512]
                    x = _matrix(b.column(1).take(pa.array(part))).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for i, f in zip(part, filters_of(x), strict=True):
                        lists[i] = f
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))],
                                             [*b.schema.names, "filters"])

    coded = written(classes.select("id", "embedding", F.hash("label", F.size("embedding")).alias("grp"),
                                   "n", "key", "first_id", "label")
                    .mapInArrow(decode, "id long, embedding array<float>, grp int, n long, key string, "
                                        f"first_id long, label {dict(rows.dtypes)['label']}, filters array<int>"),
                    "filters")
    member = coded.select("id", "label", F.size("embedding").alias("dim"), F.explode("filters").alias("filter"))
    bucket = ["label", "dim", "filter"]
    shared = cut(member.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    met = member.join(shared, bucket)
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(3)), tiles.cast("long")).cast("int")
    dealt = (met.withColumn("side", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
             .select("id", "filter", "side", "size",
                     F.xxhash64(*bucket, F.least("side", "other"), F.greatest("side", "other")).alias("tile"),
                     (F.col("side") != F.col("other")).alias("cross"))
             .join(coded.select("id", "n", "embedding", "filters"), "id"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch | None:
            x = _matrix(t.column("embedding").combine_chunks()).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            side = t.column("side").to_numpy()
            ids, links, low, high = tile_links(
                t.column("id").to_numpy(), t.column("n").to_numpy(), x,
                [np.asarray(f, np.int32) for f in t.column("filters").combine_chunks().to_numpy(zero_copy_only=False)],
                t.column("filter")[0].as_py(), side if t.column("cross")[0].as_py() else None, least)
            if not len(ids):
                return None
            k = len(low)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((ids, low))), pa.array(np.concatenate((links, np.zeros(k, np.int64)))),
                 pa.array(np.concatenate((np.zeros(len(ids), np.int64), high))),
                 pa.array(np.concatenate((np.zeros(len(ids), bool), np.ones(k, bool))))],
                ["a", "links", "b", "is_link"])

        def closed(all_rows: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            tile = t.column("tile").to_numpy()
            at = np.concatenate(([0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]))
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi == len(tile) and not all_rows:
                    held.extend(t.slice(lo).combine_chunks().to_batches())
                elif hi - lo > 1:
                    out = done(t.slice(lo, hi - lo))
                    if out is not None:
                        yield out

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if b.column("tile")[0] != b.column("tile")[-1] or held[0].column("tile")[0] != b.column("tile")[0]:
                yield from closed(False)
        if held:
            yield from closed(True)

    # one tile (a bucket, or two blocks of a large one) is compared at a time: at most 2 * TILE vectors or so
    found = written(dealt.repartition("tile").sortWithinPartitions("tile", "id")
                    .mapInArrow(compare, "a long, links long, b long, is_link boolean"), "links")
    comp = connected_components(found.where("is_link").select("a", "b")).withColumnRenamed("node", "id")
    links = found.where("not is_link").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    named = (coded.select("id", "key", "n", "first_id").join(links, "id", "left").join(comp, "id", "left")
             .select("key", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "id").alias("component")))
    named = cut(named)
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = lookup(named, "component", ids).select("key", "n_links", "component_id")
    linked = lookup(rows.where("key is not null").select("vec_id", "key"), "key", named)
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
