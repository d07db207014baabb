"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours share most bits.  The
index factors the bits that all codes of a node share (a masked pattern) into
the node and leaves to its children only the bits that still differ.  A query
walks down from the root, adds the differing bits of each masked pattern, and
drops a whole group as soon as the sum exceeds the radius.

Distributed: distinct fingerprints are cut into ranges of the Gray rank.  The
masked pattern of each range is one row; these rows (one per ``PART_CODES``
fingerprints) form the upper tree that sends a fingerprint only to the ranges
that can hold a partner.  Each range builds its own lower tree in one task and
answers the fingerprints sent to it in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandspark.llm.common import cut, lookup, written
from ligandspark.llm.components import connected_components

SHINGLE = 3          # words
RADIUS = 2           # differing bits
SEED = 42            # of XXH64
PART_CODES = 50_000  # fingerprints of one Gray range (index part)
MIN_PARTS = 24
FAN = 8              # children of an index node
QUERY_BLOCK = 4096   # queries walked together


# ---------------------------------------------------------------- fingerprints

def simhash(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over the ``n``-word shingles of ``text``, repeats included.

    Words are the runs between ASCII white space, A-Z lower-cased.  Fewer than
    ``n`` words: the whole sequence is one shingle.  No words (null, empty,
    blank): 0.  A bit is 1 if more than half of the shingle hashes have it."""
    from xxhash import xxh64_intdigest

    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= n:
        hashes = np.array([xxh64_intdigest(norm, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.fromiter(
            (xxh64_intdigest(norm[s:e], seed)
             for s, e in zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist(), strict=True)),
            np.uint64, len(words) - n + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), n) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


# ----------------------------------------------------------------------- index

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence (uint64)."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def signed(u: np.ndarray) -> np.ndarray:
    """uint64 -> int64 in the same order."""
    return (u ^ np.uint64(1 << 63)).view(np.int64)


class GrayIndex:
    """Hierarchical index over masked patterns given in Gray order.

    ``patterns`` / ``masks`` describe the lowest level: single codes have a
    full mask, the upper tree's leaves have the bits that a range shares."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None, fan: int = FAN) -> None:
        self.fan = fan
        ones = patterns & (masks if masks is not None else ~np.uint64(0))
        mask = masks if masks is not None else np.full(len(patterns), ~np.uint64(0))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []      # from the lowest up
        while True:
            if len(ones) <= 1:
                self.levels.append((ones, mask))
                break
            at = np.arange(0, len(ones), fan)
            shared = np.bitwise_and.reduceat(mask, at)
            both = np.bitwise_and.reduceat(ones, at)
            some = np.bitwise_or.reduceat(ones, at)
            shared &= ~(both ^ some)
            above = np.repeat(shared, np.diff(np.append(at, len(ones))))
            self.levels.append((ones & ~above, mask & ~above))     # shared bits move up
            ones, mask = both & shared, shared

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (query number, leaf number) whose summed differences stay within ``radius``."""
        for start in range(0, len(queries), QUERY_BLOCK):
            q = queries[start:start + QUERY_BLOCK]
            who = np.arange(len(q))
            pattern, mask = self.levels[-1]
            if not len(pattern):
                return
            acc = np.bitwise_count((q ^ pattern[0]) & mask[0])
            keep = acc <= radius
            who, acc, node = who[keep], acc[keep], np.zeros(int(keep.sum()), np.int64)
            for pattern, mask in reversed(self.levels[:-1]):
                child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                w, a = np.repeat(who, self.fan), np.repeat(acc, self.fan)
                there = child < len(pattern)
                child, w, a = child[there], w[there], a[there]
                a = a + np.bitwise_count((q[w] ^ pattern[child]) & mask[child])
                keep = a <= radius
                node, who, acc = child[keep], w[keep], a[keep]
            if len(who):
                yield who + start, node


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) that connect what ``a - b`` connect."""
    nodes, ab = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ab[:len(a)], ab[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[label[own]], nodes[own]


# ----------------------------------------------------------------------- links

def hamming_links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``codes(fp)`` with distinct fp -> links ``a, b`` whose components are
    those of all pairs at ``radius`` or fewer differing bits."""
    n = codes.count()
    parts = max(MIN_PARTS, -(-n // PART_CODES))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = signed(gray_rank(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r)], ["fp", "rank"])

    ranked = cut(codes.select("fp").mapInArrow(rank, "fp long, rank long"))
    # one number per part, so bounded by n / PART_CODES
    fractions = [i / parts for i in range(1, parts)]
    row = ranked.agg(F.percentile_approx("rank", fractions, 20 * parts).alias("c")).first()
    cuts = np.array(sorted(set(row["c"] or [])), np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.searchsorted(cuts, b.column(1).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), b.column(0), b.column(1)], ["part", "fp", "rank"])

    placed = ranked.mapInArrow(assign, "part int, fp long, rank long")
    shared = (placed.groupBy("part").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some"))
              .orderBy("part").collect())                    # one row per part
    numbers = np.array([r["part"] for r in shared], np.int32)
    ones = np.array([r["ones"] for r in shared], np.int64).view(np.uint64)
    some = np.array([r["some"] for r in shared], np.int64).view(np.uint64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = GrayIndex(ones, ~(ones ^ some))
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False)
            rk = b.column(2).to_numpy(zero_copy_only=False)
            yield _routed(own, np.zeros(len(own), np.int8), fp, rk)
            for who, leaf in upper.search(fp.view(np.uint64), radius):
                part = numbers[leaf]
                later = part > own[who]                      # each pair meets once
                yield _routed(part[later], np.ones(int(later.sum()), np.int8), fp[who[later]], rk[who[later]])

    def _routed(part, query, fp, rk) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (part, query, fp, rk)],
                                          ["part", "query", "fp", "rank"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codes, index = None, [], None

        def links(queries: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
            for who, leaf in index.search(queries, radius):
                if own:
                    once = leaf > who
                    who, leaf = who[once], leaf[once]
                if len(who):
                    a, b = forest(queries[who].view(np.int64), base[leaf].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            p = batch.column(0).to_numpy(zero_copy_only=False)
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.flatnonzero(np.diff(p) | np.diff(kind)) + 1
            for lo, hi in zip(np.append(0, at), np.append(at, len(p)), strict=True):
                if lo == hi:
                    continue
                if p[lo] != part:
                    if index is None and codes:
                        base = np.concatenate(codes)
                        index = GrayIndex(base)
                        yield from links(base, True)
                    part, codes, index = p[lo], [], None
                if kind[lo] == 0:
                    codes.append(fp[lo:hi].copy())
                    continue
                if index is None:
                    base = np.concatenate(codes)
                    index = GrayIndex(base)
                    yield from links(base, True)
                yield from links(fp[lo:hi], False)
        if index is None and codes:
            base = np.concatenate(codes)
            index = GrayIndex(base)
            yield from links(base, True)

    sent = placed.mapInArrow(route, "part int, query byte, fp long, rank long")
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part", "query", "rank")
    return dealt.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text, ...)``.

    Documents link when their fingerprints differ in ``radius`` or fewer bits;
    ``component_id`` is the smallest doc_id reachable over links, the own one
    included.  Null, empty and blank texts have fingerprint 0 and link like any
    other.  A null doc_id gets a fingerprint and links others, but is never the
    smallest; a group of null ids has a null component_id.  Repeated rows give
    repeated result rows.  Other columns are ignored.  No rows give no rows.

    Equal fingerprints are one node, so a large group of copies is one code;
    a code has at most 2,080 others within two bits."""
    own = written(fingerprints(docs, n), "fingerprints")
    codes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = connected_components(hamming_links(codes, radius)).withColumnRenamed("node", "fp")
    rooted = cut(codes.join(comp, "fp", "left")
                 .select("fp", "first_id", F.coalesce("component", "fp").alias("component")))
    ids = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = lookup(rooted.select("fp", "component"), "component", ids).select("fp", "component_id")
    return lookup(own, "fp", named).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each near-duplicate group of ``docs(doc_id, text, ...)``,
    that of the smallest doc_id, with all its columns.

    A null doc_id is replaced by a large number made from the text's hash, so
    such a row stays only in a group without ids.  Rows that repeat id and text
    are one document; rows of one id with other texts stand or go together."""
    late = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    rows = docs.withColumn("_llm_id", F.coalesce(F.col("doc_id").cast("long"), late))
    found = near_duplicates(rows.select(F.col("_llm_id").alias("doc_id"), "text"), n, radius)
    first = cut(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_llm_id"))
                .agg(F.count(F.lit(1)).alias("_llm_n")))
    kept = rows.join(first.select("_llm_id"), "_llm_id", "left_semi")
    if not first.where("_llm_n > 1").isEmpty():
        kept = kept.withColumn("_llm_text", F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(
            ["_llm_id", "_llm_text"]).drop("_llm_text")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
