"""Exact dedup against a history of digests held in minimal perfect hashes.

The distinct digests of historical rows are dealt into shards; each shard gets a
minimal perfect hash (levels of bits: a digest that is alone at its place of a
level takes it, the others go on to the next level; a slot is the number of set
bits before).  A slot holds the full digest and the locator of the row that
stays.  Looking up any digest gives a slot or none, and only if all 32 bytes of
the slot are equal the digest is a member: those rows are repeats of history.
Nonmembers are grouped among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandspark.llm.common import HOT_SHARE, ascii_lower, written

SLOTS = 65_536      # digests of a shard, about: a task holds one shard and one batch
GAMMA = 1.5         # bits of a level per digest that reaches it
LEVELS = 500        # more are needed by equal digests only
WIDTH = 32          # bytes of a digest

INDEX = ("shard long, levels array<binary>, digests binary, ids array<long>, locs array<long>, counts array<long>")
GROUP = "digest binary, member boolean, keep_id long, keep_loc long, n long"
_GROUP_ARROW = pa.schema([("digest", pa.binary()), ("member", pa.bool_()), ("keep_id", pa.int64()),
                          ("keep_loc", pa.int64()), ("n", pa.int64())])


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each row of four 64-bit words, another one for each level."""
    h = np.full(len(words), (level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for k in range(words.shape[1]):
        h ^= words[:, k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


@dataclass
class PerfectHash:
    """Levels of places; ``before[l][p]`` counts the taken places up to ``p`` of
    level ``l`` and of the levels above it."""
    taken: list[np.ndarray]

    def __post_init__(self) -> None:
        self.before, total = [], 0
        for bits in self.taken:
            self.before.append(total + np.cumsum(bits, dtype=np.int64))
            total += int(bits.sum())
        self.size = total

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        """For distinct digests, rows of ``WIDTH`` bytes."""
        words, levels = digests.view("<u8"), []
        while len(words):
            if len(levels) == LEVELS:
                raise ValueError("a perfect hash needs distinct digests")
            size = 8 * max(8, int(GAMMA * len(words) / 8))
            at = (_mixed(words, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            words = words[~alone[at]]
        return cls(levels)

    @classmethod
    def of_bytes(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8)) for b in levels])

    def to_bytes(self) -> list[bytes]:
        return [np.packbits(bits).tobytes() for bits in self.taken]

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest: its own for a member, any or -1 for others."""
        out, rest = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        words = digests.view("<u8")
        for level, bits in enumerate(self.taken):
            at = (_mixed(words[rest], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[rest[hit]] = self.before[level][at[hit]] - 1
            rest = rest[~hit]
        return out


def _digests(column: pa.Array) -> np.ndarray:
    """Rows of ``WIDTH`` bytes of a binary column without nulls."""
    if not len(column):
        return np.zeros((0, WIDTH), np.uint8)
    first = column.offset + 1
    start = np.frombuffer(column.buffers()[1], np.int32)[first - 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return np.ascontiguousarray(data[start:start + WIDTH * len(column)].reshape(-1, WIDTH))


def _binary(digests: np.ndarray) -> pa.Array:
    offsets = np.arange(0, WIDTH * (len(digests) + 1), WIDTH, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(digests), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(digests))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which values are there, and the values with 0 for null."""
    there = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    return there, column.fill_null(0).to_numpy(zero_copy_only=False)


def digested(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, loc, digest``: SHA-256 of each whole text in lower-case A-Z (null:
    empty), and a number ``loc`` per row, so that repeated rows differ; written,
    as the numbers must not change when a task is run again."""
    t = ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("loc"),
        F.unhex(F.sha2(t, 256)).alias("digest")), "digests")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the locator of the row with the largest doc_id (then
    the largest ``loc``; a null id only if there is no other) and the number of
    rows.  Counted before it is shuffled, so a digest of a third of all rows is
    one row per task."""
    w = F.max(F.struct("doc_id", "loc"))
    g = rows.groupBy("digest").agg(w.alias("_w"), F.count(F.lit(1)).alias("n"))
    return g.select("digest", F.col("_w.doc_id").alias("keep_id"), F.col("_w.loc").alias("keep_loc"), "n")


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """Index table of ``groups(digest, keep_id, keep_loc, n)``, one row per shard:
    the hash's levels, and per slot the digest, locator and count."""

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        digests = _digests(t["digest"].chunk(0))
        ph = PerfectHash.of(digests)
        order = np.argsort(ph.slots(digests))
        column = lambda c: pa.array([t[c].take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))
        return pa.table({
            "shard": t["shard"].slice(0, 1), "levels": pa.array([ph.to_bytes()], pa.list_(pa.binary())),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "ids": column("keep_id"), "locs": column("keep_loc"), "counts": column("n")})

    rows = groups.select(_shard(shards), "digest", "keep_id", "keep_loc", "n")
    return rows.groupBy("shard").applyInArrow(build, INDEX)


class _Shard:
    """One shard's index while the new rows of that shard stream past."""

    def __init__(self, b: pa.RecordBatch | None = None, i: int = 0) -> None:
        at = lambda c: b.column(b.schema.get_field_index(c))[i]
        if b is None:
            self.hash, self.digests = PerfectHash([]), np.zeros((0, WIDTH), np.uint8)
            self.valid, self.ids = np.zeros(0, bool), np.zeros(0, np.int64)
            self.locs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            self.hash = PerfectHash.of_bytes(at("levels").as_py())
            self.digests = np.frombuffer(at("digests").as_py(), np.uint8).reshape(-1, WIDTH)
            self.valid, ids = _numbers(at("ids").values)
            self.ids, self.locs = ids.copy(), at("locs").values.to_numpy().copy()
            self.counts = at("counts").values.to_numpy().copy()
            self.valid = self.valid.copy()

    def look_up(self, digests: np.ndarray, valid: np.ndarray, ids: np.ndarray, locs: np.ndarray,
                counts: np.ndarray) -> np.ndarray:
        """Fold groups (distinct digests) into their slots; tells who is no member."""
        slot = self.hash.slots(digests)
        member = slot >= 0
        member[member] = (self.digests[slot[member]] == digests[member]).all(axis=1)
        s, v, i, o = slot[member], valid[member], ids[member], locs[member]
        self.counts[s] += counts[member]
        ov, oi, oo = self.valid[s], self.ids[s], self.locs[s]
        wins = (v & ~ov) | ((v == ov) & ((i > oi) | ((i == oi) & (o > oo))))
        self.valid[s[wins]], self.ids[s[wins]], self.locs[s[wins]] = v[wins], i[wins], o[wins]
        return ~member

    def groups(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [_binary(self.digests), pa.array(np.ones(len(self.ids), bool)),
             pa.array(self.ids, mask=~self.valid), pa.array(self.locs), pa.array(self.counts)], schema=_GROUP_ARROW)


def look_up(index: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """``digest, member, keep_id, keep_loc, n``: every slot of the index, with the
    equal groups of ``new(digest, keep_id, keep_loc, n)`` folded in, and the
    groups of ``new`` that are no members as they are.

    Rows are dealt by shard and sorted so that a shard's index comes before its
    new rows; a task holds one shard and one batch of new rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = _Shard(), None
        for b in batches:
            shard = b.column(0).to_numpy()
            is_new = b.column(1).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(shard):
                if not is_new[at]:
                    if len(held.ids):
                        yield held.groups()
                    held, number, at = _Shard(b, at), shard[at], at + 1
                    continue
                stop = at + int(np.argmax(np.append((shard[at:] != shard[at]) | ~is_new[at:], True)))
                if shard[at] != number:                     # no digest of history is in this shard
                    if len(held.ids):
                        yield held.groups()
                    held, number = _Shard(), shard[at]
                part = b.slice(at, stop - at)
                get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                digests, (valid, ids) = _digests(get("digest")), _numbers(get("keep_id"))
                out = held.look_up(digests, valid, ids, get("keep_loc").to_numpy(), get("n").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [_binary(digests[out]), pa.array(np.zeros(int(out.sum()), bool)),
                     *[get(c).filter(pa.array(out)) for c in ("keep_id", "keep_loc", "n")]], schema=_GROUP_ARROW)
                at = stop
        if len(held.ids):
            yield held.groups()

    entries = index.select("shard", F.lit(False).alias("is_new"), *[c for c in index.columns if c != "shard"])
    rows = new.select(_shard(shards), F.lit(True).alias("is_new"), "digest", "keep_id", "keep_loc", "n")
    both = entries.unionByName(rows, allowMissingColumns=True)
    return both.repartition("shard").sortWithinPartitions("shard", "is_new").mapInArrow(run, GROUP)


def shards_for(*tables: DataFrame) -> int:
    return max(1, -(-max(t.count() for t in tables) // SLOTS))


def resolve(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Groups (:data:`GROUP`) of ``rows`` and ``history`` together (``doc_id, loc,
    digest`` each): the perfect hash of the history's digests answers which
    digests of ``rows`` are members; the others are grouped separately."""
    old, new = written(grouped(history), "history"), written(grouped(rows), "new")
    shards = shards_for(old, new)
    index = written(build_index(old, shards), "index")
    return written(look_up(index, new, shards), "groups")


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, in_history`` for every
    row of ``docs(doc_id, text, ...)`` (``in_history``: the text is a member of the index).

    Texts are equal when identical after lower-casing A-Z; a null text is an
    empty one, and equals it.  Of equal texts the row with the largest doc_id
    stays; among repeated rows of that id one stays; a group without any id
    keeps one of its rows, with a null keep_id.  The rows up to the middle of
    the ids are the history, the others (null ids too) are looked up in it.
    Other columns are ignored; no rows give no rows."""
    return _marked(digested(docs, text)).drop("loc")


def _marked(rows: DataFrame) -> DataFrame:
    ends = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).first()
    middle = ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    is_old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    groups = resolve(rows.where(~is_old), rows.where(is_old))
    # a digest with over 1 / HOT_SHARE of the rows: fewer than HOT_SHARE of them
    hot = F.broadcast(groups.where(F.col("n") > max(1, ends["n"] // HOT_SHARE)))
    cold = groups.where(F.col("n") <= max(1, ends["n"] // HOT_SHARE))
    joined = rows.join(hot, "digest").unionByName(
        rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    return joined.select(
        "doc_id", "loc", "keep_id", F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("loc") == F.col("keep_loc"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history"))


def drop_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay (see :func:`exact_dedup`), with all their columns."""
    own = written(docs.select(*[F.col(f"`{c}`").alias(f"_llm_{i}") for i, c in enumerate(docs.columns)],
                              F.monotonically_increasing_id().alias("_llm_row")), "rows")
    place = {c: f"_llm_{i}" for i, c in enumerate(docs.columns)}
    t = ascii_lower(F.coalesce(F.col(place[text]).cast("string"), F.lit("")))
    rows = written(own.select(F.col(place["doc_id"]).cast("long").alias("doc_id"), F.col("_llm_row").alias("loc"),
                              F.unhex(F.sha2(t, 256)).alias("digest")), "digests")
    stay = _marked(rows).where("kept").select(F.col("loc").alias("_llm_row"))
    return own.join(stay, "_llm_row").select(*[F.col(place[c]).alias(c) for c in docs.columns])
