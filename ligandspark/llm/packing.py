"""Best-fit-decreasing packing of tokenized documents into fixed-length sequences.

Documents of one length are interchangeable, so the packing depends only on how
many pieces there are of each length: at most ``capacity`` counts, whatever the
corpus.  Best-fit decreasing runs over these counts on the driver: a segment
tree over the remaining capacities finds the tightest open bin in logarithmic
time, and a run of equal pieces fills a run of equal bins in one step, exactly
as placing them one by one would.  The result is a bounded list of fills; Spark
numbers the pieces of each length and every piece looks up its own fill.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligandspark.llm.common import trimmed, written

CAPACITY = 4096       # tokens of a sequence
END_ID = 1            # closes every document
CACHE_WORDS = 500_000    # tokenized words kept by a worker
CACHE_CHARS = 64         # longest word kept
LATIN_END = "\u0180"      # letters below it are composed and keep their ids lower-cased
MARKS = ".,;:!?)\"#$%&*+=~"    # may close a word of letters
SLICE = 1 << 20          # characters of a long text that are split into words at once
OUT_ROWS = 2_000


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while
    some open bin has that much room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1 - 1).bit_length() if capacity else 1
        while self.size < capacity + 1:
            self.size *= 2
        self.node = bytearray(2 * self.size)

    def set(self, room: int, there: bool) -> None:
        i = room + self.size
        self.node[i] = there
        while i > 1:
            i >>= 1
            now = self.node[2 * i] | self.node[2 * i + 1]
            if self.node[i] == now:
                break
            self.node[i] = now

    def tightest(self, least: int) -> int | None:
        """Smallest room of an open bin that is ``least`` or more."""
        i = least + self.size
        if self.node[i]:
            return least
        while i > 1:
            if not i & 1 and self.node[i + 1]:       # a left child: the right sibling holds larger rooms
                i += 1
                while i < self.size:
                    i = 2 * i if self.node[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass(frozen=True)
class Fill:
    """Pieces ``first .. first + count - 1`` of ``length`` go, ``per_bin`` to a
    bin, into bins ``bin, bin + 1, ...`` from ``offset`` on."""
    length: int
    first: int
    count: int
    bin: int
    per_bin: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Fill], int]:
    """Fills and number of bins for ``counts`` pieces of each length.

    A length starts at most one new run of bins and splits at most one, and a
    run's room at least halves with each fill, so there are no more than
    3 * capacity * log2(capacity) fills."""
    tree, open_runs = CapacityTree(capacity), defaultdict(list)
    fills: list[Fill] = []
    bins = 0

    def release(room: int, start: int, n: int) -> None:
        if n and room:
            open_runs[room].append((start, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"piece length {length} is not within 1..{capacity}")
        left, first = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                n = -(-left // (capacity // length))
                start, bins = bins, bins + n
            else:
                start, n = open_runs[room].pop()
                if not open_runs[room]:
                    tree.set(room, False)
            per = room // length
            whole = min(n, left // per)
            if whole:
                fills.append(Fill(length, first, whole * per, start, per, capacity - room))
                release(room - per * length, start, whole)
                first, left = first + whole * per, left - whole * per
            if left and whole < n:                     # one bin takes the last few pieces
                fills.append(Fill(length, first, left, start + whole, per, capacity - room))
                release(room - left * length, start + whole, 1)
                first, left, whole = first + left, 0, whole + 1
            release(room, start + whole, n - whole)
    return fills, bins


def slices(text: str) -> Iterator[str]:
    """``text`` cut at blanks, which are dropped, into parts of about ``SLICE`` characters."""
    at = 0
    while len(text) - at > SLICE:
        end = text.rfind(" ", at, at + SLICE)
        if end < 0:
            end = text.find(" ", at + SLICE)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def byte_signs() -> dict[int, str]:
    """The sign that byte-level merges use for each byte: printable ones stand
    for themselves, the others for the signs from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _encoder(model: bytes):
    """Function from texts to their ids as little-endian uint32 bytes.

    A text is cut at blanks and line feeds: the tokenizer drops white space and
    no pattern, normalization or added token of it reaches across, so the ids
    of a text are those of its words, which are kept.  A word of Latin letters
    and closing marks is two texts to it as well, and the first needs nothing
    but lower case and the model's merges, so it goes to these at once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model.decode())
    merges, signs = tokenizer.model.tokenize, byte_signs()
    known: dict[str, bytes] = {"": b""}        # words of texts
    stems: dict[str, bytes] = {"": b""}        # of letters, lower-cased
    rest: dict[str, bytes] = {"": b""}         # closing marks, and words of another kind

    def merged(stem: str) -> bytes:
        mapped = stem if stem.isascii() else stem.encode().decode("latin-1").translate(signs)
        return array("I", [t.id for t in merges(mapped)]).tobytes()

    def encode(text: str) -> bytes:
        return b"".join(encode_slice(s) for s in slices(text)) if len(text) > SLICE else encode_slice(text)

    def encode_slice(text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        if len(known) > CACHE_WORDS:
            known.clear()
            known[""] = b""
        if len(stems) + len(rest) > CACHE_WORDS:
            stems.clear()
            rest.clear()
            stems[""] = rest[""] = b""
        own: dict[str, bytes] = {}             # words too long to keep
        waiting: list[tuple[str, bytes, str]] = []
        for w in set(words).difference(known):
            stem = w.rstrip(MARKS)
            low = stem.lower()
            if stem.isalpha() and (stem.isascii() or max(stem) < LATIN_END and len(low) == len(stem)):
                end = w[len(stem):] if stem is not w else ""
            else:
                low, end = "", w
            ids = stems.get(low)
            if ids is None:
                ids = merged(low)
                if len(low) <= CACHE_CHARS:
                    stems[low] = ids
            more = rest.get(end)
            if more is None:
                waiting.append((w, ids, end))
            else:
                (known if len(w) <= CACHE_CHARS else own)[w] = ids + more
        if waiting:
            new = list({end for _, _, end in waiting})
            ends = {end: array("I", e.ids).tobytes() for end, e in
                    zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
            rest.update((end, ids) for end, ids in ends.items() if len(end) <= CACHE_CHARS)
            for w, ids, end in waiting:
                (known if len(w) <= CACHE_CHARS else own)[w] = ids + ends[end]
        if not own:
            return b"".join([known[w] for w in words])
        return b"".join([known[w] if w in known else own[w] for w in words])

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize and cut: one row per piece of at most ``capacity`` ids, with the
    number ``nth`` of the piece among those of its length in its partition."""
    with open(tokenizer_path, "rb") as f:
        model = f.read()
    held = docs.sparkSession.sparkContext.broadcast(model)      # a vocabulary file, a few MB
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(held.value)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            rows.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        size = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at:at + 4 * capacity]
                    n = len(one) // 4
                    rows.append((doc_id, i, at // 4, n, one, zlib.crc32(one), part, seen[n]))
                    seen[n] += 1
                    size += len(one)
                if len(rows) >= OUT_ROWS or size > 8 << 20:
                    yield flush()
                    size = 0
        yield flush()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, "
                               "part int, nth long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all of ``docs(doc_id, text, ...)``: one row per piece with ``doc_id,
    piece, start, length, ids`` (little-endian uint32 bytes), ``ids_crc32,
    sequence_id, offset``.

    A null or empty text is the end id alone.  Only documents of more than
    ``capacity`` ids are cut; the last piece may be shorter.  Null and repeated
    doc_ids are packed row by row.  Equal lengths take bins in the order of
    their partitions, which changes sequence ids, not their number.  Sequence
    ids run from 0 without gaps.  Other columns are ignored; no rows, no pieces."""
    cut = written(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    fills, _ = best_fit_decreasing(counts, capacity)
    fills.sort(key=lambda f: (f.length, f.first))
    length, first, start_bin, per, offset = (
        np.array([getattr(f, k) for f in fills], np.int64) for k in ("length", "first", "bin", "per_bin", "offset"))
    key = (length << 48) | first                                # first < 2**48 pieces of a length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, numbers):
        import pandas as pd

        lengths, numbers = lengths.to_numpy(np.int64), numbers.to_numpy(np.int64)
        f = np.searchsorted(key, (lengths << 48) | numbers, side="right") - 1
        local = numbers - first[f]
        return pd.DataFrame({"sequence_id": start_bin[f] + local // per[f],
                             "offset": offset[f] + local % per[f] * lengths})

    return (cut.join(ahead, ["length", "part"])
            .withColumn("_at", place("length", F.col("nth") + F.col("ahead")))
            .select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "_at.sequence_id", "_at.offset"))
