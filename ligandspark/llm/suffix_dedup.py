"""Removal of long repeated byte strings with suffix arrays of shards.

A string of ``LENGTH`` bytes is judged by suffix arrays built by induced
sorting, one for each shard, and their permuted common prefixes.  What comes to
a shard is chosen so that equal strings meet:

* Every ``LENGTH``-byte window of a text picks the smallest hash of its
  ``GRAM``-byte grams.  Equal windows pick the same hash, so the windows of one
  hash are one group, and a group that one place only picks repeats nothing.
* Consecutive windows with the same hash are one context (a few hundred bytes).
  Equal contexts are counted before anything is moved: all windows of a context
  that occurs twice are repeated, and one copy stands for all.
* The contexts of a group are cut by the place of the window: windows that start
  within ``width`` bytes of each other hold a common core, nearly as long as a
  window, whose hash is the new group; equal parts are counted again.  What is
  left are the parts where texts that agree on a core go apart.  In the suffix
  array equal cores are one symbol, so it runs over the bytes around them.
* These groups are dealt to shards of about ``SHARD_BYTES``.  A group larger
  than ``HOT_BYTES`` (a passage in a large share of all texts) is cut again with
  a smaller width.  At width 1 a group is one string and its count decides.

Only contexts, hashes and byte ranges are shuffled, and of the texts only those
that may hold a repeated string.

Passages of a number of words are found in the same way, in the texts with a
64-bit hash in the place of each word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandspark.llm.common import lookup, parallelism, passing, trimmed, written
from ligandspark.llm.suffixes import repeated_starts_around

LENGTH = 400              # bytes of a repeated string
PASSAGE = 50              # words of a repeated passage
CODE = 8                  # bytes of a word's hash
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
GRAM = 64                 # bytes of a hashed gram
MOST_WINDOWS = 512        # windows of one context
SHARD_BYTES = 2 << 20     # contexts in one suffix array, about
HOT_BYTES = 256 << 10     # a group above it is cut again
WIDTHS = (32, 4, 1)       # places that share a core, level by level
MARK_BITS = 24            # log2 of the bits that mark texts (2 MB whatever the corpus)
OUT_BYTES = 8 << 20
OUT_ROWS = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every ``gram``-byte string (a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        m, factor = 1, _ODD
        while m < gram:
            h = h[:-m] * factor + h[m:]
            factor, m = factor * factor, 2 * m
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        h = np.minimum(h[:-m], h[m:])
        m *= 2
    rest = width - m
    return np.minimum(h[:len(h) - rest], h[rest:]) if rest else h


def _picks(h: np.ndarray, low: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each context the number of grams that have its hash: more than one
    means that it may repeat a string within itself."""
    block = 64
    tops = np.zeros(-(-len(h) // block), np.uint64)          # largest minimum of each block of windows
    at = np.arange(0, len(low), block)
    tops[:len(at)] = np.maximum.reduceat(low, at)
    cover = tops.copy()                                      # of all windows that hold a gram of the block
    for k in range(1, min(len(tops) - 1, -(-(width - 1) // block)) + 1):
        cover[k:] = np.maximum(cover[k:], tops[:-k])
    some = np.flatnonzero(h <= np.repeat(cover, block)[:len(h)])
    c = np.searchsorted(first, np.maximum(some - width + 1, 0), side="right") - 1
    end = np.searchsorted(first, np.minimum(some, len(low) - 1), side="right") - 1
    out = np.zeros(len(first), np.int64)
    while len(some):
        np.add.at(out, c[low[first[c]] == h[some]], 1)
        more = c < end
        some, c, end = some[more], c[more] + 1, end[more]
    return out


def contexts(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window start, and picks (2: two or more) of each context of ``text``."""
    if len(text) < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    width = length - gram + 1
    low = window_minima(h, width)
    first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    size = np.diff(np.append(first, len(low)))
    parts = -(-size // MOST_WINDOWS)
    if parts.max() > 1:                              # a periodic text
        base = np.repeat(first, parts)
        step = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = base + step * MOST_WINDOWS
    last = np.append(first[1:], len(low)) - 1
    return low[first], first, last, np.minimum(_picks(h, low, first, width), 2)


def _key(data: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(data)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def word_codes(text: str) -> bytes:
    """The 64-bit hashes of the words of ``text``, one after another."""
    from xxhash import xxh64_digest

    return b"".join([xxh64_digest(w) for w in WORD.findall(utf8(text))])


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(),
                    strict=True))


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
ITEM = "key binary, grp long, n long, windows int, content binary"


def _range_dicts(ranges: list[tuple[int, int]]) -> list[dict]:
    return [{"a": a, "b": b} for a, b in ranges]


def find_contexts(texts: DataFrame, length: int, gram: int, coded: Callable[[str], bytes] = utf8) -> DataFrame:
    """``tkey, text`` -> a row per context: ``tkey, grp, first, last, picks, key``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for tkey, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = coded(text.as_py() or "")
                h, first, last, picks = contexts(data, length, gram)
                if len(h):
                    out[0].extend([tkey] * len(h))
                    out[1].append(h.view(np.int64))
                    out[2].append(first)
                    out[3].append(last)
                    out[4].append(picks)
                    out[5].extend([_key(data[a:z + length]) for a, z in zip(first.tolist(), last.tolist(),
                                                                            strict=True)])
            ints = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out[1:5]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(ints[0]), pa.array(ints[1].astype(np.int32)),
                 pa.array(ints[2].astype(np.int32)), pa.array(ints[3].astype(np.int32)),
                 pa.array(out[5], pa.binary())],
                ["tkey", "grp", "first", "last", "picks", "key"])

    return texts.mapInArrow(trimmed(run), "tkey binary, grp long, first int, last int, picks int, key binary")


def _marker(marked: DataFrame, key: str):
    """Function from a column to whether its value may be among ``marked(key)``:
    a bitmap of ``2 ** MARK_BITS`` bits, so a few more may pass, none less."""
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(1 << MARK_BITS)) + 1

    bits = (marked.select(place(F.col(key)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect())
    whole = np.zeros((1 << MARK_BITS) // 8, np.uint8)
    for r in bits:                                   # at most 512 rows of 4 kB
        whole[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    held = marked.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def there(p):
        import pandas as pd

        i = p.to_numpy(np.int64) - 1
        return pd.Series((held.value[i >> 3] >> (i & 7).astype(np.uint8) & 1) == 1)

    return lambda c: there(place(c))


def _sharded(items: DataFrame, length: int, width: int) -> DataFrame:
    """Items (parts cut with ``width``) of groups small enough for one suffix array -> ``key, ranges``."""
    total = items.agg(F.sum(F.length("content"))).first()[0] or 0
    shards = max(parallelism(items.sparkSession), -(-total // SHARD_BYTES))
    dealt = items.select("key", "content", "core", F.pmod(F.xxhash64("grp"), F.lit(shards)).cast("int").alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, texts, cores = None, [], [], []

        def done() -> pa.RecordBatch:
            starts = repeated_starts_around(texts, cores, length - width + 1, length)
            found = [_range_dicts(_ranges(s)) for s in starts]
            out = [(k, r) for k, r in zip(keys, found, strict=True) if r]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.binary()), pa.array([r for _, r in out], RANGES)], ["key", "ranges"])

        for b in batches:
            for k, c, at, s in zip(*(column.to_pylist() for column in b.columns), strict=True):
                if s != shard:
                    if texts:
                        yield done()
                    shard, keys, texts, cores = s, [], [], []
                keys.append(k)
                texts.append(c)
                cores.append(at)
        if texts:
            yield done()

    return (dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key")
            .mapInArrow(trimmed(run), "key binary, ranges array<struct<a:int,b:int>>"))


def _narrower(items: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """Cut items by the place of the window: a row per item and core, with the
    part's own ``part_key`` and ``grp``, ``shift`` (of its first window), ``n``,
    ``windows`` and ``core`` (place of the core in it)."""
    width = WIDTHS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, grp, n, windows, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = gram_hashes(np.frombuffer(content, np.uint8), gram)
                # all windows have the same smallest hash; the place of its first gram in each window
                low = window_minima(h, length - gram + 1)[0]
                start, picks = np.arange(windows), np.flatnonzero(h == low)
                at = picks[np.searchsorted(picks, start)]
                cell = (at - start) // width
                cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(at) != 0)) + 1
                for lo, hi in zip(np.append(0, cut).tolist(), np.append(cut, windows).tolist(), strict=True):
                    # all windows of this cell hold the bytes from its last place to the end of its first
                    core_from = int(at[lo] - cell[lo] * width)
                    core = content[core_from:core_from - (width - 1) + length]
                    part = content[lo:hi - 1 + length]
                    place = f"{level}:{int(cell[lo])}:{grp}:".encode()
                    g = int.from_bytes(_key(place + core)[:8], "little", signed=True)
                    offset = f"{int(at[lo]) - lo}:".encode()
                    out.append((key, _key(place + offset + part), g, lo, n, hi - lo, core_from - lo))
                if len(out) > OUT_ROWS:
                    yield made(out)
                    out = []
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          ["key", "part_key", "grp", "shift", "n", "windows", "core"])

    return items.select("key", "grp", "n", "windows", "content").mapInArrow(
        trimmed(run), "key binary, part_key binary, grp long, shift int, n long, windows int, core int")


def _whole(items: DataFrame) -> DataFrame:
    """All windows of the items that occur more than once."""
    return items.where("n > 1").select("key", F.array(
        F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"))).alias("ranges"))


def repeated_windows(items: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int | None = None,
                     level: int = 0) -> DataFrame:
    """``key, ranges`` of the items that share a window with another item, or
    hold one twice.

    ``items`` has one row per distinct content: ``key, grp, n`` (times it
    occurs), ``windows, content``; equal windows lie in items of one grp, and
    groups of one item without a loop are left out.  ``ranges`` are window
    starts within the item, both ends included; whole items that occur more
    than once are not listed again."""
    limit = HOT_BYTES if hot_bytes is None else hot_bytes
    large, out = items, None
    if level:
        size = F.sum(F.length("content").cast("long")).alias("bytes")
        hot = items.groupBy("grp").agg(size).where(F.col("bytes") > limit).select("grp", F.lit(True).alias("_hot"))
        marked = written(items.join(hot, "grp", "left"), "marked")
        out = _sharded(marked.where("_hot is null"), length, WIDTHS[level - 1])
        large = marked.where("_hot").drop("_hot")
        if large.isEmpty():
            return out
    parts = written(_narrower(large, level, length, gram), "parts")
    single = written(parts.groupBy(F.col("part_key")).agg(
        F.first("grp").alias("grp"), F.sum("n").alias("n"), F.first("windows").alias("windows"),
        F.first("core").alias("core"), F.min(F.struct("key", "shift")).alias("at")).withColumnRenamed("part_key", "key"), "part-keys")
    several = single.groupBy("grp").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("grp")
    apart = single.join(several, "grp", "left_semi")
    source = large.select(F.col("key").alias("item"), "content")
    apart = apart.join(source, F.col("at.key") == F.col("item")).select(
        "key", "grp", "n", "windows", "core",
        F.substring("content", F.col("at.shift") + 1, F.col("windows") - 1 + length).alias("content"))
    found = _whole(single)
    if WIDTHS[level] > 1:
        found = found.unionByName(repeated_windows(written(apart, "apart"), length, gram, hot_bytes, level + 1))
    found = written(found, "part-ranges").withColumnRenamed("key", "part_key")
    back = lookup(parts.select("key", "part_key", "shift"), "part_key", found.groupBy("part_key").agg(
        F.flatten(F.collect_set("ranges")).alias("ranges")))
    back = back.select("key", F.transform("ranges", lambda r: F.struct(
        (r.a + F.col("shift")).alias("a"), (r.b + F.col("shift")).alias("b"))).alias("ranges"))
    return back if out is None else out.unionByName(back)


def repeated_starts_by_text(texts: DataFrame, length: int = LENGTH, gram: int = GRAM,
                            hot_bytes: int | None = None, coded: Callable[[str], bytes] = utf8) -> DataFrame:
    """For ``texts(tkey, text)``, where equal texts have equal keys: ``tkey,
    windows`` with the repeated window starts (ranges, unordered) of each key
    that has any.  ``coded`` gives the bytes of a text that are judged."""
    with passing(texts.sparkSession):
        return _starts_by_text(texts, length, gram, hot_bytes, coded)


def _starts_by_text(texts: DataFrame, length: int, gram: int, hot_bytes: int | None,
                    coded: Callable[[str], bytes]) -> DataFrame:
    found = written(find_contexts(texts, length, gram, coded), "contexts")
    shared = written(found.groupBy("grp").agg(F.sum("picks").alias("picks")).where("picks > 1")
                     .select("grp"), "groups")
    near = written(found.where(_marker(shared, "grp")(F.col("grp"))), "near")
    met = written(lookup(near, "grp", shared), "met")
    keys = written(met.groupBy("key").agg(
        F.first("grp").alias("grp"), F.count(F.lit(1)).alias("n"), F.first("picks").alias("picks"),
        F.min(F.struct("tkey", "first", "last")).alias("at")), "context-keys")
    several = keys.groupBy("grp").agg(F.sum("picks").alias("picks")).where("picks > 1").select("grp")
    chosen = written(keys.join(several, "grp", "left_semi"), "chosen")   # else one context: its count decides
    wanted = chosen.groupBy("at.tkey").agg(F.collect_list(
        F.struct("key", "grp", "n", "at.first", "at.last")).alias("at"))
    holders = texts.where(_marker(chosen.select("at.tkey"), "tkey")(F.col("tkey")))
    one = holders.groupBy("tkey").agg(F.first("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for text, at in zip(b.column(0), b.column(1), strict=True):
                data = coded(text.as_py())
                for x in at.as_py():
                    part = data[x["first"]:x["last"] + length]
                    rows.append((x["key"], x["grp"], x["n"], x["last"] - x["first"] + 1, part))
                    size += len(part)
                if size > OUT_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          ["key", "grp", "n", "windows", "content"])

    items = written(one.join(wanted, "tkey").select("text", "at").mapInArrow(trimmed(extract), ITEM), "items")
    flagged = written(repeated_windows(items, length, gram, hot_bytes).unionByName(_whole(
        keys.withColumn("windows", F.col("at.last") - F.col("at.first") + 1))), "flagged")
    flagged = flagged.groupBy("key").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))
    flagged = written(flagged, "ranges")
    places = written(met.select("tkey", "first", "key").distinct(), "places")
    hit = lookup(places, "key", flagged).select("tkey", F.transform("ranges", lambda r: F.struct(
        (r.a + F.col("first")).alias("a"), (r.b + F.col("first")).alias("b"))).alias("ranges"))
    return written(hit.groupBy("tkey").agg(F.flatten(F.collect_list("ranges")).alias("windows")), "windows", keep=True)


def repeated_passages_by_text(texts: DataFrame, words: int, gram: int = GRAM, hot_bytes: int | None = None) -> DataFrame:
    """As :func:`repeated_starts_by_text`: ``tkey, passages``, the starts (word
    numbers) of ``words`` consecutive words that also stand elsewhere."""
    found = repeated_starts_by_text(texts, CODE * words, gram if gram <= CODE * words else CODE, hot_bytes, word_codes)
    # only windows that begin with a word
    whole = F.transform("windows", lambda r: F.struct(
        F.ceil(r.a / CODE).cast("int").alias("a"), F.floor(r.b / CODE).cast("int").alias("b")))
    return found.select("tkey", F.filter(whole, lambda r: r.a <= r.b).alias("passages")).where("size(passages) > 0")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int | None = None,
          words: int | None = None) -> DataFrame:
    """All columns of ``docs(text, ...)`` with ``kept`` (binary: the remaining
    bytes), ``n_bytes``, ``n_removed`` and ``spans`` (removed byte ranges,
    ``start`` and ``end`` exclusive, maximal, in order).

    A byte goes if a ``length``-byte string that covers it starts anywhere else
    in the texts, the same text included; strings are judged on the input.
    With ``words``, a passage of that many words (``[^\\x20\\x09-\\x0D]+``, any
    blanks between them) that also stands elsewhere goes as well, however few
    bytes it has, with the blanks between its words.  Texts shorter than ``length``, null and empty ones lose nothing (null: no
    bytes).  Equal rows lose the same.  Columns of the result names are
    replaced; other columns stay; no rows give no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.drop("kept", "n_bytes", "n_removed", "spans")
    rows = rows.withColumn("_llm_text", text).withColumn("_llm_key", F.unhex(F.md5("_llm_text")))
    texts = rows.select(F.col("_llm_key").alias("tkey"), F.col("_llm_text").alias("text"))
    windows = repeated_starts_by_text(texts, length, gram, hot_bytes)
    if words:
        passages = repeated_passages_by_text(texts, words, gram, hot_bytes)
        none = F.lit(None).cast("array<struct<a:int,b:int>>")
        windows = written(
            windows.withColumn("passages", none).unionByName(passages.withColumn("windows", none)).groupBy("tkey").agg(
                F.first("windows", ignorenulls=True).alias("windows"),
                F.first("passages", ignorenulls=True).alias("passages")), "cuts")
    else:
        windows = windows.withColumn("passages", F.lit(None).cast("array<struct<a:int,b:int>>"))
    windows = windows.withColumnRenamed("tkey", "_llm_key")

    @F.pandas_udf("kept binary, spans array<struct<start:long,end:long>>")
    def remove(texts, found, passages):
        import pandas as pd

        kept, spans = [], []
        for t, w, p in zip(texts, found, passages, strict=True):
            data, merged = utf8(t), []
            ranges = [(x["a"], x["b"] + length) for x in (w if w is not None else ())]
            if p is not None:
                at = [m.span() for m in WORD.finditer(data)]
                ranges += [(at[x["a"]][0], at[x["b"] + words - 1][1]) for x in p]
            for a, b in sorted(ranges):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            at, parts = 0, []
            for a, b in merged:
                parts.append(data[at:a])
                at = b
            kept.append(b"".join([*parts, data[at:]]))
            spans.append([{"start": a, "end": b} for a, b in merged])
        return pd.DataFrame({"kept": kept, "spans": spans})

    there = _marker(windows, "_llm_key")(F.col("_llm_key"))
    flagged = rows.withColumn("_llm_there", there)
    maybe = written(flagged.where("_llm_there").drop("_llm_there"), "candidates")
    cut = (lookup(maybe, "_llm_key", windows, "left").withColumn("_llm_cut", remove("_llm_text", "windows", "passages"))
           .withColumns({"kept": F.col("_llm_cut.kept"), "spans": F.col("_llm_cut.spans")})
           .drop("_llm_cut", "windows", "passages"))
    untouched = flagged.where("not _llm_there").drop("_llm_there").withColumns({
        "kept": F.col("_llm_text").cast("binary"),
        "spans": F.array().cast("array<struct<start:bigint,end:bigint>>")})
    done = cut.unionByName(untouched)
    n = F.octet_length("_llm_text").cast("long")
    return done.withColumns({"n_bytes": n, "n_removed": n - F.length("kept")}).drop("_llm_text", "_llm_key")


def cut_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated byte strings, and with ``words`` the repeated
    passages of that many words, cut out of ``text`` and ``n_chars``, if there,
    set anew; every row stays.

    Where a cut goes through a character of several bytes, the bytes left of
    it are dropped.  A null text stays null."""
    @F.pandas_udf("string")
    def decoded(kept):
        return kept.map(lambda b: b.decode("utf-8", "ignore"))

    done = dedup(docs, length, words=words)
    text = F.when(F.col("text").isNull(), F.lit(None)).when(F.col("n_removed") == 0, F.col("text")).otherwise(
        decoded("kept"))
    done = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        done = done.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars"))
                               .otherwise(F.length("text").cast(kind)))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
