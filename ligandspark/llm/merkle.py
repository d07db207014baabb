"""Merkle-tree fingerprints of documents, in DataFrame functions only.

The leaves are the sentences of a paragraph (a paragraph is a line), and pieces
of about eight words of them if asked for: a piece ends after a word whose hash
says so, whatever the language's sentence marks are.  A
paragraph's hash is made from its leaves, a section's from its paragraphs, the
root from the sections.  Sections end where a paragraph's hash says so, so an
edit moves no border further on.  The fingerprint holds the root, and short
hashes of the sections and leaves: equal roots mean equal texts, and the leaves
in which two fingerprints differ show where a text was edited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligandspark.llm.common import parallelism

SHORT = 8              # hex digits kept of a leaf's or section's hash
SECTION_ENDS = "[01]"  # last hex digit of a section's last paragraph: 1 in 8
RANGES_PER_TASK = 4
WORDS = 8              # words that a piece of a sentence holds, by its words' hashes
MARK = "\x01\x03"
# up to 64 letters and what follows them, other characters of the first blocks, or one
# character from U+0E00 on (scripts without spaces)
WORD = r"[A-Za-z\u00AA-\u0DFF]{1,64}[^A-Za-z\u00AA-\x{10FFFF}\n]{0,8}|[^A-Za-z\u00AA-\x{10FFFF}\n]{1,8}|[\s\S]"


def mark_ends(text: Column) -> Column:
    """``text`` with ``MARK`` after the words that end a piece; \\x01 is escaped,
    so that equal results mean equal texts."""
    words = F.regexp_extract_all(F.replace(text, F.lit("\x01"), F.lit("\x01\x02")), F.lit(WORD), F.lit(0))
    ends = lambda w: (F.pmod(F.xxhash64(w), F.lit(WORDS)) == 0) & ~w.rlike(r"(\n|[.!?] |\x01)$")
    return F.regexp_replace(F.array_join(F.transform(
        words, lambda w: F.when(ends(w), F.concat(w, F.lit(MARK))).otherwise(w)), ""), MARK + r"(?=\n|\z)", "")


def add_fingerprint(df: DataFrame, text: str, out: str, pieces: bool = False) -> DataFrame:
    """Add the fingerprint ``root:sections:leaves`` of column ``text`` (null:
    empty).  The leaves are sentences, or with ``pieces`` parts of them of about
    ``WORDS`` words (characters, in scripts without spaces)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ends = r"(?<=\n)|(?<=[.!?] )"
    df = df.withColumn("_llm_m", F.split(mark_ends(t), f"{ends}|{MARK}") if pieces else F.split(t, ends))
    df = df.withColumn("_llm_m", F.array_join(F.transform("_llm_m", lambda s: F.concat(
        F.sha2(s, 256), F.when(s.endswith("\n"), ";").otherwise(","))), ""))
    paragraphs = F.transform(F.split("_llm_m", ";"), lambda p: F.sha2(p, 256))
    df = df.withColumn("_llm_s", F.regexp_replace(F.array_join(paragraphs, " "), f"({SECTION_ENDS}) ", "$1|"))
    df = df.withColumn("_llm_s", F.array_join(F.transform(F.split("_llm_s", r"\|"), lambda s: F.sha2(s, 256)), ""))
    rest = 64 - SHORT
    return df.withColumn(out, F.concat_ws(
        ":", F.sha2("_llm_s", 256), F.regexp_replace("_llm_s", f"([0-9a-f]{{{SHORT}}})[0-9a-f]{{{rest}}}", "$1"),
        F.regexp_replace("_llm_m", f"([0-9a-f]{{{SHORT}}})[0-9a-f]{{{rest}}}[,;]", "$1"))).drop("_llm_m", "_llm_s")


def leaves(fingerprint: Column) -> Column:
    return F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit(f"[0-9a-f]{{{SHORT}}}"), F.lit(0))


def add_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the share of common leaves (Jaccard) of two fingerprints: 1 for equal
    roots, null where one is null."""
    df = df.withColumn("_llm_a", F.array_distinct(leaves(F.col(a)))).withColumn(
        "_llm_b", F.array_distinct(leaves(F.col(b))))
    df = df.withColumn("_llm_n", F.size(F.array_intersect("_llm_a", "_llm_b")))
    union = F.size("_llm_a") + F.size("_llm_b") - F.col("_llm_n")
    same = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return df.withColumn(out, F.when(same, 1.0).otherwise(F.col("_llm_n") / union)).drop("_llm_a", "_llm_b", "_llm_n")


def first_changed_leaf(a: Column, b: Column) -> Column:
    """Number of the first leaf (from 0) in which two fingerprints differ; null if none."""
    at = F.array_position(F.zip_with(leaves(a), leaves(b), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(at > 0, at - 1)


def with_next(df: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the next row by
    descending ``key`` (nulls last, ties by the row's text hash); after the
    last row comes the first.

    The key's values are cut into ranges, each ordered by itself; the first row
    of a range is sent to the range before it as well, so no range needs
    another and no task holds all rows.  Only the ranges' borders (a few for
    each task) pass through the driver."""
    spark = df.sparkSession
    n = RANGES_PER_TASK * parallelism(spark)
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"]
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    number = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col(key))))
    df = df.withColumn("_llm_range", number)
    heads = {r["_llm_range"]: r["k"] for r in df.groupBy("_llm_range").agg(F.max(key).alias("k")).collect()}
    order = sorted(heads, reverse=True)
    # head key -> the range before; one row per range
    before = spark.createDataFrame(
        [(heads[r], r, order[i - 1]) for i, r in enumerate(order)], "_llm_key long, _llm_own int, _llm_before int")
    df = df.join(F.broadcast(before), (F.col("_llm_range") == F.col("_llm_own"))
                 & F.col(key).eqNullSafe(F.col("_llm_key")), "left")
    places = F.array(F.struct(F.col("_llm_range").alias("r"), F.lit(False).alias("guest")))
    guest = F.array(F.struct(F.col("_llm_before").alias("r"), F.lit(True).alias("guest")))
    df = df.withColumn("_llm_at", F.explode(
        F.when(F.col("_llm_before").isNull(), places).otherwise(F.concat(places, guest))))
    w = Window.partitionBy("_llm_at.r").orderBy(
        F.col("_llm_at.guest"), F.col(key).desc_nulls_last(), F.xxhash64(*carried))
    df = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return df.where("not _llm_at.guest").drop(
        "_llm_range", "_llm_key", "_llm_own", "_llm_before", "_llm_at")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, edited_text, fingerprint, edited_fingerprint, next_fingerprint,
    near_edited, near_next`` for every row of ``docs(doc_id, text, ...)``.

    The edited text has its last third of code points (rounded down) replaced
    by the first as many of the next document by descending doc_id (all of it
    if it is shorter); after the last document comes the first.  A null text is
    an empty one and equals it; equal texts have equal fingerprints and a
    likeness of 1.  Rows with a null doc_id come last; rows of equal doc_id are
    ordered by their text's hash; a single row is its own next.  The leaves are
    pieces of sentences, so an edit changes only leaves nearby.  Other columns
    are ignored; no rows give no rows."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(add_fingerprint(src, "text", "fingerprint", pieces=True), "doc_id", ["text", "fingerprint"])
    third = F.floor(F.length("text") / 3).cast("int")
    keep = (F.length("text") - third).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.substr("text", F.lit(1), keep),
                                                   F.substr("next_text", F.lit(1), third)))
    rows = add_fingerprint(rows, "edited_text", "edited_fingerprint", pieces=True)
    rows = add_likeness(rows, "fingerprint", "edited_fingerprint", "near_edited")
    return add_likeness(rows, "fingerprint", "next_fingerprint", "near_next").drop("next_text")
