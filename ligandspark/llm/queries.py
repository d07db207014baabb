"""Registered queries of the training-data operators: each applies its operator,
with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligandspark.llm import (
    embeddings, exact, licenses, merkle, packing, pieces, runs, sharding, simhash, suffix_dedup, toxicity, trie, urls,
)
from ligandspark.llm.common import lookup, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, packing.CAPACITY, packing.END_ID).drop("ids")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), embeddings.COSINE)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.SHINGLE, simhash.RADIUS)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m.kind == "base")
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(
        m.first_word.alias("a"), (m.first_word + m.words).alias("b"))))
    nothing = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    # a word that several matches cover counts once
    covered = F.aggregate(spans, nothing, lambda s, x: F.struct(
        F.greatest(s.end, x.b).alias("end"),
        (s.n + F.greatest(F.lit(0).cast("long"), x.b - F.greatest(s.end, x.a))).alias("n")), lambda s: s.n)
    starts = F.transform(base, lambda m: m.first_word)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda m: m.label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.label))), ",").alias("labels"),
        F.when(F.col("n_words") == 0, 0.0)
        .otherwise(F.least(F.lit(1.0), covered / F.greatest(F.col("n_words"), F.lit(1)))).alias("score"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = merkle.document_fingerprints(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
        merkle.first_changed_leaf(F.col("fingerprint"), F.col("edited_fingerprint")).alias("first_changed_leaf"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(table(spark, sf_dir, "documents"), suffix_dedup.LENGTH)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"),
                       (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode_decode(table(spark, sf_dir, "documents"), PIECE_BPE)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"), sharding.SHARDS, stable=True)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_insult", "p_contempt", "p_toxic", "is_toxic",
                         (~F.col("is_toxic")).alias("kept"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of all rows; about one text in ten (by the CRC-32 of the id)
    repeats some of its words with a period from some word on to its end."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("_h", F.crc32(F.col("doc_id").cast("string")))
    src = src.withColumn("_g", F.when(F.col("_h") % 10 == 0, F.expr("_h div 10")))
    src = src.withColumn("_w", F.when(F.col("_g").isNotNull(), F.filter(
        F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))
    src = src.withColumn("_n", F.coalesce(F.size("_w").cast("long"), F.lit(0)))
    src = src.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    src = src.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    again = F.transform(F.sequence("_a", F.col("_n") - 1), lambda i: F.get(
        "_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    rebuilt = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), again), " ")
    return src.select("doc_id", F.when(F.col("_n") > 0, rebuilt).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = runs.collapse_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    done = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"),
                       F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").alias("_l"), "collapsed")
    return done.select(
        "doc_id", "n_runs", (-F.col("_b.col2")).alias("start"), F.col("_b.length").alias("length"),
        (-F.col("_b.col3")).alias("period"), F.expr("1000 * _b.length div -_b.col3").alias("exponent_milli"),
        F.sha2("_l", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, turn_digest, chars`` and ``conv_id``: conversation c begins
    with the first crc32(c) % 6 turns of conversation c - c % 100, and goes on
    with its own turns after as many."""
    turns = trie.turns_of(conversations)
    convs = turns.select("conv_id").distinct().select(
        "conv_id", (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    heads = turns.where("pos <= 5").select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "turn_digest", "chars")
    heads = heads.where("base % 100 = 0")           # at most 5 rows per id, for at most 199 conversations
    first = convs.join(heads, "base").where("depth <= h").select("conv_id", "depth", "turn_digest", "chars")
    length = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    shift = convs.join(length, "base", "left").select(
        "conv_id", "h", (F.least("h", F.coalesce("n", F.lit(0))) - F.col("h")).alias("shift"))
    rest = lookup(turns, "conv_id", shift).where("pos > h").select(
        "conv_id", (F.col("pos") + F.col("shift")).alias("depth"), "turn_digest", "chars")
    return first.unionByName(rest), convs.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*rebuilt_conversations(table(spark, sf_dir, "conversations")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_simhash": op4_simhash,
    "op5_license_scans": op5_license_scans,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_dedup": op13_exact_dedup,
}
# The operators whose whole result SQL can give; all others are tested against brute force.
ORACLE: dict[str, str] = {"op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
links AS (SELECT a, count(*) AS n FROM p GROUP BY a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT m.vec_id, coalesce(links.n, 0) AS n_links, least(m.vec_id, coalesce(low.b, m.vec_id)) AS component_id,
       m.vec_id = least(m.vec_id, coalesce(low.b, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN links ON m.vec_id = links.a LEFT JOIN low ON m.vec_id = low.a
""", "op12_prefix_trie": """
WITH RECURSIVE bits AS (SELECT range AS c, range AS b, 0 AS k FROM range(256)
  UNION ALL SELECT c, CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(b ORDER BY c) AS t FROM bits WHERE k = 8),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 6 AS h
          FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (
  SELECT c.conv_id, t.pos AS ord, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 5 + t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
hashed AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
             sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS node
           FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY ord)),
path AS (SELECT conv_id, depth, chars, node FROM hashed UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
nodes AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
            (count(*) - 1) * any_value(chars) AS saved FROM path GROUP BY node),
edges AS (SELECT DISTINCT a.node AS parent, b.node AS child FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
under AS (SELECT DISTINCT a.node AS top, b.node AS node FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT u.top, sum(n.saved)::BIGINT AS saved_tokens,
           count(*) FILTER (WHERE u.node NOT IN (SELECT parent FROM edges)) AS n_leaves
         FROM under u JOIN nodes n ON u.node = n.node GROUP BY u.top),
ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
         FROM (SELECT conv_id, arg_max(node, depth) AS node FROM path GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
       (SELECT count(*) FROM edges e WHERE e.parent = n.node) AS n_children, s.n_leaves, s.saved_tokens,
       sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON n.node = s.top LEFT JOIN edges x ON x.child = n.node LEFT JOIN nodes p ON p.node = x.parent
LEFT JOIN ends ON ends.node = n.node
""", "op13_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
             AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size, max(doc_id) FILTER (WHERE doc_id <= m) IS NOT NULL
        AS in_history FROM t, (SELECT (min(doc_id) + max(doc_id)) // 2 AS m FROM documents) GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256, g.in_history
FROM t JOIN g ON t.text_sha256 = g.text_sha256
"""}
