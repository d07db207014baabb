"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns.  Its key is made from sums of hash
numbers, one set per (depth, turn), so the keys of all prefixes are running sums:
no conversation has to lie in one task.  Totals over subtrees come from rounds
of joins.  A round rakes all leaves into their parents and compresses unary
chains (nodes with one child that are not neighbours are spliced out, their
weight goes to the edge below); the contracted nodes are expanded again in the
reverse order.  The number of rounds grows with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandspark.llm.common import cut, lookup, parallelism, written
from ligandspark.plans.scan import prefix_scan

LANES = 5           # numbers of 32 bits in a key
PIECE = 1 << 16     # bytes of a piece of an id list, about
DEPTH_ROUNDS = 12   # rounds that splice by the bits of the depth; later ones draw by hash


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_digest, chars`` of ``conversations(conv_id, turn, role,
    text, ...)``: turns numbered from 1 by ``turn`` (null first; equal ones by
    their digests), and the SHA-256 of role and text (null: empty).  Rows without
    a conv_id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        digest.alias("turn_digest"), F.length(text).cast("long").alias("chars")).where("conv_id is not null")
    rows = prefix_scan(cut(rows), ["conv_id"], "turn", tiebreak=["turn_digest"], row_number="pos")
    return cut(rows.select("conv_id", "pos", "turn_digest", "chars"))


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]), 256))


def keyed(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, chars, key, parent_key`` of ``turns(conv_id, depth,
    turn_digest, chars)``, whose depths run from 1 without a gap in each conversation."""
    lanes = [f"lane{k}" for k in range(LANES)]
    rows = turns.withColumns({c: F.shiftrightunsigned(F.xxhash64(F.lit(k), "depth", "turn_digest"), 32)
                              for k, c in enumerate(lanes)})
    rows = prefix_scan(rows, ["conv_id"], "depth", sums=lanes)
    return written(rows.select(
        "conv_id", "depth", "chars", _key(F.col("depth"), [F.col(f"cum_{c}") for c in lanes]).alias("key"),
        _key(F.col("depth") - 1, [F.col(f"cum_{c}") - F.col(c) for c in lanes]).alias("parent_key")), "prefixes")


def id_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``ends(key, conv_id)``: SHA-256 of the decimal ids in
    ascending order, joined by commas.

    Ids are put in order range by range, so the ids of one key may lie in many
    tasks; each gives pieces of text, and only those come together."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "first", "ids"]
        key, first, held, size, out = None, None, [], 0, []

        def close() -> None:
            nonlocal held, size
            if held:
                out.append((key, first, ",".join(held)))
            held, size = [], 0

        for b in batches:
            for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key or size > PIECE:
                    close()
                    key, first = k, i
                t = str(i)
                held.append(t)
                size += len(t) + 1
            yield pa.RecordBatch.from_pydict(
                {n: [r[c] for r in out] for c, n in enumerate(names)},
                pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))
            out = []
        close()
        yield pa.RecordBatch.from_pydict(
            {n: [r[c] for r in out] for c, n in enumerate(names)},
            pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "ends_sha256": [d for _, d in done]},
                                             pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))
            done.clear()
            return out

        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
            yield batch()
        if state:
            done.append((key, state.hexdigest()))
        yield batch()

    n = parallelism(ends.sparkSession)
    parts = (ends.select("key", "conv_id").repartitionByRange(n, "key", "conv_id")
             .sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key binary, first long, ids string"))
    return (parts.repartition("key").sortWithinPartitions("key", "first")
            .mapInArrow(digests, "key binary, ends_sha256 string"))


def _chosen(c: Column, d: Column, number: int) -> Column:
    """Whether the node may be spliced in this round: by a bit of its depth, so
    that a plain chain halves, and later by the draw of a hash."""
    if number < DEPTH_ROUNDS:
        return F.shiftright(d, number % 10).bitwiseAND(F.lit(1)) == 1
    return F.xxhash64(c, d, F.lit(number)).bitwiseAND(F.lit(1)) == 1


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``conv_id, depth`` and for each of ``values`` its sum over the node's
    subtree, from ``nodes(conv_id, depth, parent_conv_id, kids, <values>)`` with
    ids ``(conv_id, depth)``, the parent one level above, the number of children
    ``kids``, and a null parent for the root.

    ``live`` holds per node the sum ``a_`` of itself and of what was raked into
    it, and the sum ``e_`` of the spliced nodes on the edge to its parent.  Every
    step is a written table: a checkpoint would hand the constraints of the steps
    before on to the planner, which grow with each round."""
    live = written(nodes.select(
        F.col("conv_id").alias("c"), F.col("depth").cast("long").alias("d"), F.col("parent_conv_id").alias("pc"),
        F.when(F.col("parent_conv_id").isNotNull(), F.col("depth").cast("long") - 1).alias("pd"),
        F.col("kids").cast("long").alias("kids"), *[F.col(v).cast("long").alias(f"a_{v}") for v in values],
        *[F.lit(0).cast("long").alias(f"e_{v}") for v in values]), "live")
    a, e = [f"a_{v}" for v in values], [f"e_{v}" for v in values]
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while not live.isEmpty():
        leaf = F.col("kids") == 0
        raked = live.where(leaf).select("c", "d", *[F.col(x).alias(v) for x, v in zip(a, values, strict=True)])
        below = live.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(
            *[F.coalesce(F.sum(F.when(leaf, F.col(x) + F.col(y))), F.lit(0)).alias(f"r{x}")
              for x, y in zip(a, e, strict=True)],
            F.count_if(~leaf).alias("left"), F.max(F.when(~leaf, F.struct("c", "d", *e))).alias("kid"))
        number = len(rounds)
        mine, its = _chosen(F.col("c"), F.col("d"), number), _chosen(F.col("kid.c"), F.col("kid.d"), number)
        inner = written(live.where(~leaf).join(below, ["c", "d"]).select(
            "c", "d", "pc", "pd", F.col("left").alias("kids"), *[(F.col(x) + F.col(f"r{x}")).alias(x) for x in a], *e,
            "kid", F.coalesce((F.col("left") == 1) & F.col("pc").isNotNull() & mine & ~its, F.lit(False)).alias("out")), "inner")
        spliced = inner.where("out").select(
            "c", "d", F.col("kid.c").alias("kc"), F.col("kid.d").alias("kd"),
            *[(F.col(x) + F.col(f"kid.{y}")).alias(v) for x, y, v in zip(a, e, values, strict=True)])
        rounds.append((raked, spliced))
        edge = inner.where("out").select(
            F.col("kid.c").alias("c"), F.col("kid.d").alias("d"), F.col("pc").alias("npc"), F.col("pd").alias("npd"),
            *[(F.col(x) + F.col(y)).alias(f"n{y}") for x, y in zip(a, e, strict=True)])
        live = written(inner.where(~F.col("out")).join(edge, ["c", "d"], "left").select(
            "c", "d", F.coalesce("npc", "pc").alias("pc"), F.coalesce("npd", "pd").alias("pd"), "kids", *a,
            *[(F.col(y) + F.coalesce(F.col(f"n{y}"), F.lit(0))).alias(y) for y in e]), "live")
    total = None
    for raked, spliced in reversed(rounds):     # all nodes that outlive a round have their totals by now
        if total is not None:
            below = total.withColumnsRenamed({"c": "kc", "d": "kd", **{v: f"b_{v}" for v in values}})
            grown = spliced.join(below, ["kc", "kd"]).select(
                "c", "d", *[(F.col(v) + F.col(f"b_{v}")).alias(v) for v in values])
            raked = total.unionByName(raked).unionByName(grown)
        total = written(raked, "totals")
    if total is None:
        total = live.select("c", "d", *[F.col(x).alias(v) for x, v in zip(a, values, strict=True)])
    return total.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), *values)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of all conversations in ``convs(conv_id)``, distinct ids,
    with the turns ``turns(conv_id, depth, turn_digest, chars)``, numbered from 1
    without gaps; a conversation may have none.

    One row per node, from the root (depth 0): ``conv_id`` the smallest member,
    ``depth``, ``parent_conv_id`` (root: null), ``n_convs`` members, ``n_children``,
    ``n_leaves`` childless nodes in the subtree, ``saved_tokens`` (over the subtree
    the sum of each node's (members - 1) times the characters of its last turn),
    and ``ends_sha256`` of the ids of the conversations that end there.  Equal
    conversations share all nodes.  No conversations give no nodes."""
    zero = [F.lit(0)] * LANES
    root_key = _key(F.lit(0), zero)
    rows = keyed(turns)
    nodes = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").cast("long").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.max("parent_key").alias("parent_key"), F.max("chars").alias("chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root_key.alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs",
        F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("long").alias("chars"))
    nodes = written(nodes.unionByName(root), "nodes")
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("n_children"))
    last = rows.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("key", root_key).alias("key"), "conv_id")
    up = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    # the root may be the parent of a third of all nodes
    nodes = lookup(nodes, "parent_key", up, "left")
    done = written(nodes.join(children, "key", "left").join(id_digests(ends), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")), "trie")
    sums = subtree_sums(done.select(
        "conv_id", "depth", "parent_conv_id", F.col("n_children").alias("kids"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens")),
        ["n_leaves", "saved_tokens"])
    return done.drop("saved").join(sums, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
