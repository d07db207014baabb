"""Connected components of a link table, without collecting links or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandspark.llm.common import cut


def _flatten(parent: DataFrame) -> DataFrame:
    """Pointer jumping: ``node -> up`` until every ``up`` is a root."""
    while True:
        q = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = cut(parent.join(q, "up", "left").select(
            "node", F.coalesce("top", "up").alias("up"),
            (F.coalesce(F.col("top"), F.col("up")) != F.col("up")).alias("moved")))
        parent = step.select("node", "up")
        if step.where("moved").isEmpty():
            return parent


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``node, component``: for each node of a link the
    smallest node that it reaches.

    Rounds of contraction: every node points to its smallest neighbour (a
    partial aggregation, so a hub is no hot task), the pointers are flattened,
    and the links are rewritten between the roots.  Two rounds at least halve
    the roots of every unfinished component.  Self-links, repeated links and
    links with a null end are ignored; no links give no rows."""
    e = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .where("a < b").distinct())
    out = None
    while not e.isEmpty():
        up = (e.select(F.col("b").alias("node"), F.col("a").alias("up"))
              .unionByName(e.select(F.col("a").alias("node"), F.col("b").alias("up")))
              .groupBy("node").agg(F.min("up").alias("up"))
              .select("node", F.least("node", "up").alias("up")))
        up = _flatten(cut(up))
        if out is None:
            out = up.select("node", F.col("up").alias("component"))
        else:
            top = up.select(F.col("node").alias("component"), F.col("up").alias("_top"))
            out = cut(out.join(top, "component", "left")
                      .select("node", F.coalesce("_top", "component").alias("component")))
        a = up.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        e = e.join(a, "a").join(b, "b").where("ra <> rb")
        e = cut(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if out is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out
