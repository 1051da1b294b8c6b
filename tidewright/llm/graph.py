"""Connected components of an edge table, by contraction under random orders.

In each round the nodes get a new random order, a hash of node and round. A
node takes the least of itself and its neighbours in that order, the choice is
followed once more, and the edges are rewritten to what was chosen; edges
inside a component vanish. Every node with an edge but the least ones of their
neighbourhoods goes, so edges of any shape (long paths too) shrink by a
constant factor a round, and rounds go on until none is left. Every round is
written to the shared folder, so no lineage grows and no edge reaches the
driver; a round's tables are deleted once the next one is written.

Loops and repeated edges are ignored. Null ends have no edge. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.storage import discard, materialise


def _ordered(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.col(node), F.lit(turn)).alias("h"), F.col(node).alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) from edges(a, b); nodes without an edge are not listed."""
    current = materialise(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while labels is None or not current.isEmpty():
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min(_ordered("b", turn)).alias("m")).select(F.col("a").alias("node"), F.least(_ordered("a", turn), "m")["v"].alias("to")), "least")
        # one jump: the choice of the choice
        second = least.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = materialise(least.join(second, "to").select("node", F.col("next").alias("to")), "step")
        if labels is None:
            found = step.select("node", F.col("to").alias("label"))
        else:
            moved = step.select(F.col("node").alias("label"), "to")
            found = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        found = materialise(found, "labels")
        at = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        bt = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = current.join(at, "a").join(bt, "b").where(F.col("ta") != F.col("tb"))
        left = materialise(left.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        discard(least, step, current, *([labels] if labels is not None else []))
        labels, current, turn = found, left, turn + 1
    discard(current)
    names = labels.groupBy("label").agg(F.min("node").alias("least"))
    out = materialise(labels.join(names, "label").select("node", F.col("least").alias("label")), "components")
    discard(labels)
    return out
