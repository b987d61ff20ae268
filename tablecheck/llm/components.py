"""Connected components of a graph of longs by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.session import cut_lineage


def _pull(edges: DataFrame) -> DataFrame:
    """Each (node, neighbour) with the node's least neighbour, itself included. Minima are combined before the
    shuffle; AQE splits a node with many edges, as its other side is one row."""
    least = edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    return edges.join(least, "node")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) for every node of ``edges`` (a, b longs; any order, repeats allowed, no nulls; a link of a node
    with itself says nothing). No edges give no rows.

    Every round is written to the shared folder, so lineage stays short and a lost executor costs one round.
    Rounds grow with the logarithm of the component size. Stops when a round changes no edge; an error after ``max_rounds``.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct()
    current = cut_lineage(pairs, "edges")
    before = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _pull(both).filter("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        # small star: a node's smaller neighbours, and itself, point to the least of them
        pulled = _pull(large)
        small = pulled.select(F.explode(F.array("node", "other")).alias("node"), F.col("least").alias("other"))
        current = cut_lineage(small.filter("node <> other").distinct(), "stars")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("other").alias("node"), F.col("other").alias("root")).distinct()
    return current.select("node", F.col("other").alias("root")).union(roots)
