"""Connected components by contraction: hook to a neighbour of lower random rank, jump, contract; each round is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


def _rank(node: str, turn: int) -> Column:
    """A node's rank in a round: random, drawn anew each time, ties by the node itself."""
    return F.struct(F.xxhash64(F.lit(turn), F.col(node)).alias("rank"), F.col(node).alias("node"))


def _hop(forest: DataFrame) -> DataFrame:
    """Every node's parent's parent; parents without a row of their own can't occur, since roots point to themselves."""
    up = forest.select(F.col("node").alias("up"), F.col("parent").alias("over"))
    return forest.join(up, forest["parent"] == up["up"]).select("node", F.col("over").alias("parent"))


def rounds(edges: DataFrame) -> list[DataFrame]:
    """(node, parent) of each round of contraction, as tables; the last round's parents have no edges left between them.

    In a round each node takes its neighbour of the smallest rank as parent, if that is smaller than its own, and then an
    ancestor up to four steps up. Nodes become their ancestors; edges within one go, and an ancestor that isn't a root
    keeps an edge to its own. Of a node and its neighbours, each is as likely to rank lowest, so at least half of the
    nodes that still have edges are expected to go in a round, whatever the graph: rounds grow with the logarithm of the
    number of nodes, and the tables shrink.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both, found = written(both, "edges"), []
    while not both.isEmpty():
        turn = len(found)
        low = both.groupBy("a").agg(F.min(_rank("b", turn)).alias("low"))
        forest = written(low.select(F.col("a").alias("node"), F.least("low", _rank("a", turn))["node"].alias("parent")), "forest")
        found.append(written(_hop(_hop(forest)), "forest"))
        above = found[-1].select(F.col("node").alias("at"), F.col("parent").alias("to"))
        near = both.join(above, both["a"] == above["at"]).select(F.col("to").alias("a"), "b")
        near = near.join(above, near["b"] == above["at"]).select("a", F.col("to").alias("b"))
        ends = found[-1].select(F.col("parent").alias("at")).distinct()
        open_ = above.join(ends, "at", "left_semi").filter("at <> to").select(F.col("at").alias("a"), F.col("to").alias("b"))
        pairs = near.filter("a <> b").unionByName(open_).unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = written(pairs.distinct(), "edges")
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component: the smallest node reachable.

    The rounds' tables are put together from the last, the smallest, to the first. No rows without edges: an empty table.
    """
    with scratch(edges.sparkSession) as keep:
        found = rounds(edges)
        if not found:
            keep.append(empty := written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0), "labels"))
            return empty
        roots = found[-1]
        for earlier in reversed(found[:-1]):
            later = roots.select(F.col("node").alias("at"), F.col("parent").alias("root"))
            joined = earlier.join(later, earlier["parent"] == later["at"], "left")
            roots = written(joined.select("node", F.coalesce("root", "parent").alias("parent")), "roots")
        least = roots.groupBy("parent").agg(F.min("node").alias("component"))
        labels = written(roots.join(least, "parent").select("node", "component"), "labels")
        keep.append(labels)
        return labels
