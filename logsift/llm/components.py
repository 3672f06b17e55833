"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)`` that isn't its own component.

    ``component`` is the smallest node that can be reached. Alternates the two star steps
    until nothing changes: every node is hung on the smallest node it sees, first among its
    larger and then among its smaller neighbours, so paths halve in length each round. A
    step is one aggregation that combines before its shuffle and one join, both by node.
    The aggregate is written before the join, so that Spark splits the links of a node that
    holds many. Null ends and loops are ignored; an empty table gives an empty table.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.table(edges.distinct(), "edges-0")
    before, turn = None, 0
    while (state := _state(edges)) != before:
        before, turn = state, turn + 1
        large = scratch.table(_large_star(edges, scratch, f"least-l-{turn}"), f"large-{turn}")
        edges = scratch.table(_small_star(large, scratch, f"least-s-{turn}"), f"edges-{turn}")
        for name in (f"edges-{turn - 1}", f"large-{turn}", f"least-l-{turn}", f"least-s-{turn}"):
            scratch.forget(name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Hangs the larger neighbours of every node on the smallest of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    least = scratch.table(least, name)
    hung = both.where("b > a").join(least, F.col("a") == F.col("n"))
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Hangs every node and its smaller neighbours on the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    least = scratch.table(least, name)
    hung = edges.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    roots = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").union(roots).distinct()
