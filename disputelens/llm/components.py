"""Connected components by alternating large and small stars, with nothing on the driver but a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

ROUNDS = 60  # the number needed grows with the log of the longest path; reaching this raises


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """``(node, label)`` for every node in ``links`` (a, b): the smallest node it is connected with.

    Every round lets each node point its larger neighbours, then its smaller
    ones, to the smallest node it knows, until nothing changes. Each round is
    checkpointed to the shared folder, in ``parts`` files if given; the driver
    sees one row per round.
    """
    edges, mark = _edges(links, parts), None
    for _ in range(ROUNDS):
        edges = checkpointed(_small_star(_large_star(edges)), parts)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.groupBy("lo").agg(F.lit(1).alias("_")).select(F.col("lo").alias("node"), F.col("lo").alias("label"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(roots)


def rough_labels(links: DataFrame, rounds: int = 1, parts: int | None = None) -> DataFrame:
    """``(node, label)`` after few rounds: nodes of one label are connected, but connected nodes may differ in label."""
    edges = _edges(links, parts)
    for _ in range(rounds):
        edges = checkpointed(_small_star(_large_star(edges)), parts)
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("label"))


def _edges(links: DataFrame, parts: int | None) -> DataFrame:
    ends = (F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    return checkpointed(links.filter(F.col("a") != F.col("b")).select(*ends), parts)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets the node's smallest neighbour (or itself); may repeat rows."""
    ends = F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))
    both = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all get the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    lower = F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    own = F.struct("hi", F.col("m").alias("lo"))
    pairs = F.when(F.col("lo") == F.col("m"), F.array(own)).otherwise(F.array(own, lower))
    return edges.join(least, "hi").select(F.explode(pairs).alias("e")).select("e.hi", "e.lo").distinct()
