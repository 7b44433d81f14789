"""Operator 12: a Merkle manifest of a dataset by time-forward processing.

Every row is a leaf, every source a tree of arity ``ARITY`` over its leaves in
order of doc_id, and the sources' roots are the leaves of one more tree. Nodes
are labelled (level, number). Time-forward processing takes the nodes in order
of their labels: a node's digest is sent to its parent as a message, kept in a
priority queue ordered by the receiver's label, so that a node finds all its
children's digests at the head of the queue when its turn comes. A reversed
sweep then sends the siblings on a node's way to the root down to its children.

The external queue is Spark's sorted shuffle: a round deals the nodes of a
tree by blocks of ``ARITY ** LEVELS`` neighbours, sorted by label, and every
block runs through ``LEVELS`` levels with a queue of its own in memory
(bounded by the block). What a block has left is one node of the next round.
So a billion leaves take three rounds, and a source that holds a third of all
rows is many blocks. The reversed sweep uses the same blocks, each with the
one way to the root that its top has.

Leaves get their numbers without gathering a source: rows are range-sorted by
(source, doc_id, leaf and a row number, which also splits equal rows), counted
per range and source, and the counts are added up.

Defined results: a null field counts as ``-``, an empty one as ``0:``; a null
source is a tree of its own and comes first; rows without doc_id come first in
their source, rows that repeat a doc_id are ordered by their leaf; repeated
rows are leaves each, in any order, since they have the same digest; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, ship_package, stored

ARITY = 3
LEVELS = 8  # of a round
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<place: int, siblings: array<string>>>"


def field(c: Column) -> Column:
    """A field as it enters a leaf: ``-`` for null, else its length in bytes, a colon and its text."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*columns), 256)


def node_digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def rise(digests: list[str], levels: int | None = None) -> dict[tuple, str]:
    """All nodes above and including ``digests``, as (level, number) to digest, after ``levels`` levels or to the root."""
    queue = [((0, i), 0, d) for i, d in enumerate(digests)]  # (receiver, place, message); sorted, so it is a heap
    nodes, left = {}, len(digests)
    while queue:
        label = level, number = queue[0][0]
        got = []
        while queue and queue[0][0] == label:
            got.append(heapq.heappop(queue)[2])
        nodes[label] = node_digest(got) if level else got[0]
        if number == 0 and level:
            left = -(-left // ARITY)  # the nodes on this level
        if level < levels if levels is not None else left > 1:
            heapq.heappush(queue, ((level + 1, number // ARITY), number % ARITY, nodes[label]))
    return nodes


def fall(nodes: dict[tuple, str], way: list) -> list[list]:
    """The ways to the root of the nodes of level 0, given the ``way`` of the highest node.

    A way is a list of (place, siblings), from below to above.
    """
    ways = {max(nodes): way}
    for label in sorted(nodes, reverse=True):
        level, number = label
        if level:
            above = ways.pop(label)
            run = [c for c in ((level - 1, number * ARITY + i) for i in range(ARITY)) if c in nodes]
            for place, child in enumerate(run):
                ways[child] = [{"place": place, "siblings": [nodes[c] for c in run if c != child]}, *above]
    return [ways[label] for label in sorted(ways)]


def _blocks(batches):
    """The rows of each block, which the sort has put together, as dictionaries."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for (tree, block), group in groupby(rows, lambda r: (r["tree"], r["block"])):
        yield tree, block, list(group)


def _levels(block: int, n: int) -> int | None:
    """The first block of a tree that is not full is the whole tree: up to its root."""
    return None if block == 0 and n < ARITY**LEVELS else LEVELS


def rise_batches(batches):
    """Sorted (tree, block, number, digest) to the highest node of each block, (tree, number, digest)."""
    out = []
    for tree, block, rows in _blocks(batches):
        nodes = rise([r["digest"] for r in rows], _levels(block, len(rows)))
        out.append((tree, block, nodes[max(nodes)]))
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    tree, number, made = zip(*out) if out else ((), (), ())
    columns = [pa.array(tree, pa.string()), pa.array(number, pa.int64()), pa.array(made, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "number", "digest"])


PATH_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def fall_batches(batches):
    """Sorted rows as for ``rise_batches``, led in each block by the row of its way, to each row with its own way."""
    for tree, block, rows in _blocks(batches):
        head, *rows = rows
        ways = fall(rise([r["digest"] for r in rows], _levels(block, len(rows))), head["way"])
        for at in range(0, len(rows), 2000):
            some = rows[at : at + 2000]
            columns = [
                pa.array([tree] * len(some), pa.string()),
                pa.array([r["number"] for r in some], pa.int64()),
                pa.array([r["digest"] for r in some], pa.string()),
                pa.array([r["doc_id"] for r in some], pa.int64()),
                pa.array([r["claimed"] for r in some], pa.string()),
                pa.array(ways[at : at + 2000], PATH_ARROW),
                pa.array([head["subroot"]] * len(some), pa.string()),
                pa.array([head["root"]] * len(some), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "number", "digest", "doc_id", "claimed", "way", "subroot", "root"])


NODE = "tree string, number long, digest string"
LEAD = f"way {PATH}, subroot string, root string"


def in_order(rows: DataFrame, tree: str, *by: str) -> DataFrame:
    """``rows`` with ``number``, from 0 in each tree (nulls are one tree) in ascending order of ``by``, nulls first.

    ``by`` need not be unique; the order of equal rows is fixed when this is stored.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *by, "_row")]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    placed = stored(ranged.withColumn("_part", F.spark_partition_id()), "ordered")
    sums = placed.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_tree").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0).cast("long"))).drop("_n")
    inside = Window.partitionBy(tree, "_part").orderBy(*keys[1:])
    numbered = placed.withColumn("_inside", F.row_number().over(inside) - 1)
    both = numbered.join(sums, (F.col("_part") == F.col("_of")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return both.withColumn("number", F.col("_ahead") + F.col("_inside")).drop("_row", "_part", "_of", "_n", "_tree", "_ahead", "_inside")


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "number")


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The nodes at the start of every round, the last with one node per tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("number")).first()[0] or 0) > 0:
        block = F.floor(F.col("number") / ARITY**LEVELS).alias("block")
        above = _dealt(rounds[-1].select("tree", block, "number", "digest")).mapInArrow(rise_batches, NODE)
        rounds.append(stored(above, "nodes"))
    return rounds


def descended(rounds: list[DataFrame], ways: DataFrame) -> DataFrame:
    """The nodes of the first round with their ways, given ``(tree, way, subroot, root)`` of each tree's root."""
    leads = ways.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(rounds):
        rows = nodes.withColumn("block", F.floor(F.col("number") / ARITY**LEVELS))
        leads = leads.withColumn("number", F.lit(-1).cast("long"))
        both = _dealt(rows.unionByName(leads, allowMissingColumns=True))
        for c, kind in (("doc_id", "long"), ("claimed", "string")):
            if c not in both.columns:
                both = both.withColumn(c, F.lit(None).cast(kind))
        out = both.mapInArrow(fall_batches, f"{NODE}, doc_id long, claimed string, {LEAD}")
        if nodes is not rounds[0]:
            leads = stored(out.select("tree", F.col("number").alias("block"), "way", "subroot", "root"), "ways")
    return out


def leaves(docs: DataFrame, changed: Column | None = None, where: Column | None = None) -> DataFrame:
    """``(doc_id, source, digest, claimed)``: every row's leaf, and the leaf it claims to have.

    ``changed`` is the text that is shown in place of the row's own ``where`` that holds.
    """
    d = pick(docs, *FIELDS)
    own = [field(F.col(c)) for c in FIELDS]
    claimed = F.lit(None).cast("string")
    if changed is not None:
        claimed = F.when(F.coalesce(where, F.lit(False)), digest(*own[:-1], field(changed)))
    return d.select("doc_id", "source", digest(*own).alias("digest"), claimed.alias("claimed"))


def proofs(leaf_rows: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, claimed, subroot, root, way`` of every leaf: ``way`` is its proof, from below to above.

    ``leaf_rows`` are as from ``leaves``. Sources are the trees of the lower
    level, and their roots the leaves of the upper one.
    """
    ship_package(leaf_rows.sparkSession)
    # texts are read once; what follows uses digests only
    once = stored(leaf_rows.withColumnRenamed("source", "tree"), "leaves")
    lower = climbed(stored(in_order(once, "tree", "doc_id", "digest"), "numbered"))
    sources = lower[-1].select(F.lit("").alias("all"), F.col("tree").alias("source"), F.col("digest"))
    tops = stored(in_order(sources, "all", "source"), "sources").withColumnRenamed("all", "tree")
    upper = climbed(tops)
    top = upper[-1].select("tree", F.array().cast(PATH).alias("way"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    down = descended(upper, top).select(F.col("number").alias("n"), "way", "root")
    ways = tops.join(down, F.col("n") == F.col("number")).select(F.col("source").alias("tree"), "way", F.col("digest").alias("subroot"), "root")
    out = descended(lower, stored(ways, "source-ways"))
    return out.select("doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "claimed", "subroot", "root", "way")


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its way lead to."""

    def above(node: Column, step: Column) -> Column:
        siblings, place = step["siblings"], step["place"]
        before = F.array_join(F.slice(siblings, F.lit(1), place), "")
        after = F.array_join(F.slice(siblings, place + 1, F.size(siblings)), "")
        return F.sha2(F.concat(before, node, after), 256)

    return F.aggregate(way, leaf, above)


def siblings(way: Column) -> Column:
    """All siblings of a way, from below to above and left to right, as one string."""
    return F.array_join(F.flatten(F.transform(way, lambda s: s["siblings"])), "")
