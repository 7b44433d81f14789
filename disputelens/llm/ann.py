"""Operator 8: approximate nearest neighbours with a hash-prefix forest.

A vector's hash string in a tree is the signs of its products with that tree's
random directions, ``BITS`` long. A tree is the sorted array of the strings of
an index block. A query descends in every tree to the longest prefix it shares
with any entry, then ascends in all trees in step, one tree and one bit at a
time, until the ranges of entries that share the prefixes hold ``ASCENT``
times the block's rows. What the ranges hold are the candidates, compared by
exact cosine in double precision.

The index is every row, dealt into blocks of bounded mean size by a hash of
the id; each block is a forest of its own. Query blocks meet index blocks by
key, so memory is bounded by two blocks, a much repeated vector is spread over
all blocks, and only the ``k`` best of each pair of blocks travel on.

Vectors without any order (as random directions are) have their neighbours at
almost right angles, and no short prefix finds them: ``ASCENT`` is set so that
recall stays above 0.9 even there (measured in the README).

Defined results: rows without vec_id, and vectors that are null, zero, of
another length than most, or hold null or non-finite components take no part;
rows that repeat a vec_id are one vector, the nearest of them, and as a query
the smallest by components; vectors of any finite magnitude are compared; equal cosines
are ordered by vec_id; fewer candidates than ``k`` are all returned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, pick, ship_package

TREES = 32
BITS = 32
ASCENT = 1.0  # entries in the ranges of all trees, times the rows of the block
LEAST = 64  # rows at least: a block of no more is compared whole
BLOCK = 2048  # mean rows of an index block
QUERY_BLOCK = 8192
SEED = 8


class Forest:
    """The sorted hash strings of a block's unit vectors, one array per tree."""

    def __init__(self, units: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.directions = rng.standard_normal((trees, units.shape[1], bits))
        self.n = len(units)
        codes = self.strings(units)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def strings(self, units: np.ndarray) -> np.ndarray:
        """Hash strings as integers, the first bit the highest; trees x vectors."""
        places = (1 << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
        return np.stack([((units @ d > 0) * places).sum(1, dtype=np.uint64) for d in self.directions])

    def candidates(self, units: np.ndarray, enough: int):
        """Yields for every query the places of its candidates."""
        codes = self.strings(units)
        trees, n = codes.shape
        lows, highs = [], []
        for level in range(self.bits + 1):  # level: bits of the prefix
            tail = np.uint64((1 << (self.bits - level)) - 1)
            low, high = codes & ~tail, codes | tail
            lows.append(np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, low)]))
            highs.append(np.stack([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, high)]))
        lows, highs = np.stack(lows), np.stack(highs)
        sizes = highs - lows
        totals = sizes.sum(1)
        # the longest prefix with enough entries in all trees; above it only some trees need to ascend
        level = (totals >= enough).sum(0) - 1
        level = np.maximum(level, 0)
        for q in range(n):
            at = level[q]
            below = min(at + 1, self.bits)
            held = sizes[below, :, q].sum() + np.cumsum(sizes[at, :, q] - sizes[below, :, q])
            ascended = np.searchsorted(held, enough) + 1
            found = np.zeros(self.n, bool)
            for t in range(trees):
                to = at if t < ascended else below
                found[self.order[t, lows[to, t, q] : highs[to, t, q]]] = True
            yield np.flatnonzero(found)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors with largest components of 1/2 to 1: powers of two change no cosine, and squares stay finite."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple]:
    """The k nearest candidates of each query in one block, as (query, row, cosine)."""
    queries, rows = scaled(queries), scaled(rows)
    q_norm, r_norm = np.sqrt((queries * queries).sum(1)), np.sqrt((rows * rows).sum(1))
    forest = Forest(rows / r_norm[:, None])
    enough = max(TREES * min(LEAST, len(rows)), int(ASCENT * len(rows)))
    out = []
    for q, places in enumerate(forest.candidates(queries / q_norm[:, None], enough)):
        places = places[row_ids[places] != query_ids[q]]
        if not len(places):
            continue
        # row by row, so that equal vectors have equal cosines
        cosines = (rows[places] * queries[q]).sum(1) / (r_norm[places] * q_norm[q])
        if len(places) > k:
            least = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
            places, cosines = places[cosines >= least], cosines[cosines >= least]
        best = np.lexsort((row_ids[places], -cosines))
        seen: set = set()
        for b in best:
            if row_ids[places[b]] not in seen and len(seen) < k:
                seen.add(row_ids[places[b]])
                out.append((int(query_ids[q]), int(row_ids[places[b]]), float(cosines[b])))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors that take part, in double precision."""
    v = pick(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    v = v.filter(
        F.col("vec_id").isNotNull()
        & F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
        & F.expr("exists(embedding, x -> x != 0)")
    )
    common = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("embedding") == (common["n"] if common else 0))


def search(vectors: DataFrame, is_query, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every row for which ``is_query`` holds."""
    ship_package(vectors.sparkSession)
    index = usable(vectors)
    queries = index.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks, query_blocks = partitions_for(index.count(), block), partitions_for(queries.count(), query_block)
    dealt = index.select(
        F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks).cast("long")).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
        "vec_id",
        "embedding",
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"),
        "vec_id",
        "embedding",
    )

    def meet(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asking):
            found = nearest(
                np.stack(asking["embedding"]), asking["vec_id"].to_numpy(), np.stack(rows["embedding"]), rows["vec_id"].to_numpy(), k
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["block", "query_block"]
    found = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
