"""Operator 13: hard negatives by Kronecker-packed products.

Components are whole numbers. Those of several candidates are biased to be at
least 0 and put into separated fields of one wide number, ``FIELDS`` at a
time; one product with an anchor's (biased) component then multiplies all of
them, the sums over the components stay inside their fields, and taking the
biases off again gives exact inner products. The wide number is a double with
its 53 whole bits, so that blocks are multiplied by one matrix product, or, if
the values are too large for that, a Python integer of any width. Field widths
come from the block's own largest values, so no value is cut.

An anchor's positives are its ``POSITIVES`` best rows of the same label. For
every positive, the ``NEGATIVES`` best rows of another label whose score lies
between the shares ``LOW`` and ``HIGH`` of the positive's are its negatives.

Rows are dealt into blocks of about ``BLOCK`` by ranges of (label, hash), so a
label that a third of all rows have is many blocks and a block has few labels.
Anchors go, in blocks of ``ANCHORS``, to the blocks that have their label for
the positives, and to those that have another one for the negatives. All that
travels on is the few best of each pair of blocks. Every anchor meets every
row: the result is exact.

Defined results: rows without vec_id or label, and those whose vector is null
or has a null or non-finite component (also after scaling) take no part; rows
that repeat vec_id, label and vector are one row; a row of the anchor's vec_id
is never its positive or negative; vectors of different length are not
compared; a score outside the range of a long is given as its end, but ordered
by its true value; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, pick, ship_package, stored

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of the positive's score
SCALE = 256
BLOCK = 16_384  # rows of a block, about
ANCHORS = 4_096  # anchors sent to a block at a time, about
FIELDS = 2  # candidates packed into one number
ROWS = 128  # anchors multiplied at a time
LONG = 2**63 - 1


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, anchors by rows, of matrices of whole numbers (as doubles).

    int64 where biased sums fit a double's 53 bits, else Python integers.
    """
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if max(abs(anchors).max(), abs(rows).max()) <= largest(rows.shape[1]):
        return _packed(anchors, rows, FIELDS, np.float64)
    whole = np.frompyfunc(int, 1, 1)
    return _packed(whole(anchors), whole(rows), FIELDS, object)


def largest(d: int) -> float:
    """The largest component for which d products of biased ones add up to less than 2^52."""
    return float(int((2**50 / max(d, 1)) ** 0.5))


def _packed(anchors: np.ndarray, rows: np.ndarray, fields: int, kind) -> np.ndarray:
    n, d = rows.shape
    a0, b0 = int(anchors.min()), int(rows.min())
    a, b = anchors - a0, rows - b0  # at least 0
    # no field's sum exceeds this: each is an inner product of numbers at least 0
    most = min(int(a.max()) * int(b.sum(1).max()), int(b.max()) * int(a.sum(1).max()))
    width = max(1, most.bit_length())
    if kind is np.float64:
        fields = max(1, min(fields, 52 // width))
    size = -(-n // fields)
    step = 2**width
    wide = np.zeros((size, d), kind)
    for f in reversed(range(fields)):
        part = b[f * size : (f + 1) * size]
        wide *= step
        wide[: len(part)] += part
    sums = a @ wide.T
    if kind is np.float64:
        sums = sums.astype(np.int64)
    out = np.concatenate([(sums // step**f) % step for f in range(fields)], 1)[:, :n]
    sum_a, sum_b = anchors.sum(1)[:, None], rows.sum(1)[None, :]
    # (a - a0)(b - b0) summed up is ab - a0 * sum(b) - b0 * sum(a) + d * a0 * b0
    bias = sum_b * a0 + sum_a * b0 - d * a0 * b0
    return out + (bias.astype(np.int64) if kind is np.float64 else bias)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest allowed scores, first columns first among equal ones."""
    if scores.dtype != object and scores.shape[1] > 4 * k:
        # what is below the k-th largest can't be among them
        low = np.iinfo(np.int64).min
        masked = np.where(allowed, scores, low)
        least = np.partition(masked, masked.shape[1] - k, 1)[:, masked.shape[1] - k]
        allowed = allowed & (masked >= least[:, None])
    i, j = np.nonzero(allowed)
    if not len(i):
        return i, j
    return _first(i, j, scores[i, j], k)


def _first(i: np.ndarray, j: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if score.dtype == object:
        order = np.array(sorted(range(len(i)), key=lambda x: (i[x], -score[x], j[x])))
    else:
        order = np.lexsort((j, -score, i))
    i, j = i[order], j[order]
    begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)]))
    return i[rank < k], j[rank < k]


def _scaled(column: pd.Series) -> np.ndarray:
    return np.floor(SCALE * np.stack(column.to_numpy()).astype(np.float64))


def _text(scores) -> list[str]:
    return [str(int(s)) for s in scores]


def _parts(rows: pd.DataFrame, anchors: pd.DataFrame):
    """Anchors and rows of equal length with their products, a few anchors at a time; large values apart."""
    if len(rows) and rows["label"].nunique() == 1 and "positives" in anchors:
        anchors = anchors[anchors["label"] != rows["label"].iloc[0]]
    if not len(rows) or not len(anchors):
        return
    for n, some in rows.sort_values("vec_id").groupby(rows["vector"].map(len)):
        asking = anchors[anchors["vector"].map(len) == n].sort_values("vec_id")
        if not len(asking):
            continue
        a, b = _scaled(asking["vector"]), _scaled(some["vector"])
        for large_a in (False, True):
            for large_b in (False, True):
                x = np.flatnonzero((abs(a) > largest(n)).any(1) == large_a)
                y = np.flatnonzero((abs(b) > largest(n)).any(1) == large_b)
                for at in range(0, len(x) if len(y) else 0, ROWS):
                    z = x[at : at + ROWS]
                    yield asking.iloc[z], some.iloc[y], packed_products(a[z], b[y])


def _grid(anchors: pd.DataFrame, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Whether the labels of anchors and rows are equal, and whether they are different rows."""
    same = anchors["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]
    return same, anchors["vec_id"].to_numpy()[:, None] != rows["vec_id"].to_numpy()[None, :]


def positives_in(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    found = [pd.DataFrame(columns=["anchor_id", "positive_id", "score"])]
    for a, some, scores in _parts(rows, anchors):
        same, other = _grid(a, some)
        i, j = best(scores, same & other, POSITIVES)
        found.append(
            pd.DataFrame({"anchor_id": a["vec_id"].to_numpy()[i], "positive_id": some["vec_id"].to_numpy()[j], "score": _text(scores[i, j])})
        )
    return pd.concat(found[1:] or found)


def negatives_in(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    found = [pd.DataFrame(columns=["anchor_id", "positive_id", "positive_score", "negative_id", "score"])]
    for a, some, scores in _parts(rows, anchors):
        same, other = _grid(a, some)
        ids, negative_ids = a["vec_id"].to_numpy(), some["vec_id"].to_numpy()
        for k in range(POSITIVES):
            at = np.flatnonzero(a["positives"].map(len).to_numpy() > k)
            if not len(at):
                break
            goal = np.array([p[k] for p in a["positives"].iloc[at]], np.int64)
            value = np.array([int(s[k]) for s in a["scores"].iloc[at]], object)
            # from the LOW to the HIGH share of the positive's score, as whole numbers
            low, high = -(-LOW * value // 100), HIGH * value // 100
            s = scores[at]
            if s.dtype != object:
                low, high = (np.array([max(-LONG, min(LONG, v)) for v in x], np.int64) for x in (low, high))
            i, j = np.nonzero((~same & other)[at] & (s >= low[:, None]) & (s <= high[:, None]))
            if len(i):
                i, j = _first(i, j, s[i, j], NEGATIVES)
                columns = (ids[at][i], goal[i], _text(value[i]), negative_ids[j], _text(s[i, j]))
                found.append(pd.DataFrame(dict(zip(found[0].columns, columns))))
    return pd.concat(found[1:] or found)


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """``(vec_id, label, vector)`` of the rows that take part, one per vec_id."""
    v = pick(vectors, "vec_id", "embedding", "label")
    v = v.select("vec_id", label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    whole = F.expr(f"forall(vector, x -> x is not null and not isnan(x) and abs({SCALE} * x) < double('infinity'))")
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    return v.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def _ranked(found: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """The ``k`` first of every group by score and id; scores are texts of whole numbers of any length."""
    value = F.col("score")
    sign = F.when(value.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    # a longer number is larger; of equally long ones the texts compare
    size = sign * F.length(value)
    order = [size.desc(), F.when(sign > 0, value).desc(), F.when(sign < 0, value).asc(), F.col(key)]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def _long(c: str) -> Column:
    """A whole number's text as a long; beyond its range, the end of the range."""
    ends = F.when(F.col(c).startswith("-"), F.lit(-LONG - 1)).otherwise(F.lit(LONG))
    return F.coalesce(F.expr(f"try_cast({c} as bigint)"), ends)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on vec_id, ``label`` an expression of the row's label (the column, if not given).
    """
    ship_package(vectors.sparkSession)
    rows = stored(usable(vectors, F.col("label") if label is None else label), "vectors")
    asked = rows.filter(is_anchor)
    parts = partitions_for(asked.count(), anchors)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part")
    ranged = rows.repartitionByRange(partitions_for(rows.count(), block), "label", F.xxhash64("vec_id"))
    dealt = stored(ranged.withColumn("block", F.spark_partition_id()), "blocks")
    held = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "label", "vector")

    own = dealt.select("block", F.col("label").alias("its")).distinct()  # about a row per block and one per label
    to_own = asked.join(own, F.col("label") == F.col("its")).select("block", part, "vec_id", "label", "vector")
    found = _meet(held, to_own, positives_in, "anchor_id long, positive_id long, score string")
    first = _ranked(found, ["anchor_id"], "positive_id", POSITIVES)
    goals = first.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("p"))
    goals = goals.select("anchor_id", F.col("p.positive_id").alias("positives"), F.col("p.score").alias("scores"))
    goals = stored(asked.join(goals, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "positives")

    last = dealt.agg(F.max("block")).first()[0] or 0
    each = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block")
    to_all = goals.select(each, part, "vec_id", "label", "vector", "positives", "scores")
    schema = "anchor_id long, positive_id long, positive_score string, negative_id long, score string"
    mined = _ranked(_meet(held, to_all, negatives_in, schema), ["anchor_id", "positive_id"], "negative_id", NEGATIVES)
    return mined.select(
        "anchor_id", "positive_id", "rank", "negative_id", _long("positive_score").alias("positive_score"), _long("score").alias("negative_score")
    )


def _meet(held: DataFrame, sent: DataFrame, f, schema: str) -> DataFrame:
    sent = sent.withColumnsRenamed({"block": "to_block", "part": "its_part"})
    sent = sent.toDF(*sent.columns)
    return held.groupBy("block", "part").cogroup(sent.groupBy("to_block", "its_part")).applyInPandas(f, schema)
