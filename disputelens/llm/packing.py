"""Operator 9: packing token sequences by first-fit decreasing with a tournament tree.

Documents are dealt into random groups of bounded mean size by a hash, and
every group is packed on its own in one task. A document longer than a
sequence fills whole sequences; its rest is a piece. Pieces go, longest first,
into the first sequence with room, found in a tree over the sequences' free
room that holds the maximum of every subtree. Then free room of ``MIN_PIECE``
or more is filled by cutting the pieces of the emptiest sequences, and the one
sequence left over is cut into sequences of a power of two, which need no
padding.

Groups depend on doc_id, text and the row's place in its input partition, so
rows that repeat one document are spread over the groups like any others, and a
task that is run again on a stored table gives the same rows. Ids travel to
their group once, two bytes each.

Defined results: a null or empty text is its end id alone; rows that repeat a
doc_id are packed each on their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, pick, ship_package, text_or_empty
from .tokens import encoder, id_type

LENGTH = 2048
GROUP_DOCS = 256  # mean documents in a group
MIN_PIECE = 16  # free room smaller than this is padded
ROWS = 256  # documents encoded at a time
SEED = 9


class Tournament:
    """Free room of sequences in order; ``first(n)`` is the first one with room for n, in log time."""

    def __init__(self, leaves: int, room: int):
        self.size = 1 << max(0, leaves - 1).bit_length()
        self.tree = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        at = 1
        while at < self.size:
            at *= 2
            at += self.tree[at] < need
        return at - self.size

    def take(self, leaf: int, amount: int) -> None:
        at = leaf + self.size
        self.tree[at] -= amount
        while at > 1:
            at //= 2
            best = max(self.tree[2 * at], self.tree[2 * at + 1])
            if self.tree[at] == best:
                return
            self.tree[at] = best


def pack_lengths(lengths: list[int], length: int = LENGTH, min_piece: int = MIN_PIECE) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), for documents of the given lengths."""
    whole = [[(d, at, length)] for d, n in enumerate(lengths) for at in range(0, n - length + 1, length)]
    rests = [(n % length, d, n - n % length) for d, n in enumerate(lengths) if n % length]
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree, bins = Tournament(len(rests), length), []
    for n, d, at in rests:
        leaf = tree.first(n)
        if leaf == len(bins):
            bins.append([])
        bins[leaf].append((d, at, n))
        tree.take(leaf, n)
    fill = [sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-fill[i], i))
    # the fullest sequences take what they lack from the emptiest
    low, high = 0, len(order) - 1
    while low < high:
        to, source = order[low], order[high]
        room = length - fill[to]
        if room < min_piece:
            low += 1
            continue
        d, at, n = bins[source].pop()
        part = min(n, room)
        bins[to].append((d, at, part))
        if part < n:
            bins[source].append((d, at + part, n - part))
        fill[to] += part
        fill[source] -= part
        if not fill[source]:
            high -= 1
    packed = whole + [b for b in bins if b]
    if low == high and length - fill[order[low]] >= min_piece:
        last = bins[order[low]]
        packed = [b for b in packed if b is not last] + powers(last)
    return packed


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces in sequences whose lengths are powers of two, the largest first."""
    left, out = sum(n for _, _, n in pieces), []
    queue = list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            d, at, n = queue.pop()
            part = min(n, room)
            out[-1].append((d, at, part))
            if part < n:
                queue.append((d, at + part, n - part))
            room -= part
    return out


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, group_docs: int = GROUP_DOCS, min_piece: int = MIN_PIECE
) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers.

    ``sequence_id`` and ``offset`` say where the piece stands; pieces of a
    sequence follow each other without gaps. ``docs`` should be a stored table,
    whose rows keep their places.
    """
    ship_package(docs.sparkSession)
    d = pick(docs, "doc_id", "text").withColumn("text", text_or_empty())
    groups = partitions_for(docs.count(), group_docs)
    key, dtype = F.xxhash64(F.lit(SEED), "doc_id", "text", F.monotonically_increasing_id()), id_type(tokenizer)
    dealt = d.select(key.alias("key"), "doc_id", "text")
    dealt = dealt.select(F.pmod("key", F.lit(groups)).alias("bundle"), "key", "doc_id", "text")

    def encode(batches):
        code = encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), ROWS):  # few texts and ids at a time outside Arrow
                part = batch.slice(at, ROWS)
                ids = [code.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("bundle"), part.column("key"), part.column("doc_id"), pa.array(ids, pa.binary())],
                    names=["bundle", "key", "doc_id", "ids"],
                )

    def pack_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "key"], kind="stable")
        end = np.array([end_id], dtype).tobytes()
        ids = [np.frombuffer(b + end, dtype) for b in frame["ids"]]
        keys, bundle = frame["doc_id"].tolist(), int(frame["bundle"].iloc[0])
        rows = []
        for s, sequence in enumerate(pack_lengths([len(x) for x in ids], length, min_piece)):
            offset = 0
            for d, at, n in sequence:
                rows.append((keys[d], at, n, ids[d][at : at + n].astype("<u4").tobytes(), len(ids[d]), bundle << 32 | s, offset))
                offset += n
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        return out.astype({"doc_id": "Int64"})

    coded = dealt.mapInArrow(encode, "bundle long, key long, doc_id long, ids binary")
    return coded.groupBy("bundle").applyInPandas(pack_group, PIECES)
