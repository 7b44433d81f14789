"""Operator 11: substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words. The words of every window that also
starts anywhere else, in the same document or another, are removed.

Shipping a hash of every window would cost a row per word. Instead, hashes of
``ANCHOR`` words are taken only where a word's number modulo ``PERIOD`` lies
in a difference cover: for any two numbers i and j there is a shift below
``PERIOD`` that takes both into the cover. So two equal windows share an
anchor at the same place inside, since ``ANCHOR + PERIOD - 1 <= WINDOW``.

1. Anchors are counted. One that occurs twice is shared.
2. Shared anchors are extended: the windows that hold one (and only those) are
   hashed whole, with 80 bits, and counted. What occurs twice is repeated.
3. The words of repeated windows are left out of their texts.

How it stays in bounds: a task works through its texts in pieces of ``CHUNK``
bytes. Of every hash a piece sends one row. If the hash occurs several times
in the piece, that row only says so, and the places, which are decided
already, travel with their document instead. So a passage that a third of all
documents hold makes one row per piece, not one per document, and no group of
copies meets anywhere. Rows leave a piece in the order of its texts, so that
the addresses of neighbours compress well. Texts are shuffled once: both joins
use one exchange, whose large partitions adaptive execution can split. Nothing
reaches the driver.

A row is two longs and a text's address, 64 bits of a hash of doc_id and text.
The first long is the hash, of anchors 48 bits (a clash only adds windows to
compare). The second holds the word's number, 16 more bits of the address and 16
more of the window's hash (or, of places known to repeat, how many follow): with 3e12 windows compared, as in 100 TB of which a
fifth repeats, four in all would be taken for repeated by chance.

Defined results: a null, empty or blank text has no words, its kept text is
empty; a text of fewer words than a window is kept whole; repeated rows repeat
each other's windows, and so do rows of one doc_id; rows without doc_id are
treated alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, ship_package, text_or_empty

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # every difference modulo 21 occurs, each but 0 once
ANCHOR = WINDOW - PERIOD + 1
CHUNK = 6 << 20  # bytes of text worked on at a time
SEED = 11

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Words:
    """The words of several texts: their hashes, and how many each text has."""

    rng = np.random.default_rng(SEED)
    letters = rng.integers(0, 2**63, 256, dtype=U) * U(2) + U(1)
    base = int(rng.integers(0, 2**63, dtype=U)) * 2 + 1
    places = rng.integers(0, 2**63, (3, WINDOW), dtype=U) * U(2) + U(1)  # of anchors, of windows, of windows again
    powers = inverse = np.ones(1, U)

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        """``data`` are the bytes of the texts one after the other, ``starts`` their beginnings and the end of the last."""
        blank = SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = True
        first = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:-1]))
        last = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1
        self.owner = np.searchsorted(starts, first, "right") - 1
        self.counts = np.bincount(self.owner, minlength=len(starts) - 1)
        self.begins = np.cumsum(self.counts) - self.counts
        self.number = np.arange(len(first)) - self.begins[self.owner]  # of a word in its text
        # a word's hash is a polynomial in its bytes, from differences of running sums
        self._grow(len(data))
        sums = np.r_[U(0), np.cumsum(self.letters[data] * self.powers[: len(data)], dtype=U)]
        self.hashes = _mixed((sums[last] - sums[first]) * self.inverse[first] + (last - first).astype(U))

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls.powers) <= n:
            step = np.full(n + 1, cls.base, U)
            step[0] = 1
            cls.powers = np.cumprod(step, dtype=U)
            step[1:] = U(pow(cls.base, -1, 2**64))
            cls.inverse = np.cumprod(step, dtype=U)

    def runs(self, at: np.ndarray, length: int, which: int) -> np.ndarray:
        """Hashes of the ``length`` words from each place in ``at``."""
        out = np.zeros(len(at), U)
        for k in range(length):
            out += self.hashes[at + k] * self.places[which, k]
        return _mixed(out)

    def room(self, length: int) -> np.ndarray:
        """Whether ``length`` words of the same text begin at each word."""
        return self.number + length <= self.counts[self.owner]


def _pieces(batches, column: str = "text"):
    """Rows up to ``CHUNK`` bytes of text: (the rows as a table, their words)."""
    for batch in batches:
        text = batch.column(column).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(batch) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(batch):
            after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
            yield batch.slice(first, after - first), Words(data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first])
            first = after


def _gathered(batches):
    """Small batches put together to about ``CHUNK`` bytes, so that pieces are as large as they may be."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (whole := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield whole[0]


ASKED = "key long, tail long, text_key long"
KNOWN = 2**31  # marks a place that is known to repeat
RUN = 2**16  # such places in a row at most


def _asked(rows: pa.RecordBatch, words: Words, at: np.ndarray, key: np.ndarray, tag: np.ndarray, checked: bool) -> pa.RecordBatch:
    """One row per distinct (key, tag) of a piece, without an address if the piece has it several times.

    And one row for every run of places that are known to repeat by that. ``at`` ascends.
    """
    order = np.lexsort((tag, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (tag[order][1:] != tag[order][:-1])] if len(at) else np.zeros(0, bool)
    times = np.diff(np.r_[np.flatnonzero(new), len(at)])
    single, head = np.zeros(len(at), bool), np.zeros(len(at), bool)
    single[order] = np.repeat(times == 1, times)
    head[order] = new
    asked, known = np.flatnonzero(head), np.flatnonzero(~single)
    owner = words.owner[at]
    follows = (at[known][1:] == at[known][:-1] + 1) & (owner[known][1:] == owner[known][:-1]) if len(known) else np.zeros(0, bool)
    begin = np.flatnonzero(np.r_[np.ones(min(1, len(known)), bool), ~follows])
    length = np.diff(np.r_[begin, len(known)])
    times = -(-length // RUN)  # longer runs are cut
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    more = np.minimum(RUN, np.repeat(length, times) - nth * RUN) - 1
    known = known[np.repeat(begin, times) + nth * RUN]
    # rows in the order of texts: what is asked, then what is known
    which = np.r_[asked, known]
    check = rows.column("check").to_numpy(zero_copy_only=False).astype(U)[owner[which]] if checked else np.zeros(len(which), U)
    places = words.number[at[which]].astype(U) | np.where(np.arange(len(which)) < len(asked), U(0), U(KNOWN))
    tail = np.r_[tag[asked], more.astype(U)] << U(48) | check << U(32) | places
    keys = np.r_[key[asked], _mixed(owner[known].astype(U) + key[known])]  # only deals the second kind out
    of = pa.array(owner[which], mask=np.r_[~single[asked], np.zeros(len(known), bool)])
    columns = [pa.array(keys.view(np.int64)), pa.array(tail.view(np.int64)), rows.column("text_key").take(of)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "tail", "text_key"])


def anchor_batches(batches):
    """(doc_id, text_key, check, text) to the anchors at cover places."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for rows, words in _pieces(_gathered(batches)):
        at = np.flatnonzero(cover[words.number % PERIOD] & words.room(ANCHOR))
        yield _asked(rows, words, at, words.runs(at, ANCHOR, 0) >> U(16), np.zeros(len(at), U), False)


def _flat(rows: pa.RecordBatch, words: Words) -> np.ndarray:
    """The places of all texts' lists ``places`` as numbers of words in the piece."""
    lists = rows.column("places")
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(words.begins, sizes)


def window_batches(batches):
    """(doc_id, text_key, check, text, places of shared anchors) to the windows that hold one."""
    for rows, words in _pieces(_gathered(batches)):
        anchors = _flat(rows, words)
        begin = np.maximum(anchors - PERIOD + 1, words.begins[words.owner[anchors]])
        step = np.zeros(len(words.number) + 1, np.int64)
        np.add.at(step, begin, 1)
        np.add.at(step, anchors + 1, -1)
        at = np.flatnonzero((np.cumsum(step[:-1]) > 0) & words.room(WINDOW))
        yield _asked(rows, words, at, words.runs(at, WINDOW, 1), words.runs(at, WINDOW, 2) >> U(48), True)


def kept_batches(batches):
    """(doc_id, text, places of repeated windows) to (doc_id, n_words, n_removed, kept)."""
    for rows, words in _pieces(batches):
        starts = _flat(rows, words)
        step = np.zeros(len(words.number) + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + WINDOW, -1)
        keep = np.cumsum(step[:-1]) == 0
        left = np.bincount(words.owner[keep], minlength=len(rows))
        kept = []
        for i, text in enumerate(rows.column("text")):
            begin, n = words.begins[i], words.counts[i]
            parts = text.as_py().encode().split() if left[i] else []  # bytes are split at exactly the blanks of the rule
            kept.append(b" ".join(parts if left[i] == n else compress(parts, keep[begin : begin + n])).decode())
        columns = [rows.column("doc_id"), pa.array(words.counts), pa.array(words.counts - left), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])


def _repeated(asked: DataFrame, anchors: bool = False) -> DataFrame:
    """``(of, its_check, places)`` from rows as in ``ASKED``: of every text the places that occur twice or more.

    The check is left out for anchors.
    """
    # dealt by the key alone, so that what is made of the tail need not be shuffled
    dealt = asked.repartition("key").withColumns({"tag": F.expr("shiftrightunsigned(tail, 48)"), "known": F.expr(f"tail & {KNOWN} != 0")})
    times = F.sum(F.expr("if(known, 0, if(text_key is null, 2, 1))")).over(Window.partitionBy("key", "tag"))
    found = dealt.withColumn("total", times).filter("text_key is not null and (known or total > 1)")
    check = F.lit(0) if anchors else F.expr("cast(shiftrightunsigned(tail, 32) & 65535 as int)")
    first = f"cast(tail & {KNOWN - 1} as int)"
    places = F.expr(f"explode(sequence({first}, {first} + if(known, cast(tag as int), 0)))")
    each = found.select(F.col("text_key").alias("of"), check.alias("its_check"), places.alias("place"))
    return each.groupBy("of", "its_check").agg(F.collect_set("place").alias("places"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept``, the words kept joined by single blanks."""
    ship_package(docs.sparkSession)
    d = pick(docs, "doc_id", "text").withColumn("text", text_or_empty())
    d = d.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), F.hash("doc_id", "text").bitwiseAND(65535).alias("check"), "text")
    columns = [*d.columns, "places"]
    own = F.col("text_key") == F.col("of")
    # told as a difference, so that both joins deal texts by text_key only
    same = F.col("check") - F.col("its_check") == 0
    shared = _repeated(d.mapInArrow(anchor_batches, ASKED), anchors=True)
    held = d.join(shared, own).select(columns)
    repeated = _repeated(held.mapInArrow(window_batches, ASKED))
    both = d.join(repeated, own & same, "left").select(columns)
    return both.mapInArrow(kept_batches, "doc_id long, n_words long, n_removed long, kept string")
