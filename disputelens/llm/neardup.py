"""Operator 7: near-duplicate classes by MinHash with tensored banding.

A document's set holds its distinct five-word shingles. Two small collections
of ``HALVES`` half-bands, ``ROWS`` minhashes each, are computed; a table key
combines one half-band of the first collection with one of the second. So
2 x 12 half-bands (48 minhashes) serve 144 tables of four rows, where separate
tables would need 576 minhashes. Two documents are candidates if they share a
key; candidates are confirmed on their full sets, and classes are the connected
components of confirmed links.

At similarity s a link is found with probability (1 - (1 - s^2)^12)^2: 0.9999
at 0.75 and more above; in groups of three or more a missed link is usually
replaced by others.

How it stays in bounds:

* documents with equal sets are one node from the start (their classes count
  through a partial aggregation), so exact copies never meet; a node has a
  number of its own and one representative, its smallest doc_id and text;
* half-bands that only one node has are dropped before keys are combined;
* a key shared by ``STAR_FROM`` nodes or more first links each node with the
  smallest one only, and of these pairs each node keeps the ``BEST_PAIRS``
  sharing most keys; the confirmed ones give most nodes of a large group one
  label;
* keys whose nodes have different labels are looked at again: the nodes
  outside a key's most frequent label are compared with one block (about
  ``BLOCK`` nodes) of the key on sketches of 256 minhashes, and each node's
  ``BEST_PAIRS`` likeliest pairs are confirmed;
* keys that still have different labels after that are put together by their
  first half-band, so a node is sent once for its up to ``HALVES`` keys there;
  each node outside a group's most frequent label is compared with all nodes of
  the group whose size allows a link, and all pairs whose estimated similarity is
  above ``LEAST_ESTIMATE`` are confirmed. They are never listed: the nodes that
  have such a pair are sent once more with their full sets, and a task reports
  the confirmed pairs that join labels not joined yet, fewer than it has nodes.
  A group of more than ``BLOCK`` nodes (or ``HELD`` shingles) is divided into
  cells of two parts of about that size, so no task holds a whole group; of a
  group with n nodes of like size and all of different labels each node is sent
  to n / ``BLOCK`` cells.

So every pair that shares a key is either in one component already, or
compared on full sets, or more than four standard errors below the threshold by
its sketch.

Sets are made anew for the nodes that share a key, from one row of each node's
representative, and stored once; equal rows are put together before texts are
shuffled, once. Links are a few bytes each and are kept in files of about
``LINK_NODES`` nodes, however many tasks found them. Nothing but counts reaches
the driver.

Defined results: a null or empty text, or one of white space only, has an
empty set and is linked with nothing; a row without doc_id is linked with
nothing, its component is null and it is kept; rows that repeat a doc_id each
have the component of their own text, so one text of a doc_id may be kept and
another not (``representative`` tells which text stays for a class); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import COLUMNS, checkpointed, partitions_for, pick, ship_package, stored, text_or_empty
from .components import components, rough_labels

WORDS = 5  # in a shingle
PERCENT = 75  # least similarity of a link
HALVES = 12  # half-bands in each of the two collections
ROWS = 2  # minhashes in a half-band
SKETCH = 256  # minhashes compared before full sets are; the first 2 x HALVES x ROWS make the keys
LEAST_ESTIMATE = 0.75 - 4 * (0.75 * 0.25 / SKETCH) ** 0.5  # four standard errors below the threshold
STAR_FROM = 4
BEST_PAIRS = 3  # that a node keeps of its pairs with stars, or of its likeliest pairs
BLOCK = 512
HELD = 1 << 22  # shingles in a part of a cell
BAND = 1.34  # ratio of sizes within a band; more than 100 / PERCENT, so that similar sets are in the same or neighbouring bands
CHUNK = 1 << 19  # bytes of text worked on at a time; a worker needs about 80 times that besides
LINK_NODES = 100_000  # nodes whose links are kept in one file
LINK_FILES = 4  # at least
SEED = 7
SECOND_BITS = 24  # of a table key, from both its half-bands; the others are from the first one alone

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Shingler:
    """Shingle sets and minhashes of UTF-8 texts, many texts at a time."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        draw = lambda n: rng.integers(0, 2**63, n, dtype=U) * U(2) + U(1)
        lower = np.arange(256)
        lower[ord("A") : ord("Z") + 1] += 32
        self.values = draw(256)[lower]  # of bytes, capital letters like small ones
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.base = int(draw(1)[0])
        self.places = draw(WORDS)
        self.factors, self.terms = draw(SKETCH), draw(SKETCH)
        self.powers = self.inverse = np.zeros(0, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            step = np.full(n + 1, self.base, U)
            step[0] = 1
            self.powers = np.cumprod(step, dtype=U)
            step[1:] = U(pow(self.base, -1, 2**64))
            self.inverse = np.cumprod(step, dtype=U)

    def sets(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct shingles of all documents, sorted in each; and each document's count.

        ``data`` are the bytes of the texts one after the other, ``starts``
        their beginnings and the end of the last.
        """
        docs, n = len(starts) - 1, len(data)
        if not n:
            return np.zeros(0, U), np.zeros(docs, np.int64)
        self._grow(n)
        blank = self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        first = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:-1]))
        last = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1
        # a word's hash is a polynomial in its bytes, from differences of running sums
        sums = np.r_[U(0), np.cumsum(self.values[data] * self.powers[:n], dtype=U)]
        words = mix((sums[last] - sums[first]) * self.inverse[first] + (last - first).astype(U))
        owner = np.searchsorted(starts, first, "right") - 1
        counts = np.bincount(owner, minlength=docs)
        if len(words) >= WORDS:
            m = len(words) - WORDS + 1
            hashes = sum(words[i : i + m] * self.places[i] for i in range(WORDS))
            inside = owner[:m] == owner[WORDS - 1 :]
            hashes, of = mix(hashes[inside]), owner[:m][inside]
        else:
            hashes, of = np.zeros(0, U), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        if len(short):
            at = np.searchsorted(owner, short)
            whole = [(words[a : a + k] * self.places[:k]).sum(dtype=U) for a, k in zip(at, counts[short])]
            hashes = np.r_[hashes, mix(np.array(whole, U) + counts[short].astype(U))]
            of = np.r_[of, short]
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])] if len(of) else np.zeros(0, bool)
        return hashes[new], np.bincount(of[new], minlength=docs)

    def minhashes(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``SKETCH`` minhashes of every document that has shingles, 32 bits each."""
        at = np.cumsum(counts[counts > 0]) - counts[counts > 0]
        out = np.empty((len(at), SKETCH), np.uint32)
        for j in range(SKETCH if len(at) else 0):
            out[:, j] = np.minimum.reduceat((hashes * self.factors[j] + self.terms[j]) >> U(32), at)
        return out


_SHINGLER: list[Shingler] = []


def _shingler() -> Shingler:
    if not _SHINGLER:
        _SHINGLER.append(Shingler())
    return _SHINGLER[0]


def _chunks(column: pa.Array):
    """Pieces of a text column: (first document, bytes, starts)."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        first = after


def signature_batches(batches):
    """(doc_id, text_key, text) to (doc_id, text_key, n_shingles, key_a, key_b, halves, sketch)."""
    shingler = _shingler()
    for batch in batches:
        n = len(batch)
        counts, keys = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
        halves, sketches = np.zeros((n, 2 * HALVES), np.int64), np.zeros((n, SKETCH), np.uint8)
        for first, data, starts in _chunks(batch.column("text")):
            hashes, some = shingler.sets(data, starts)
            full = first + np.flatnonzero(some)
            counts[first : first + len(some)] = some
            if not len(full):
                continue
            at = np.cumsum(some[some > 0]) - some[some > 0]
            keys[full, 0] = np.add.reduceat(mix(hashes + U(1)), at).view(np.int64)
            keys[full, 1] = np.bitwise_xor.reduceat(mix(hashes + U(2)), at).view(np.int64)
            low = shingler.minhashes(hashes, some)
            sketches[full] = low.astype(np.uint8)
            bands = low[:, : 2 * HALVES * ROWS].astype(U).reshape(len(full), 2 * HALVES, ROWS)
            code = np.broadcast_to(np.arange(1, 2 * HALVES + 1, dtype=U), bands.shape[:2])
            for r in range(ROWS):
                code = mix(code + bands[:, :, r] * U(0x9E3779B97F4A7C15))
            halves[full] = code.view(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(0, 2 * HALVES * n + 1, 2 * HALVES, dtype=np.int32), halves.ravel())
        binary = pa.array([s.tobytes() for s in sketches], pa.binary())
        ids = [batch.column("doc_id"), batch.column("text_key")]
        columns = [*ids, pa.array(counts), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists, binary]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "key_a", "key_b", "halves", "sketch"])


def set_batches(batches):
    """(node, text) to (node, members): the sorted hashes of the full set."""
    shingler = _shingler()
    for batch in batches:
        for first, data, starts in _chunks(batch.column("text")):
            hashes, counts = shingler.sets(data, starts)
            members = pa.array([x.tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, len(counts)), members], names=["node", "members"])


def linked_batches(batches):
    """(a, b, members_a, members_b) to the pairs (a, b) that are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("members_a"), batch.column("members_b")):  # not all as Python objects at once
            x, y = (np.frombuffer(m.as_buffer(), U) for m in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def cells(batches):
    """Rows sorted by (key, block) as tables that hold every key and block whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        key, block = batch["key"].to_numpy(), batch["block"].to_numpy()
        new = np.flatnonzero((key != key[-1]) | (block != block[-1]))
        cut = int(new[-1]) + 1 if len(new) else 0
        # the last key and block may go on in the next batch
        if cut:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks()
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def candidates(rows: pa.Table, best: bool):
    """Pairs of different labels that may be similar, in pieces: places of a (ascending) and b in ``rows``, likeness of the sketches.

    ``best`` keeps only the likeliest partner of each probe in each key and
    block; else every pair comes once, by the first half-band it shares.
    """
    node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
    probe, member = rows["probe"].to_numpy(), rows["member"].to_numpy()
    sizes = rows["n_shingles"].to_numpy()
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
    key, block = rows["key"].to_numpy(), rows["block"].to_numpy()
    codes = rows["halves"].combine_chunks()
    ends = np.r_[0, np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))]
    codes = codes.flatten().to_numpy()
    cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]), True])
    for lo, hi in zip(cut[:-1], cut[1:]):
        own = np.arange(lo, hi)
        members, probes = own[member[lo:hi]], own[probe[lo:hi]]
        for at in range(0, len(probes), BLOCK):
            p = probes[at : at + BLOCK]
            same = (sketch[p][:, None, :] == sketch[members][None, :, :]).mean(2)
            small = np.minimum(sizes[p][:, None], sizes[members][None, :])
            large = np.maximum(sizes[p][:, None], sizes[members][None, :])
            good = (same >= LEAST_ESTIMATE) & (100 * small >= PERCENT * large) & (label[p][:, None] != label[members][None, :])
            if best and len(members):
                same = np.where(good, same, -1)
                good &= np.arange(len(members)) == same.argmax(1)[:, None]
            i, j = np.nonzero(good)
            a, b = p[i], members[j]
            if not best and len(a):
                # a pair belongs to the first of its groups only: the one before which it shares no half-band
                before = codes[ends[lo] : ends[hi]].reshape(hi - lo, -1)
                once = ~(before[a - lo] == before[b - lo]).any(1) & ~(probe[a] & probe[b] & (node[a] > node[b]))
                a, b, i, j = a[once], b[once], i[once], j[once]
            yield a, b, same[i, j]


def compared_batches(batches, best: bool):
    """Rows of (key, block), sorted by them, to their ``candidates`` as pairs (a, b, same)."""
    for rows in cells(batches):
        node, found = rows["node"].to_numpy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *candidates(rows, best)]
        i, j, same = (np.concatenate([f[k] for f in found]) for k in (0, 1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(same)], names=["a", "b", "same"])


def in_pairs(batches):
    """Rows of (key, block), sorted by them, to those that are in one of the ``candidates`` there."""
    for rows in cells(batches):
        keep = np.zeros(len(rows), bool)
        for a, b, _ in candidates(rows, best=False):
            keep[a] = keep[b] = True
        yield from rows.filter(pa.array(keep)).to_batches()


def joining_batches(batches):
    """Rows of (key, block), sorted by them, with ``members``, to the pairs (a, b) that join their labels.

    All ``candidates`` are compared on full sets, unless links found before
    join their labels already; links that join nothing new are left out.
    """
    for rows in cells(batches):
        node, sizes = rows["node"].to_numpy(), rows["n_shingles"].to_numpy()
        members = [np.frombuffer(x, U) for x in rows["members"].to_pylist()]
        joined = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
        links = []
        for i, j, _ in candidates(rows, best=False):
            cut = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else []
            for lo, hi in zip(cut[:-1], cut[1:]):
                a, others = i[lo], j[lo:hi]
                others = others[joined[others] != joined[a]]
                if not len(others):
                    continue
                has, ours = np.concatenate([members[b] for b in others]), members[a]
                hit = ours[np.minimum(np.searchsorted(ours, has), len(ours) - 1)] == has
                both = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes[others])[:-1]], dtype=np.int64)
                for b in others[100 * both >= PERCENT * (sizes[a] + sizes[others] - both)]:
                    if joined[b] != joined[a]:
                        joined[joined == joined[b]] = joined[a]
                        links.append((node[a], node[b]))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("members_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("members_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "members_a", "members_b").mapInArrow(linked_batches, "a long, b long")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """``(node, key, nth)`` for every table key that two nodes or more have; ``nth`` is the table."""
    each = nodes.select("node", F.posexplode("halves").alias("nth", "half"))
    often = each.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half")
    left = each.join(often, "half", "left_semi").groupBy("node").agg(F.collect_list(F.struct("nth", "half")).alias("have"))
    side = lambda test: F.filter("have", test)
    sides = left.select("node", side(lambda h: h["nth"] < HALVES).alias("xs"), side(lambda h: h["nth"] >= HALVES).alias("ys"))
    keys = sides.select("node", "ys", F.explode("xs").alias("x")).select("node", "x", F.explode("ys").alias("y"))
    nth = F.col("x.nth") * HALVES + F.col("y.nth") - HALVES
    key = F.expr(f"(xxhash64(x.half) & {-1 << SECOND_BITS}L) | (xxhash64(x.half, y.half) & {(1 << SECOND_BITS) - 1}L)")
    keys = keys.select("node", key.alias("key"), nth.alias("nth"))
    common = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return keys.join(common, "key", "left_semi")


def _first(pairs: DataFrame, by) -> DataFrame:
    """The ``BEST_PAIRS`` first pairs (a, b) of every a."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(by, "b"))
    return pairs.withColumn("r", rank).filter(F.col("r") <= BEST_PAIRS).select("a", "b")


def star_pairs(keys: DataFrame) -> DataFrame:
    """Each node with the smallest nodes of its larger keys that share most keys with it."""
    stars = keys.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= STAR_FROM)
    met = keys.join(stars.select("key", "b"), "key").filter("node != b")
    return _first(met.groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("votes")), F.desc("votes"))


def _shingles():
    """At most as many shingles as the ``n`` nodes of a size band have."""
    return F.col("n") * F.pow(F.lit(BAND), F.col("band") + 1)


def _parts(n, shingles):
    return F.ceil(F.greatest(n / BLOCK, shingles / HELD))


def divided(rows: DataFrame, per: DataFrame, mixed: DataFrame) -> DataFrame:
    """``rows`` of mixed keys, each once for every cell it is compared in: with ``block``, ``probe`` and ``member``.

    A key of up to ``BLOCK`` nodes, and ``HELD`` shingles, is one cell. In a larger
    one the nodes of a size band, probes and others apart, form parts of about
    that size; a cell compares one part of probes with another part, or with itself. Bands
    are a little wider than the largest ratio of sizes that links allow, so
    only neighbouring bands meet and no link is lost.
    """
    large = mixed.filter("parts > 1").select("key", "main")
    probe = (F.col("label") != F.col("main")).alias("probe")
    parts = per.join(large, "key").groupBy("key", "band", probe).agg(_parts(F.sum("n"), F.sum(_shingles())).alias("parts"))
    parts = parts.select("key", F.struct("band", "probe", "parts").alias("u"))
    rows = rows.join(parts.groupBy("key").agg(F.collect_list("u").alias("units")), "key", "left")  # two for each band at most
    own = "element_at(filter(units, u -> u.band = band and u.probe = probe), 1).parts"
    rows = rows.withColumn("own", F.expr(f"named_struct('band', band, 'probe', probe, 'part', pmod(xxhash64(node, key), {own}))"))
    others = F.expr(
        "flatten(transform(filter(units, u -> abs(u.band - band) <= 1 and (probe or u.probe)), u -> "
        "transform(sequence(0L, u.parts - 1), i -> named_struct('band', u.band, 'probe', u.probe, 'part', i))))"
    )
    # of two parts of probes the nodes of the first are the cell's probes
    first = F.expr("transform(others, o -> named_struct('o', o, 'probe', probe and (not o.probe or own <= o)))")
    cells = F.expr(
        "transform(others, c -> named_struct('block', if(c.probe, xxhash64(own, c.o), xxhash64(c.o, own)), "
        "'probe', c.probe, 'member', not c.probe or own = c.o))"
    )
    whole = F.expr("array(named_struct('block', 0L, 'probe', probe, 'member', true))")
    rows = rows.withColumn("others", others).withColumn("others", first).withColumn("others", cells)
    rows = rows.withColumn("c", F.explode(F.when(F.col("units").isNull(), whole).otherwise(F.col("others"))))
    return rows.select("key", "nth", "node", "label", "c.*")


def most_frequent(per: DataFrame) -> DataFrame:
    """``(key, main, blocks, parts)`` of the keys whose nodes have several labels, from counts by key, label and band."""
    mixed = per.groupBy("key", "label").agg(F.sum("n").alias("n"), F.sum(_shingles()).alias("shingles")).groupBy("key")
    sums = [F.sum("n").alias("n"), F.sum("shingles").alias("shingles")]
    mixed = mixed.agg(*sums, F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("main"))
    blocks, parts = F.ceil(F.col("n") / BLOCK).alias("blocks"), _parts(F.col("n"), F.col("shingles")).alias("parts")
    return mixed.filter("labels > 1").select("key", F.col("main.label").alias("main"), blocks, parts)


def by_first_half(placed: DataFrame) -> DataFrame:
    """The nodes of keys with several labels, by the first half-band of these keys: ``key`` is its number, ``nth`` its place.

    Two nodes of a key with several labels meet at every first half-band that
    they share, since their second one makes a key with it too.
    """
    several = placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("key")
    table = F.floor(F.col("nth") / HALVES).cast("int")
    key = F.shiftright("key", SECOND_BITS) * HALVES + table
    group = placed.join(several, "key", "left_semi").select("node", "label", "band", table.alias("nth"), key.alias("key"))
    return group.dropDuplicates(["key", "node"])


def dealt(keys: DataFrame, labels: DataFrame, nodes: DataFrame, best: bool) -> DataFrame:
    """The nodes of keys with several labels, by the key (or first half-band) and block they are compared in.

    ``best``: one block of each of a node's keys in the tables that combine
    half-bands of the same number (a twelfth of all tables); else all cells.
    """
    if best:
        keys = keys.filter(F.floor(F.col("nth") / HALVES) == F.col("nth") % HALVES)
    band = F.floor(F.log("n_shingles") / math.log(BAND))
    known = nodes.select("node", band.alias("band")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = keys.join(known, "node")
    placed = placed if best else stored(by_first_half(placed), "mixed")
    per = placed.groupBy("key", "label", "band").agg(F.count(F.lit(1)).alias("n"))
    mixed = most_frequent(per)
    rows = placed.join(mixed, "key").withColumn("probe", F.col("label") != F.col("main"))
    # 31 bits of each first half-band tell which ones a pair shares; those before the group's own one are sent along
    codes = F.transform(F.slice("halves", 1, HALVES), lambda h: h.bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    codes = F.array().cast("array<int>") if best else codes
    if best:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks"))).withColumn("member", F.lit(True))
    else:
        rows = divided(rows, per, mixed)
    rows = rows.join(nodes.select("node", "n_shingles", codes.alias("halves"), "sketch"), "node")
    if not best:
        rows = rows.withColumn("halves", F.slice("halves", F.lit(1), F.col("nth")))
    return together(rows.select("key", "block", "node", "label", "probe", "member", "n_shingles", "halves", "sketch"))


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block")


def other_pairs(keys: DataFrame, labels: DataFrame, nodes: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) that share a key, have different labels, and may be similar by their sketches.

    ``best``: only the likeliest pairs of each node (this only shortens the
    next step); else all pairs, whose number grows with the square of a group.
    """

    def compare(batches):
        return compared_batches(batches, best)

    found = dealt(keys, labels, nodes, best).mapInArrow(compare, "a long, b long, same double")
    if best:
        return _first(found.groupBy("a", "b").agg(F.max("same").alias("same")), F.desc("same"))
    return found.select("a", "b")


def other_links(keys: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed pairs (a, b) that join what all ``other_pairs`` with similar full sets join, fewer than the nodes compared."""
    rows = dealt(keys, labels, nodes, best=False)
    rows = rows.mapInArrow(in_pairs, rows.schema)
    return together(rows.join(sets, "node")).mapInArrow(joining_batches, "a long, b long")


def node_sets(d: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, members)``, one row for each node in ``wanted`` (node, doc_id, text_key), from the texts in ``d``.

    Equal rows are one before they are shuffled, so a much repeated row is one
    row of each task.
    """
    once = d.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    w = wanted.select("node", F.col("doc_id").alias("id"), F.col("text_key").alias("of"))
    texts = once.join(w, (F.col("doc_id") == F.col("id")) & (F.col("text_key") == F.col("of")))
    return texts.select("node", "text").mapInArrow(set_batches, "node long, members binary")


def linked(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, n_shingles, component_id, kept, representative``.

    ``text_key`` is the xxhash64 of the text (null: empty). ``representative``
    holds for the one doc_id and text that stays of a class, and for rows that
    are linked with nothing.
    """
    ship_package(docs.sparkSession)
    d = pick(docs, "doc_id", "text").withColumn("text", text_or_empty())
    d = d.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    signed = "doc_id long, text_key long, n_shingles long, key_a long, key_b long, halves array<long>, sketch binary"
    signs = stored(d.mapInArrow(signature_batches, signed), "signatures")
    real = signs.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # one node per distinct set; its other columns are the same in all its rows
    nodes = real.groupBy("key_a", "key_b").agg(
        F.min(F.struct("doc_id", "text_key")).alias("own"), *[F.first(c).alias(c) for c in ("n_shingles", "halves", "sketch")]
    )
    # sorted, so that reruns number alike
    numbered = nodes.sortWithinPartitions("key_a", "key_b").withColumn("node", F.monotonically_increasing_id())
    nodes = stored(numbered.select("node", "key_a", "key_b", "own.*", "n_shingles", "halves", "sketch"), "nodes")
    files = max(LINK_FILES, partitions_for(nodes.count(), LINK_NODES))
    keys = stored(shared_keys(nodes), "keys")
    wanted = nodes.select("node", "doc_id", "text_key").join(keys.select("node").distinct(), "node", "left_semi")
    sets = stored(node_sets(d, wanted), "sets")
    stars = checkpointed(confirmed(star_pairs(keys), sets), files)
    near = stars.unionByName(confirmed(other_pairs(keys, rough_labels(stars, parts=files), nodes, best=True), sets))
    near = checkpointed(near, files)
    rest = other_links(keys, rough_labels(near, 2, files), nodes, sets)
    final = components(near.unionByName(rest), files)
    light = nodes.select("node", "key_a", "key_b", F.struct("doc_id", "text_key").alias("own"))
    in_class = light.join(final, "node", "left").select("key_a", "key_b", "own", F.coalesce("label", "node").alias("label"))
    least = in_class.groupBy("label").agg(F.min("own").alias("first"))
    named = in_class.join(least, "label").select("key_a", "key_b", "first")
    out = signs.drop("halves", "sketch").join(named, ["key_a", "key_b"], "left")
    has_class = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(has_class, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "text_key",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        (~has_class | (F.struct("doc_id", "text_key") == F.col("first"))).alias("representative"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    return linked(docs).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each class, with the columns of ``documents``.

    Which rows go is decided by text, so a doc_id with two texts may lose one
    of them. Rows that repeat doc_id and text are one; of different values in
    their other columns the smallest stay. Rows without doc_id and those
    without words are linked with nothing and stay.
    """
    found = linked(docs).filter(~F.col("representative")).select("doc_id", "text_key").distinct()
    gone = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_of"))
    d = pick(docs, *COLUMNS).withColumn("_key", F.xxhash64(text_or_empty()))
    rest = F.struct("lang", "source", "n_chars", "text")
    once = d.groupBy("doc_id", "_key").agg(F.min(rest).alias("_row"))
    left = once.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_of")), "left_anti")
    return left.select("doc_id", "_row.*").select(*COLUMNS)
