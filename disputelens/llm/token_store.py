"""Operator 3: token ids in binary shards with a minimal perfect hash index.

Documents are range-partitioned by doc_id, then a hash of the text, then the
row's place in its input partition, so that rows without doc_id, of one doc_id
or all alike fill many shards. Each partition becomes one shard file, written by
its task to the shared folder under a temporary name and then renamed, so a task
that is run again leaves one whole file.

A shard file holds, little-endian:

    magic 8 bytes | documents u32 | buckets u32 | bytes per id u32 | seed u32 | ids u64
    pilot  i32 per bucket       how the bucket's keys are displaced
    check  u32 per slot         fingerprint of the key in the slot
    offset u64, length u32 per slot   the document's ids in the payload
    key    i64, nth u32, null u8 per document, in doc_id order
    payload                     raw ids of all documents

``TokenShard.find`` hashes a key to its bucket, displaces it by the bucket's
pilot to its slot, and compares the fingerprint: constant time, and no slot is
free. ``nth`` numbers the rows of a doc_id within a shard. A manifest (Parquet,
one row per shard) has the shards' order, key range, sizes, and what lies before
each; its running sums are taken within chunks of shards and then over chunks.
``fetch`` finds the shard of a row in the manifest and reads a few bytes of it.

Defined results: a null or empty text is its end id alone; documents without
doc_id come first; rows that repeat a doc_id are kept apart by their number, in
order of a hash of their text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_for, pick, ship_package, text_or_empty
from .tokens import encoder

MAGIC = b"TOKSHRD1"
HEAD = "<8sIIIIQ"
SHARD_DOCS = 4096  # mean documents in a shard
SHARDS_READ = 8  # shards a task reads, where there are more than cores
BUCKET_KEYS = 4  # mean keys in a bucket of the hash index


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, nth: np.ndarray, null: np.ndarray, seed: int) -> np.ndarray:
    base = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 2 + 1))
    return mix(base ^ (nth.astype(np.uint64) << np.uint64(1)) ^ null.astype(np.uint64))


def slot_of(hashes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """A negative pilot names the slot of a bucket's only key; any other displaces the hash."""
    moved = mix(hashes + pilots.astype(np.uint64)) % np.uint64(n)
    return np.where(pilots < 0, -pilots.astype(np.int64) - 1, moved.astype(np.int64))


def build_index(hashes: np.ndarray) -> np.ndarray | None:
    """Pilots of a minimal perfect hash, largest buckets first; None if two keys hash alike."""
    n = len(hashes)
    buckets = max(1, -(-n // BUCKET_KEYS))
    if len(np.unique(hashes)) < n:
        return None
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    sizes = np.diff(starts)
    pilots, free = np.zeros(buckets, np.int32), np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = hashes[order[starts[b] : starts[b + 1]]]
        for first in range(0, 1 << 24, 64):
            tried = np.arange(first, first + 64, dtype=np.uint64)
            slots = (mix(own[None, :] + tried[:, None]) % np.uint64(n)).astype(np.int64)
            fits = free[slots].all(1)
            if len(own) > 1:
                ranked = np.sort(slots, 1)
                fits &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if fits.any():
                at = int(fits.argmax())
                pilots[b] = first + at
                free[slots[at]] = False
                break
        else:
            return None
    single = np.flatnonzero(sizes == 1)
    pilots[single] = -np.flatnonzero(free).astype(np.int32) - 1
    return pilots


def shard_bytes(keys: np.ndarray, null: np.ndarray, documents: list[bytes], width: int) -> bytes:
    n = len(documents)
    same = np.r_[False, (keys[1:] == keys[:-1]) & (null[1:] == null[:-1])] if n else np.zeros(0, bool)
    starts = np.flatnonzero(~same)
    nth = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n])) if n else np.zeros(0, np.int64)
    for seed in range(1 << 10):
        hashes = key_hash(keys, nth, null, seed)
        pilots = build_index(hashes)
        if pilots is not None:
            break
    else:
        raise RuntimeError("no perfect hash found")
    slots = slot_of(hashes, pilots[((hashes >> np.uint64(32)) % np.uint64(len(pilots))).astype(np.int64)], n)
    lengths = np.array([len(d) // width for d in documents], np.uint32)
    offsets = np.r_[0, np.cumsum(lengths[:-1], dtype=np.uint64)].astype("<u8") if n else np.zeros(0, "<u8")
    check, offset, length = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u4")
    check[slots], offset[slots], length[slots] = (mix(~hashes) & np.uint64(0xFFFFFFFF)).astype("<u4"), offsets, lengths
    head = struct.pack(HEAD, MAGIC, n, len(pilots), width, seed, int(lengths.sum()))
    index = [pilots.astype("<i4"), check, offset, length, keys.astype("<i8"), nth.astype("<u4"), null.astype("u1")]
    return b"".join([head, *(x.tobytes() for x in index), *documents])


class TokenShard:
    """A shard file's content, with keyed access to the ids of its documents."""

    def __init__(self, content: bytes):
        magic, self.n, buckets, self.width, self.seed, self.ids = struct.unpack_from(HEAD, content)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)

        def section(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, count, at)
            at += out.nbytes
            return out

        n = self.n
        self.pilots, self.check = section("<i4", buckets), section("<u4", n)
        self.offset, self.length = section("<u8", n), section("<u4", n)
        self.keys, self.nth, self.null = section("<i8", n), section("<u4", n), section("u1", n)
        self.payload = section(f"<u{self.width}", self.ids)

    def find(self, keys: np.ndarray, nth: np.ndarray, null: np.ndarray) -> np.ndarray:
        """The slots of keys, or -1 where the fingerprint differs."""
        if not self.n:
            return np.full(len(keys), -1)
        hashes = key_hash(keys, nth, null, self.seed)
        bucket = ((hashes >> np.uint64(32)) % np.uint64(len(self.pilots))).astype(np.int64)
        slots = slot_of(hashes, self.pilots[bucket], self.n)
        inside = (slots >= 0) & (slots < self.n)
        slots = np.where(inside, slots, 0)
        known = inside & (self.check[slots] == (mix(~hashes) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        return np.where(known, slots, -1)

    def get(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of one document, or None if it is not here."""
        slot = int(self.find(np.array([key or 0]), np.array([nth]), np.array([key is None]))[0])
        return None if slot < 0 else self.at(slot)

    def at(self, slot: int) -> np.ndarray:
        start = int(self.offset[slot])
        return self.payload[start : start + int(self.length[slot])]


PARTS = "shard int, file string, documents long, ids long, nulls long, first_key long, last_key long, last_count long"
MANIFEST = PARTS + ", documents_before long, base long"
CHUNK = 4096  # shards whose sums one task adds up


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode, append ``end_id`` to each document, write shards below ``path``; returns the manifest.

    ``docs`` should be a stored table or another plan whose rows keep their places.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shards = partitions_for(docs.count(), shard_docs)
    d = pick(docs, "doc_id", "text").withColumn("text", text_or_empty())
    order = ["doc_id", "text_hash", "row"]
    d = d.withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = d.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def save(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        code, keys, null, documents = encoder(tokenizer), [], [], []
        end = np.array([end_id], code.dtype).tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            keys.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
            null.append(ids.is_null().to_numpy(zero_copy_only=False))
            documents += [code.encode(t) + end for t in batch.column("text").to_pylist()]
        if not documents:
            return
        keys, null = np.concatenate(keys).astype(np.int64), np.concatenate(null)
        width = np.dtype(code.dtype).itemsize
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:08d}.tok"
        store, folder = fs.FileSystem.from_uri(f"{path}/shards")
        store.create_dir(folder, recursive=True)
        part = f"{folder}/_part-{shard:08d}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(shard_bytes(keys, null, documents, width))
        try:
            store.move(part, f"{folder}/{name}")
        except OSError:  # some stores do not replace a file: an earlier run of this task has written the same
            if store.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
                raise
            store.delete_file(part)
        real = keys[~null]
        row = {
            "shard": [shard],
            "file": [name],
            "documents": [len(documents)],
            "ids": [sum(map(len, documents)) // width],
            "nulls": [int(null.sum())],
            "first_key": [int(real[0]) if len(real) else None],
            "last_key": [int(real[-1]) if len(real) else None],
            "last_count": [int((real == real[-1]).sum()) if len(real) else 0],
        }
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))

    ranged.mapInArrow(save, PARTS).write.parquet(f"{path}/parts")
    before_all(spark.read.schema(PARTS).parquet(f"{path}/parts")).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def before_all(parts: DataFrame) -> DataFrame:
    """``parts`` with the documents and ids of all shards before: sums within chunks of shards, and over the chunks."""
    parts = parts.withColumn("chunk", F.expr(f"shard div {CHUNK}"))

    def earlier(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))

    chunks = parts.groupBy("chunk").agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"))
    over = Window.orderBy("chunk")  # one row per CHUNK shards
    chunks = chunks.select("chunk", earlier("documents", over).alias("chunk_documents"), earlier("ids", over).alias("chunk_ids"))
    inside = Window.partitionBy("chunk").orderBy("shard")
    summed = parts.withColumns({"documents_before": earlier("documents", inside), "base": earlier("ids", inside)}).join(chunks, "chunk")
    return summed.select(
        *parts.drop("chunk").columns,
        (F.col("documents_before") + F.col("chunk_documents")).alias("documents_before"),
        (F.col("base") + F.col("chunk_ids")).alias("base"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard with its sizes and keys, ``documents_before`` and ``base``: what all shards before it hold."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    Each document is looked up in its shard's index by key; the checksum is
    that of its ids as little-endian unsigned 32-bit integers. A task opens one
    shard after another, as the manifest's rows name them.
    """

    def load(frames):
        import pandas as pd
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(f"{path}/shards")
        for frame in frames:
            for name, base in zip(frame["file"], frame["base"]):
                with store.open_input_file(f"{folder}/{name}") as f:
                    shard = TokenShard(f.read())
                slots = shard.find(shard.keys, shard.nth, shard.null)
                if (slots < 0).any():
                    raise ValueError(f"{name}: a key is not in its index")
                sums = [zlib.crc32(shard.at(s).astype("<u4").tobytes()) for s in slots]
                doc_id = pd.array(shard.keys, "Int64").copy()
                doc_id[shard.null.astype(bool)] = pd.NA
                yield pd.DataFrame(
                    {
                        "doc_id": doc_id,
                        "start": base + shard.offset[slots].astype(np.int64),
                        "n_tokens": shard.length[slots].astype(np.int64),
                        "ids_crc32": np.array(sums, np.int64),
                    }
                )

    ship_package(spark)
    files = manifest(spark, path).select("shard", "file", "base")
    n = files.count()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, n // SHARDS_READ)))
    spread = files.repartitionByRange(tasks, "shard").select("file", "base")
    return spread.mapInPandas(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, key: int | None, nth: int = 0) -> np.ndarray | None:
    """The ids of one row, the ``nth`` of its doc_id in order of text hashes (None: the rows without doc_id).

    The manifest gives the shard and the place in it; of the shard only its
    head, one pilot, one slot and the document's ids are read.
    """
    shards, at = manifest(spark, path), nth
    if nth < 0:
        return None
    if key is not None:
        first = shards.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("shard").first()
        if first is None:
            return None
        if first["last_key"] != key or nth < first["last_count"]:
            return seek(f"{path}/shards", first["file"], key, nth)
        at = first["documents_before"] + first["documents"] + nth - first["last_count"]
    row = shards.filter((F.col("documents_before") <= at) & (F.col("documents_before") + F.col("documents") > at)).first()
    if row is None or (key is not None and row["first_key"] != key):
        return None
    return seek(f"{path}/shards", row["file"], key, at - row["documents_before"])


def seek(folder: str, name: str, key: int | None, nth: int) -> np.ndarray | None:
    """One document's ids by its key within a shard file, read by places: head, pilot, slot, ids."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{folder}/{name}") as f:

        def one(kind: str, at: int, count: int = 1) -> np.ndarray:
            return np.frombuffer(f.read_at(count * np.dtype(kind).itemsize, at), kind)

        magic, n, buckets, width, seed, _ = struct.unpack(HEAD, f.read_at(struct.calcsize(HEAD), 0))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        pilots = struct.calcsize(HEAD)
        check = pilots + 4 * buckets
        offset, length, payload = check + 4 * n, check + 12 * n, check + 29 * n
        hashes = key_hash(np.array([key or 0]), np.array([nth]), np.array([key is None]), seed)
        bucket = int((hashes[0] >> np.uint64(32)) % np.uint64(buckets))
        slot = int(slot_of(hashes, one("<i4", pilots + 4 * bucket), n)[0])
        if not 0 <= slot < n or one("<u4", check + 4 * slot)[0] != np.uint32(mix(~hashes)[0] & np.uint64(0xFFFFFFFF)):
            return None
        start, count = int(one("<u8", offset + 8 * slot)[0]), int(one("<u4", length + 4 * slot)[0])
        return one(f"<u{width}", payload + width * start, count)
