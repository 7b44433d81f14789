"""Operator 4: document fingerprints as a homomorphic multiset hash.

A text's parts (lines, cut further behind sentence marks) form a multiset.
Every part is hashed to a wide vector: 126 bits of its MD5 and a constant 1.
The fingerprint is the sum of these vectors, each entry modulo 2^20. So the
order of parts does not matter, and parts are added or taken away by adding or
subtracting their vectors (``combine``). Equal multisets have equal sums; for
different ones all 127 entries would have to agree by chance.

The entries of a difference of two sums vary with the number of parts that
differ (each adds a variance of 1/4), and the last entry counts the parts. So
two fingerprints alone give a likeness from 0 to 1. It estimates the share of
parts that differ from 126 entries, with a standard error of about an eighth of
that share: texts with nothing in common are found 0 to 0.25 alike by chance,
texts that differ in a tenth of their parts 0.9 +- 0.013.

Three entries share one long during summation (bits j, j + 21 and j + 42 of a
hash word), which saves work. All of it is built-in array functions.

Defined results: a null text is the empty text; an empty text has one empty
part; repeated rows are handled each on their own; rows without doc_id come
last in the order of documents; ties of doc_id are ordered by a hash of the
text, largest first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, text_or_empty

BUCKETS_PER_PARTITION = 4  # ranges for each shuffle partition, so that hashing them spreads evenly
LEAST_ROWS = 256  # mean rows of a range at least
SAMPLED = 20  # rows for each range, from which the ranges are cut
# Three entries of 20 bits lie in one long, a free bit above each.
ONES = 1 | 1 << 21 | 1 << 42
KEEP = (2**20 - 1) * ONES
BORROW = 2**20 * ONES


def vector(text: str) -> Column:
    """The fingerprint of a text column: 42 longs with three entries each, then the count of parts."""
    parts = f"split(regexp_replace({text}, '([.!?] )', '$1\\n'), '\\n')"
    word = "shiftleft(cast(conv(substring(d, {0}, 8), 16, 10) as bigint), 32) | cast(conv(substring(d, {1}, 8), 16, 10) as bigint)"
    digest = f"transform({parts}, p -> md5(p))"
    zero = "array_repeat(0L, 21)"
    half = (
        f"aggregate(transform({{0}}, d -> {{1}}), {zero}, "
        f"(sums, w) -> transform(sums, (s, j) -> (s + (shiftrightunsigned(w, j) & {ONES}L)) & {KEEP}L))"
    )
    # one pass over the digests: both halves come from the same array
    both = f"transform(array({digest}), ds -> concat({half.format('ds', word.format(1, 9))}, {half.format('ds', word.format(17, 25))}, array(cast(size(ds) as bigint))))"
    return F.expr(f"{both}[0]")


def combine(a: str, b: str, sign: int = 1) -> Column:
    """The fingerprint of two multisets put together (sign 1), or of a without b (sign -1)."""
    # for a difference every entry first borrows its own 2^20, which the mask takes away again
    entry = "(x + y)" if sign > 0 else f"((x | {BORROW}L) - y)"
    return F.expr(f"zip_with({a}, {b}, (x, y) -> {entry} & {KEEP}L)")


def as_string(v: str) -> Column:
    return F.expr(f"array_join(transform({v}, x -> lower(hex(x))), '.')")


def likeness(a: str, b: str) -> Column:
    """1 less the estimated share of parts that differ; exactly 1 for equal fingerprints."""
    entry = "((((shiftrightunsigned(x, {0}) & 1048575L) - (shiftrightunsigned(y, {0}) & 1048575L)) + 524288L) & 1048575L) - 524288L"
    pairs = (
        f"zip_with(slice({a}, 1, 42), slice({b}, 1, 42), (x, y) -> "
        f"named_struct('l', {entry.format(0)}, 'm', {entry.format(21)}, 'h', {entry.format(42)}))"
    )
    sums = (
        f"aggregate({pairs}, named_struct('s', 0L, 'q', 0L), "
        f"(t, d) -> named_struct('s', t.s + d.l + d.m + d.h, 'q', t.q + d.l * d.l + d.m * d.m + d.h * d.h))"
    )
    differ = f"transform(array({sums}), t -> 4D * (126D * cast(t.q as double) - cast(t.s as double) * cast(t.s as double)) / (126D * 125D))[0]"
    return F.expr(f"greatest(0D, least(1D, 1D - {differ} / cast({a}[42] + {b}[42] as double)))")


def _bucket(bounds: list[tuple]) -> Column:
    """The number of bounds at or below the row's ``(doc_id, text_hash, salt)``, by bisection; a null id is the lowest."""
    steps = max(1, len(bounds).bit_length() + 1)
    fields = json.dumps([dict(zip("ihs", b)) for b in bounds])
    array = f"from_json('{fields}', 'array<struct<i: bigint, h: bigint, s: bigint>>')"
    key = "named_struct('i', doc_id, 'h', text_hash, 's', salt)"
    middle = "cast((r.lo + r.hi) div 2 as int)"
    return F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(bounds)}, 'k', {key}), (r, i) -> "
        f"if(r.lo >= r.hi, r, if(get({array}, {middle}) <= r.k, named_struct('lo', {middle} + 1, 'hi', r.hi, 'k', r.k), "
        f"named_struct('lo', r.lo, 'hi', {middle}, 'k', r.k))), r -> r.lo)"
    )


def _bounds(keyed: DataFrame, rows: int, buckets: int) -> list[tuple]:
    """Quantiles of ``(doc_id, text_hash)`` from a sample of ``SAMPLED`` rows a bucket.

    Only the sizes of buckets depend on the sample. A pair that fills several
    buckets is cut by salt instead, so that rows all alike are split too.
    """
    sample = keyed.select("doc_id", "text_hash").sample(min(1.0, SAMPLED * buckets / rows), seed=4)
    ranked = sample.withColumn("at", F.row_number().over(Window.orderBy("doc_id", "text_hash")) - 1)
    each = F.greatest(F.lit(1.0), F.count("*").over(Window.partitionBy()) / buckets)
    part = lambda at: F.floor(at / F.col("each"))
    cuts = ranked.withColumn("each", each).filter((F.col("at") > 0) & (part(F.col("at")) > part(F.col("at") - 1)))
    times: dict[tuple, int] = {}
    for row in cuts.orderBy("at").select("doc_id", "text_hash").collect():  # fewer than ``buckets`` rows
        times[tuple(row)] = times.get(tuple(row), 0) + 1
    return [(*pair, -(2**63) + j * (2**64 // m)) for pair, m in times.items() for j in range(m)]


def with_next(docs: DataFrame, values: list[str], enrich) -> DataFrame:
    """``enrich(docs)`` with ``next``: a struct of the named columns of the document after it by descending doc_id.

    The last document is followed by the first. No task sees more than a range
    of ``(doc_id, hash of text)``, cut at quantiles; one copy of the first
    document of each range goes to the end of the range before it, where it only
    serves as the successor. The driver holds one key per range.
    """
    spark = docs.sparkSession
    rows = docs.count()
    buckets = max(1, min(BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // LEAST_ROWS))
    keyed = docs.withColumns({"text_hash": F.xxhash64("text"), "salt": F.xxhash64(F.monotonically_increasing_id())})
    bounds = _bounds(keyed, rows, buckets) if buckets > 1 else []
    bucket = _bucket(bounds)
    pair = F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    heads = {r["b"]: tuple(r["head"]) for r in keyed.groupBy(bucket.alias("b")).agg(F.max(pair).alias("head")).collect()}
    held = sorted(heads)
    # the successor of a range's last document is the head of the next lower range; the lowest wraps to the top
    above = {b: held[(i + 1) % len(held)] for i, b in enumerate(held)}
    span = range(len(bounds) + 1)
    fields = json.dumps([dict(zip("ih", heads[b])) if b in heads else None for b in span])
    head = F.expr(f"get(from_json('{fields}', 'array<struct<i: bigint, h: bigint>>'), bucket)")
    goes = F.expr(f"get(from_json('{json.dumps([above.get(b) for b in span])}', 'array<int>'), bucket)")
    placed = keyed.withColumn("bucket", bucket)
    copies = placed.filter(pair.eqNullSafe(head)).groupBy("bucket", "doc_id", "text_hash").agg(F.min("text").alias("text"))
    ghosts = enrich(copies.withColumns({"bucket": goes, "ghost": F.lit(True)}))
    dealt = enrich(placed.drop("salt").withColumn("ghost", F.lit(False))).unionByName(ghosts)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.desc("text_hash"))
    led = dealt.withColumn("next", F.lead(F.struct(*values)).over(order))
    return led.filter(~F.col("ghost")).drop("bucket", "ghost", "text_hash")


def prepared(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of every row, a null text as the empty one."""
    return pick(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": text_or_empty()})


def hashed(d: DataFrame) -> DataFrame:
    return d.withColumn("n_chars", F.length("text").cast("long")).withColumn("vector", vector("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_chars, vector, fingerprint)`` of every document; no shuffle."""
    return hashed(prepared(docs)).withColumn("fingerprint", as_string("vector"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    The edit replaces the last third of a text by as many first characters of
    the next document. Texts are shuffled once, by range of ids and hashes.
    """
    led = with_next(prepared(docs), ["text", "vector"], hashed)
    third = "cast(floor(n_chars / 3) as int)"
    edited = led.withColumn(
        "edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {third}), substring(next.text, 1, {third}))")
    )
    edited = edited.select(
        "doc_id",
        "n_chars",
        "vector",
        F.sha2("edited", 256).alias("edited_sha256"),
        vector("edited").alias("edited_vector"),
        F.col("next.vector").alias("next_vector"),
    )
    return edited.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string("vector").alias("fingerprint"),
        as_string("edited_vector").alias("edited_fingerprint"),
        likeness("vector", "edited_vector").alias("near_edited"),
        likeness("vector", "next_vector").alias("near_next"),
    )
