"""Operator 2: secret scans with character Markov models.

Two first-order Markov models over the characters of secrets, one of random
strings and one of ordinary identifiers, are trained from labelled samples. A
run of such characters is a secret if its log-likelihood ratio exceeds
``ODDS``; where a character was rarely seen as the first of a pair, a model
falls back on how often the second one occurs. Besides, three fixed patterns
(the base) are found: assignments to telling names, access keys and long
hexadecimal runs. Of a random run that touches base spans, the parts outside
them are spans of their own.

Places come without Python: every match is marked in the text, the text is cut
at the marks, and the lengths of the pieces are summed up in order. Only texts
with a match send rows, and these rows hold lengths and the run, not texts.

Labelled samples, unless given: the characters runs of ``SAMPLE_DOCS``
documents, the first ones by a hash of their id; what the fixed patterns match
is labelled random, all other runs ordinary. Corpus scans cover all rows.

Defined results: a null text is the empty text; rows that repeat a doc_id and
text give one row, rows of one doc_id with different texts give one each; with
no samples all runs score 0 and none is a secret by the models; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, pick, text_or_empty

# The patterns of the base, and how long what they find must be.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # the same as AKIA[A-Z0-9]+ of 20 characters or more
HEX = "[0-9a-f]{24,}"
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
RUN_LENGTH = 12  # runs scored by the models; of fewer characters even random ones seldom reach ODDS
SAMPLE_LENGTH = 6  # runs they learn from
SAMPLE_DOCS = 2000  # documents they learn from
SMOOTHING = 0.5  # added to the count of every character
BACK_OFF = 5.0  # pairs seen with a first character, from which its own counts outweigh those of all
ODDS = 10.0  # log of how much likelier random must be

OPEN, CLOSE = "\u0001", "\u0002"


def pieces(text: Column, pattern: str) -> Column:
    """The text cut into gap, match, gap, ..., match, gap; null if nothing matches."""
    clean = F.translate(text, OPEN + CLOSE, "\u0003\u0003")  # same length, and no pattern knows these characters
    marked = F.regexp_replace(clean, f"({pattern})", f"{OPEN}$1{CLOSE}")
    return F.when(text.rlike(pattern), F.split(marked, f"[{OPEN}{CLOSE}]"))


def matches(docs: DataFrame) -> DataFrame:
    """Every match: ``doc_id, text_key, kind, start, stop, value``; code points, the end exclusive.

    ``kind`` is the place in ``KINDS``; runs (3) still have to be scored.
    """
    patterns = (ASSIGN, ACCESS, HEX, f"{RUN}{{{RUN_LENGTH},}}")
    cut = docs.select("doc_id", "text_key", *[pieces(F.col("text"), p).alias(f"k{i}") for i, p in enumerate(patterns)])
    kinds = F.filter(
        F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"k{i}").alias("pieces")) for i in range(len(patterns))]),
        lambda k: k["pieces"].isNotNull(),
    )
    each = cut.select("doc_id", "text_key", F.explode(kinds).alias("k"))
    each = each.select("doc_id", "text_key", "k.kind", F.posexplode("k.pieces").alias("nth", "piece"))
    match = F.col("nth") % 2 == 1
    value = F.when(F.col("kind") == 0, F.regexp_extract("piece", ASSIGN, 2)).otherwise(F.col("piece"))
    rows = each.select("doc_id", "text_key", "kind", "nth", F.length("piece").alias("length"), F.when(match, value).alias("value"))
    rows = rows.distinct()  # the pieces of repeated rows count once
    order = Window.partitionBy("doc_id", "text_key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("stop", F.sum("length").over(order))
    long_enough = (F.col("kind") != 0) | (F.length("value") >= ASSIGN_VALUE)
    return placed.filter(F.col("value").isNotNull() & long_enough).select(
        "doc_id", "text_key", "kind", (F.col("stop") - F.col("length")).alias("start"), "stop", "value"
    )


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(value, label)`` from a bounded sample of documents: 1 for random strings, 0 for ordinary ones."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi")  # at most sample_docs ids
    base = "|".join((ASSIGN, ACCESS, HEX))
    inside, outside = [], F.col("text")
    for pattern, group in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0)):
        inside.append(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))
    outside = F.split(F.regexp_replace("text", base, " "), "[^A-Za-z0-9+/_=-]+")
    random = sample.select(F.explode(F.concat(*inside)).alias("value"), F.lit(1).alias("label"))
    plain = sample.select(F.explode(outside).alias("value"), F.lit(0).alias("label"))
    return random.unionByName(plain).filter(F.length("value") >= SAMPLE_LENGTH)


def bigrams(value: str) -> Column:
    return F.expr(f"transform(sequence(1, greatest(1, length({value}) - 1)), i -> substring({value}, i, 2))")


def train(spark: SparkSession, samples: DataFrame) -> DataFrame:
    """``(bigram, ratio)`` for every pair of the alphabet: the log ratio of its two transition probabilities.

    p(b | a) = (n(ab) + BACK_OFF * p(b)) / (n(a) + BACK_OFF), p(b) from all pairs.
    """
    n = len(ALPHABET)
    letter = lambda c: F.substring(F.lit(ALPHABET), (c + 1).cast("int"), F.lit(1))
    grid = spark.range(n * n).select(F.concat(letter(F.floor(F.col("id") / n)), letter(F.col("id") % n)).alias("bigram"))
    seen = samples.select("label", F.explode(bigrams("value")).alias("bigram"))
    counts = seen.groupBy("bigram").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0"))
    table = grid.join(counts, "bigram", "left").na.fill(0, ["c1", "c0"])
    first, second = (Window.partitionBy(F.substring("bigram", i, 1)) for i in (1, 2))
    every = Window.partitionBy(F.lit(1))  # the grid has n * n rows

    def logp(c: str) -> Column:
        own = (F.sum(c).over(second) + SMOOTHING) / (F.sum(c).over(every) + SMOOTHING * n)
        return F.log((F.col(c) + BACK_OFF * own) / (F.sum(c).over(first) + BACK_OFF))

    some = F.max(F.col("c1") + F.col("c0")).over(every) > 0
    return table.select("bigram", F.when(some, logp("c1") - logp("c0")).otherwise(0.0).alias("ratio"))


def spans(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """All secrets: ``doc_id, text_key, kind, start, stop, ratio`` (null ratio for the fixed patterns)."""
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text").withColumn("text", text_or_empty()).withColumn("text_key", F.xxhash64("text"))
    found = checkpointed(matches(d))  # a few rows per text; both branches below need them
    model = F.broadcast(train(spark, labelled_samples(d) if samples is None else samples))  # alphabet squared
    runs = found.filter(F.col("kind") == 3)
    at = ["doc_id", "text_key", "kind", "start", "stop"]
    scored = (
        runs.select(*at, F.explode(bigrams("value")).alias("bigram"))
        .join(model, "bigram")
        .groupBy(*at)
        .agg(F.sum("ratio").alias("ratio"))
        .filter(F.col("ratio") > ODDS)
    )
    base = found.filter(F.col("kind") < 3).select(*at, F.lit(None).cast("double").alias("ratio"))
    return base.unionByName(scored)


def scan(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One row per text: ``doc_id, text_key, base, more``, arrays of (start, kind, stop) in order.

    ``more`` are the runs the models add, without what base spans cover of them.
    """
    d = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"))
    every = d.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("start", "long"), ("stop", "long"), ("ratio", "double"))])
    one = F.struct("start", "kind", "stop")
    listed = (
        every.unionByName(spans(docs, samples))
        .groupBy("doc_id", "text_key")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("kind") < 3, one))).alias("base"),
            F.array_sort(F.collect_list(F.when(F.col("kind") == 3, one))).alias("runs"),
        )
    )
    # a run's parts between the base spans, from left to right
    span = "named_struct('start', {0}, 'kind', r.kind, 'stop', {1})"
    walk = (
        "aggregate(filter(base, b -> b.start < r.stop and r.start < b.stop), "
        "named_struct('at', r.start, 'parts', cast(array() as array<struct<start: bigint, kind: int, stop: bigint>>)), "
        f"(a, b) -> named_struct('at', greatest(a.at, b.stop), 'parts', if(b.start > a.at, concat(a.parts, array({span.format('a.at', 'b.start')})), a.parts)), "
        f"a -> if(a.at < r.stop, concat(a.parts, array({span.format('a.at', 'r.stop')})), a.parts))"
    )
    return listed.select("doc_id", "text_key", "base", F.expr(f"flatten(transform(runs, r -> {walk}))").alias("more"))


def as_string(spans_column: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"array_join(transform({spans_column}, s -> concat_ws(':', array({names})[s.kind], cast(s.start as string), cast(s.stop as string))), ',')"
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mark``; columns of ``documents``, one row per input row."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    found = scan(docs).filter((F.size("base") > 0) | (F.size("more") > 0))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.array_sort(F.concat("base", "more")).alias("_spans"))
    d = pick(docs, *cols)
    both = d.join(found, d["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty()) == F.col("_key")), "left")
    # overlapping spans become one; what lies between them is kept
    rest = F.expr(
        "aggregate(_spans, named_struct('at', 0L, 'out', ''), (r, s) -> if(s.stop <= r.at, r, named_struct("
        "'at', s.stop, 'out', if(s.start >= r.at, concat(r.out, substring(text, cast(r.at as int) + 1, cast(s.start - r.at as int)), "
        f"'{mark}'), r.out))), r -> concat(r.out, substring(text, cast(r.at as int) + 1)))"
    )
    out = both.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(rest))
    return out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*cols)
