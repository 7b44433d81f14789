"""Operator 10: mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]. Its demand
for words up to t is the integral of that schedule, scaled so that the whole
run takes exactly the source's target. A source's words are lined up in a
random but fixed order, once per pass, and the word at place c of that line is
trained at the time t where the demand reaches c: the inverse of the integral.
Sorting all copies by their position gives the training order.

Nothing ever gathers a source in one task. The order inside a source is that
of a hash of the document, cut by its leading bits into buckets; sums per
bucket are added up first, so each task only runs through its own buckets. The
result does not depend on the number of buckets.

Defined results: a null or empty text has size 0, takes nothing and has null
positions; a null source is a source of its own, last in order; rows that
repeat a doc_id and text count each, next to each other in line, and rows of
one doc_id and text in two sources are planned apart; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import COLUMNS, SPACES, checkpointed, pick, text_or_empty, words_of

WEIGHTS = (1, 2, 3)  # of the sources in code point order, repeating
CAP = 3  # passes over a document at most
BUCKETS = 4096  # per source, a power of two; only spreads the work
LINE_BITS = 60

# Slope of each source's linear schedule w(t) = 1 + slope * (2t - 1), repeating
# in code point order: rising, level and falling sources.
SLOPES = (0.5, 0.0, -0.5)


def word_count(text: Column) -> Column:
    return F.size(words_of(text, SPACES)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target, weight, slope)``.

    All words are shared by weight; no target exceeds ``CAP`` times its
    source, and the excess is reshared by weight until none does. With the
    sources in order of size / weight the capped ones come first, so the level
    per weight follows from running sums. One row per source is sorted in one
    task; documents never are.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n, k = len(WEIGHTS), len(SLOPES)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("nth") % n + 1).cast("int"))
    slope = F.element_at(F.array(*[F.lit(s) for s in SLOPES]), (F.col("nth") % k + 1).cast("int"))
    named = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    named = named.withColumns({"weight": weight, "slope": slope})
    named = named.withColumn("cap", (F.lit(CAP) * F.col("source_size")).cast("double"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    levels = named.withColumns(
        {
            "total": F.sum("source_size").over(every).cast("double"),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weights": F.sum("weight").over(rest).cast("double"),
        }
    )
    # the level if all sources before this one are capped and this one is not
    levels = levels.withColumn("level", (F.col("total") - F.col("capped")) / F.col("weights"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    # the first source that fits sets the level of all that are not capped
    first_fit = F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("r"), "nth", "level"))).over(every)
    levels = levels.withColumn("final", first_fit["level"])
    target = F.when(
        F.col("final").isNull() | (F.col("final") * F.col("weight") > F.col("cap")), F.col("cap")
    ).otherwise(F.col("final") * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"), "weight", "slope")


def time_of(share: Column, slope: Column) -> Column:
    """The t at which the integral of 1 + slope * (2t - 1) reaches ``share`` of its total."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((slope - 1 + root) / (2 * slope))


def line() -> Column:
    """A document's place in its source's random order: 60 bits of a hash of doc_id and text."""
    key = F.concat_ws(":", F.lit("line"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty())
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, line)``: what the mix needs to know of a document."""
    d = pick(docs, "doc_id", "text", "source")
    return d.select("doc_id", "source", word_count(text_or_empty()).alias("size"), line().alias("line"))


def plan(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, taken, passes``.

    ``passes`` is an array of (pass, words, position), one entry per copy that
    the mix takes; of the copy at the end of a source's target only the words
    still wanted count. Words are counted once; the counts (a few bytes per
    document) are checkpointed, since sums, targets and places all need them.
    """
    counted = checkpointed(sized(docs))
    shift = LINE_BITS - (buckets.bit_length() - 1)
    counted = counted.withColumn("bucket", F.shiftrightunsigned("line", shift))
    sums = counted.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0).cast("long")))
    g = goal.select(F.col("source").alias("g_source"), "source_size", "target", "slope")
    offsets = sums.join(g, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source", "bucket_size")
    o = offsets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "ahead", "source_size", "target", "slope")
    own = Window.partitionBy("source", "bucket").orderBy("line", "doc_id", "size")
    inside = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))).join(
        o, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))
    )
    start = F.col("ahead") + F.col("inside")
    quota = F.round("target").cast("long")

    def copy(p: int) -> Column:
        at = start + p * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), quota - at))
        middle = (at + words / 2) / F.greatest(F.lit(1.0), F.col("target"))
        return F.struct(
            F.lit(p).alias("pass"),
            words.alias("words"),
            time_of(F.least(F.lit(1.0), middle), F.col("slope")).alias("position"),
        )

    passes = F.filter(F.array(*[copy(p) for p in range(CAP)]), lambda c: c["words"] > 0)
    return (
        placed.withColumn("passes", passes)
        .withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
        .select("doc_id", "size", "source", "source_size", "target", "taken", "passes", "line")
    )


def ordered(mix: DataFrame) -> DataFrame:
    """The plan in order of first use: range-sorted by position, unused documents last."""
    first = mix.withColumn("position", F.get(F.col("passes.position"), F.lit(0)))
    return first.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def curriculum(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The mixed corpus: one row per copy taken, sorted by training position.

    The columns of ``documents`` are returned, and texts are whole: of the one
    copy at the end of a source's target that the plan would cut, all is taken
    if at least half is wanted, else nothing. Equal rows (by doc_id, text and
    source) come as often as their plans say; if they differ in lang or
    n_chars, all have the smallest.
    """
    mix = plan(docs, buckets).withColumn("copy", F.explode("passes")).filter(2 * F.col("copy.words") >= F.col("size"))
    copies = mix.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("line").alias("_line"), "copy.position", "copy.pass")
    # a light row per copy meets one row per distinct document, so a much repeated row is split on the copies' side
    d = pick(docs, *COLUMNS).withColumn("_key", line())
    once = d.groupBy("doc_id", "source", "_key").agg(F.min(F.struct("lang", "n_chars", "text")).alias("_row"))
    own = (F.col("_key") == F.col("_line")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    both = copies.join(once, own).orderBy("position", "doc_id", "pass")
    return both.select("doc_id", "source", "_row.*").select(*COLUMNS)
