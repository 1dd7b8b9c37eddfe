"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.ordered import null_safe_join, sized
from .common import BUCKET_ROWS, SPACE, WORD, Scratch, before, key_bits, key_bucket, row_key, text_of, word_count

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code point order (null last) weigh ``weights`` in turn and share the
    total of all sizes. A target stops at ``most`` times its source's size; what is
    over goes to the others by weight until none is above. With sources ordered by
    size per weight the capped ones come first, so the share of one weight unit is
    found by running sums over the source table. A source without words gets 0.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())  # one row per source
    index = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = total.select("source", "source_size", (F.col("source_size") * most).alias("_cap"),
                           F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), index + 1).alias("_w"))
    # capped sources: those for which the unit share of all that are not smaller per weight is above their cap
    ratio = F.col("_cap") / F.col("_w")
    earlier = W.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    steps = weighed.withColumns({
        "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0)),
        "_units": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0))})
    capped = F.col("_left") * F.col("_w") > F.col("_cap") * F.col("_units")
    steps = steps.withColumn("_capped", capped)
    free = F.struct(ratio.alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"),
                    F.col("_left").alias("left"), F.col("_units").alias("units"))
    steps = steps.withColumn("_first", F.min(F.when(~F.col("_capped"), free)).over(everything))
    share = (F.col("_first.left") * F.col("_w")).cast("double") / F.col("_first.units")
    return steps.select("source", "source_size",
                        F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def plan(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per source how its rows are taken: source, source_size, target, epochs, cut_key, cut_words, cut_rows.

    ``sizes`` has source, size and key (60 random bits). Rows below ``cut_key`` are
    taken ``epochs + 1`` times, rows above it ``epochs`` times; the rows at it (one,
    or repeated identical rows) share ``cut_words`` words more. The cut is where the
    running sum of sizes in key order reaches floor(target) - epochs * source_size:
    sums per key range are added up per source, and only the range that holds the
    cut is sorted.
    """
    bits = key_bits(sizes.count(), bucket_rows)
    sizes = sizes.select("source", "size", "key", key_bucket(F.col("key"), bits).alias("_b"))
    targets = source_targets(sizes, weights, most)
    whole = F.floor("target").cast("long")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0,
                                                  F.floor(whole / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("_rest", whole - F.col("epochs") * F.col("source_size"))
    targets = sized(targets)
    totals = before(sizes.groupBy("source", "_b").agg(F.sum("size").alias("_sum")), ["source"], "_b", "_sum", "_before")
    located = null_safe_join(totals, targets.select("source", "_rest"), ["source"])
    located = located.where("_rest > _before and _rest <= _before + _sum").select("source", "_b", "_before", "_rest")
    inside = null_safe_join(sizes, sized(located), ["source", "_b"])
    keys = inside.groupBy("source", "_b", "_before", "_rest", "key").agg(
        F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("cut_rows"))
    run = W.partitionBy("source", "_b").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    keys = keys.withColumn("_upto", F.col("_before") + F.coalesce(F.sum("_sum").over(run), F.lit(0)))
    cut = keys.where("_rest > _upto and _rest <= _upto + _sum").select(
        "source", F.col("key").alias("cut_key"), (F.col("_rest") - F.col("_upto")).alias("cut_words"), "cut_rows")
    out = null_safe_join(targets.drop("_rest"), sized(cut), ["source"], "left")
    return sized(out.withColumn("cut_key", F.coalesce("cut_key", F.lit(-1))))


def taken_words(size="size", key="key"):
    """Words that the mix takes of a row, from the columns of :func:`plan`."""
    extra = (F.when(F.col(key) < F.col("cut_key"), F.col(size))
             .when(F.col(key) == F.col("cut_key"), F.floor(F.col("cut_words") / F.col("cut_rows")))
             .otherwise(F.lit(0)))
    return (F.col("epochs") * F.col(size) + extra).cast("long")


def mix_sizes(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS,
              most: int = MOST_EPOCHS, seed=SEED) -> DataFrame:
    """Digest per row: doc_id, source, size, source_size, target, taken.

    Null texts have size 0 and are taken 0 times; a null source is a source of its
    own. Identical rows (same id and text) at a source's cut share the remaining
    words evenly, rounded down, so the source is short of its target by fewer words
    than there are copies. An empty table gives an empty result. Other columns of
    the input are not read.
    """
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.keep(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                                     word_count(text).alias("size"), row_key(seed, doc_id, text).alias("key")), "sizes")
    joined = null_safe_join(sizes, plan(sizes, weights, most), ["source"])
    return joined.select("doc_id", "source", "size", "source_size", "target", taken_words().alias("taken"))


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS,
        most: int = MOST_EPOCHS, seed=SEED) -> DataFrame:
    """The mix itself, with the input's columns: one row per document and epoch.

    A document taken for e whole epochs is there e times; the document at the cut of
    its source is there once more, its text ending with the last word taken
    (``n_chars`` is renewed if there is such a column). Documents without words, with
    which no budget can be filled, stay once. Texts are not shuffled: a row is
    compared with its source's cut.
    """
    names = docs.columns
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.keep(docs.select(F.col(source).cast("string").alias("source"), word_count(text).alias("size"),
                                     row_key(seed, doc_id, text).alias("key")), "sizes")
    # written before its source is dropped: above 10,000 sources the plan is not held as a broadcast
    cuts = sized(scratch.keep(plan(sizes, weights, most), "cuts"))
    scratch.drop("sizes")
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(source).cast("string").alias("source"),
                       word_count(text).alias("size"), row_key(seed, doc_id, text).alias("key"))
    rows = null_safe_join(rows, cuts, ["source"]).withColumn("taken", taken_words())
    rest = F.col("taken") - F.floor(F.col("taken") / F.greatest("size", F.lit(1))) * F.col("size")
    copies = F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.concat(
        F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>"))))
    rows = rows.select("row", "size", F.explode(copies).alias("words"))
    pieces = F.regexp_extract_all(F.col(f"row.{text}"), F.lit(f"[{SPACE}]*{WORD}"), F.lit(0))
    cut = F.when(F.col("words") < F.col("size"),
                 F.array_join(F.slice(pieces, 1, F.greatest("words", F.lit(1)).cast("int")), "")
                 ).otherwise(F.col(f"row.{text}"))
    rows = rows.withColumn("text", cut)
    return rows.select(*[
        F.col("text").alias(c) if c == text
        else F.when(F.col("words") < F.col("size"), F.length(text_of("text")).cast("long")).otherwise(F.col("row.n_chars")).alias(c)
        if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in names])
