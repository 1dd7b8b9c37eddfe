"""Exact ranks, quantiles and prefix sums without a global sort.

The common idea: cut the ordered domain into buckets, count per bucket with a
map-side combined aggregate, and add the small per-bucket offsets to work done
inside each bucket. Values are reduced to distinct values with counts before
anything is ordered, so one value held by a third of all rows is one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import written

BUCKETS = 128
BUCKET_ROWS = 2_000_000   # more buckets are cut once they would hold more rows than this
OFFSET_ROWS = 200_000     # tables of bucket offsets up to this size are broadcast


def cut_points(df: DataFrame, cols: Sequence[str], n: int = BUCKETS, most: int | None = None) -> dict[str, list[float]]:
    """About equally filled split points per numeric column.

    One aggregate, and a second one with more points if the table is so large
    that ``n`` buckets would be too full. The points only balance the buckets;
    no result depends on where they fall, nor on ``most``, a limit of their number.
    """
    def cut(n):
        probs = [i / n for i in range(1, n)]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *[
            F.percentile_approx(F.col(c).cast("double"), probs, 8 * n).alias(f"_{i}") for i, c in enumerate(cols)]).first()
        return row["rows"], {c: sorted(set(row[f"_{i}"] or [])) for i, c in enumerate(cols)}

    rows, cuts = cut(n)
    wanted = math.ceil(rows / BUCKET_ROWS)
    wanted = wanted if most is None else min(most, wanted)
    return cut(wanted)[1] if wanted > n else cuts


def with_buckets(df: DataFrame, cuts: dict[str, list[float]], prefix: str = "_b_") -> DataFrame:
    """Add ``prefix + column``: index of the bucket [cut_i, cut_i+1) of each column."""
    cols = list(cuts)
    tmp = [f"_v{prefix}{c}" for c in cols]
    df = df.withColumns({t: F.col(c).cast("double") for t, c in zip(tmp, cols)})
    splits = [[-math.inf, *([x for x in cuts[c] if math.isfinite(x)] or [0.0]), math.inf] for c in cols]
    out = Bucketizer(splitsArray=splits, inputCols=tmp, outputCols=[f"{prefix}{c}" for c in cols],
                     handleInvalid="keep").transform(df)
    return out.withColumns({f"{prefix}{c}": F.col(f"{prefix}{c}").cast("int") for c in cols}).drop(*tmp)


def order_statistics(df: DataFrame, wanted, bucket_rows: int = BUCKET_ROWS) -> dict[str, tuple[int, dict[int, float]]]:
    """Exact values at 0-based ranks among the finite values of numeric columns.

    ``wanted`` maps a column to a list of ranks or to a function of the count
    that gives one. Returns per column the count and rank -> value. Three passes
    over the columns; only buckets holding a wanted rank are ordered. Such a bucket
    is cut again while it has more than ``bucket_rows`` rows of different values, so
    the number of buckets of one pass does not grow with the table.
    """
    cols = list(wanted)
    cuts = cut_points(df, cols, most=BUCKETS)
    marked = with_buckets(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cuts)
    long = marked.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(f"_b_{c}").cast("long").alias("g"), F.col(c).alias("v"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*").where("abs(v) < double('infinity')")
    parts: dict[int, list] = {i: [] for i in range(len(cols))}
    for r in long.groupBy("c", "g").agg(*_extent()).collect():  # columns x buckets rows
        parts[r["c"]].append((r["g"], r["n"], r["low"], r["high"]))
    totals, found = {}, {c: {} for c in cols}
    need = []          # (column, bucket, rows, [(rank, place in the bucket)])
    for i, c in enumerate(cols):
        n = totals[c] = sum(p[1] for p in parts[i])
        ranks = wanted[c](n) if callable(wanted[c]) else wanted[c]
        inside, known = _located(parts[i], [(int(r), int(r)) for r in ranks if 0 <= r < n])
        found[c].update(known)
        need += [(i, *b) for b in inside]
    while need:
        small = [b for b in need if b[2] <= bucket_rows]
        need = [b for b in need if b[2] > bucket_rows]
        for c, rank, v in _places(long, small):
            found[cols[c]][rank] = v
        if need:
            long, need, known = _refined(long, need)
            for c, rank, v in known:
                found[cols[c]][rank] = v
    return {c: (totals[c], found[c]) for c in cols}


def _extent():
    return F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")


def _located(parts, ranks):
    """Which of the (bucket, rows, low, high) hold the (rank, place): buckets to look into, and ranks known already."""
    inside, known, before, k = [], {}, 0, 0
    ranks = sorted(set(ranks), key=lambda r: r[1])
    for bucket, n, low, high in sorted(parts):
        mine = []
        while k < len(ranks) and ranks[k][1] < before + n:
            mine.append((ranks[k][0], ranks[k][1] - before))
            k += 1
        if mine and low == high:
            known.update((rank, low) for rank, _ in mine)
        elif mine:
            inside.append((bucket, n, mine))
        before += n
    return inside, known


def _places(long: DataFrame, buckets) -> list:
    """(column, rank, value) of places in buckets (column, bucket, rows, places), from running counts of distinct values."""
    if not buckets:
        return []
    rows = [(c, g, rank, place) for c, g, _, places in buckets for rank, place in places]
    targets = long.sparkSession.createDataFrame(rows, "c int, g long, rank long, local long")
    part = (long.join(F.broadcast(targets.select("c", "g").distinct()), ["c", "g"], "left_semi")
            .groupBy("c", "g", "v").agg(F.count(F.lit(1)).alias("n")))
    w = W.partitionBy("c", "g").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = (part.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(targets), ["c", "g"])
            .where((F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("n"))))
    return [(r["c"], r["rank"], r["v"]) for r in hits.select("c", "rank", "v").collect()]  # one row per wanted rank


def _refined(long: DataFrame, buckets, n: int = BUCKETS):
    """Buckets (column, bucket, rows, places) cut again: the rows of the parts with a place, these parts, and places known.

    A value that is a cut point is a part of its own, so a frequent value is found
    at once and every other part is smaller than the bucket.
    """
    spark = long.sparkSession
    keys = F.broadcast(spark.createDataFrame([(c, g) for c, g, _, _ in buckets], "c int, g long"))
    rows = long.join(keys, ["c", "g"], "left_semi")
    cuts = rows.groupBy("c", "g").agg(F.array_distinct(F.percentile_approx("v", [i / n for i in range(1, n)], 8 * n)).alias("_cuts"))
    cuts = F.broadcast(spark.createDataFrame(cuts.collect(), "c int, g long, _cuts array<double>"))     # n numbers a bucket
    below = lambda v: F.size(F.filter("_cuts", lambda q: q < v)) + F.size(F.filter("_cuts", lambda q: q <= v))
    rows = rows.join(cuts, ["c", "g"]).select("c", "g", "v", below(F.col("v")).alias("s"))
    parts: dict[tuple, list] = {}
    for r in rows.groupBy("c", "g", "s").agg(*_extent()).collect():
        parts.setdefault((r["c"], r["g"]), []).append((r["s"], r["n"], r["low"], r["high"]))
    names, need, found = [], [], []
    for c, g, _, places in buckets:
        inside, known = _located(parts[c, g], places)
        found += [(c, rank, v) for rank, v in known.items()]
        for s, size, mine in inside:
            need.append((c, len(names), size, mine))
            names.append((c, g, s, len(names)))
    if not need:
        return long, need, found
    names = F.broadcast(spark.createDataFrame(names, "c int, g long, s int, _new long"))
    return rows.join(names, ["c", "g", "s"]).select("c", F.col("_new").alias("g"), "v"), need, found


def quantile_table(df: DataFrame, cols: Sequence[str], probs) -> dict[str, tuple[list[float], list[float]]]:
    """Per column the levels and the exact linearly interpolated quantiles at them.

    ``probs`` is a list, or a function of the column's count that gives one. A
    column without values gets empty lists.
    """
    def levels(n):
        return [float(q) for q in (probs(n) if callable(probs) else probs)]

    def ranks(n):
        positions = [(n - 1) * q for q in levels(n)]
        return {math.floor(h) for h in positions} | {math.ceil(h) for h in positions}

    result = {}
    for c, (n, at) in order_statistics(df, {c: ranks for c in cols}).items():
        wanted, values = levels(n) if n else [], []
        for q in wanted:
            h = (n - 1) * q
            lo, hi = at[math.floor(h)], at[math.ceil(h)]
            values.append(lo + (hi - lo) * (h - math.floor(h)))
        result[c] = (wanted, values)
    return result


def quantiles(df: DataFrame, cols: Sequence[str], probs) -> dict[str, list[float]]:
    """Exact linearly interpolated quantiles per column, see :func:`quantile_table`."""
    return {c: values for c, (_, values) in quantile_table(df, cols, probs).items()}


def running(df: DataFrame, by: Sequence[str], order: str, sums: dict[str, str] | None = None,
            maxes: dict[str, str] | None = None, cuts: list[float] | None = None) -> DataFrame:
    """Sums (0 if none) and maxima (null if none) over the group's rows strictly earlier in ``order``.

    ``df`` has one row per (group, order value); the dicts map output names to
    columns. A bucket's own rows are combined in a window on (group, bucket) and
    the totals of earlier buckets are added, so no window holds a whole group.
    """
    by, sums, maxes, bucket = list(by), dict(sums or {}), dict(maxes or {}), "_bk"
    if cuts is None:
        cuts = cut_points(df, [order])[order]
    marked = with_buckets(df, {order: cuts}).withColumnRenamed(f"_b_{order}", bucket)
    totals = marked.groupBy(*by, bucket).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()],
                                             *[F.max(c).alias(f"_t_{o}") for o, c in maxes.items()])
    earlier = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, bucket, *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in sums],
        *[F.max(f"_t_{o}").over(earlier).alias(f"_o_{o}") for o in maxes])
    inside = W.partitionBy(*by, bucket).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    # broadcast offsets leave the window's own shuffle as the only one
    out = null_safe_join(marked, sized(offsets, OFFSET_ROWS), [*by, bucket])
    return out.withColumns({
        **{o: F.col(f"_o_{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()},
        **{o: F.greatest(F.col(f"_o_{o}"), F.max(c).over(inside)) for o, c in maxes.items()},
    }).drop(bucket, *[f"_o_{o}" for o in [*sums, *maxes]])


def as_of(keys: DataFrame, order: str, table: DataFrame, value: str, cuts: list[float] | None = None) -> DataFrame:
    """``keys`` plus structs ``prev`` and ``next``: the last row of ``table`` up to the key and the first one beyond it.

    Both sides are numeric and have one row per value. They are cut into common
    buckets; a bucket takes the rows that lie outside it from the ends of the other
    buckets, so a table of any size is joined without a sort as a whole. With ``cuts``,
    kept from when the table was made, nothing is run before the result.
    """
    entry = F.struct(F.col(value).cast("double").alias(value), *[c for c in table.columns if c != value])
    rows = table.select(F.col(value).cast("double").alias("_at"), entry.alias("_t"), F.lit(0).alias("_key"))
    asked = keys.select(F.col(order).cast("double").alias("_at"), F.lit(None).cast(rows.schema["_t"].dataType).alias("_t"),
                        F.lit(1).alias("_key"))
    both = rows.unionByName(asked)
    cuts = cut_points(both, ["_at"])["_at"] if cuts is None else cuts
    marked = with_buckets(both, {"_at": cuts}).withColumnRenamed("_b__at", "_bk")
    ends = marked.groupBy("_bk").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    up = W.orderBy("_bk").rowsBetween(W.unboundedPreceding, -1)                # one row per bucket
    down = W.orderBy(F.desc("_bk")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("_bk", F.max("_high").over(up).alias("_before"), F.min("_low").over(down).alias("_after"))
    inside = W.partitionBy("_bk").orderBy("_at", "_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    behind = W.partitionBy("_bk").orderBy(F.desc("_at"), F.desc("_key")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = marked.withColumns({"_p": F.max("_t").over(inside), "_n": F.min("_t").over(behind)}).where("_key = 1")
    ends = F.broadcast(ends) if len(cuts) < OFFSET_ROWS else ends      # one row per bucket
    found = null_safe_join(found, ends, ["_bk"])
    return found.select(F.col("_at").alias(order), F.coalesce("_p", "_before").alias("prev"), F.coalesce("_n", "_after").alias("next"))


def halo_blocks(df: DataFrame, by: Sequence[str], position: str, back: int, block_rows: int = 100_000) -> DataFrame:
    """Cut ordered groups into blocks that also hold the ``back`` rows before them.

    ``position`` counts rows from 0 inside the group. A window on (by..., _block)
    then sees every frame of up to ``back`` preceding rows; drop rows with
    ``_halo`` afterwards.
    """
    block = F.floor(F.col(position) / block_rows)
    copies = F.when(F.col(position) % block_rows >= block_rows - back, F.array(block, block + 1)).otherwise(F.array(block))
    return df.withColumn("_block", F.explode(copies)).withColumn("_halo", F.col("_block") != block)


def next_value(df: DataFrame, by: Sequence[str], order: str, out: str, bucket: str = "_bk") -> DataFrame:
    """The next larger row's ``order`` value within the group (null for the last row).

    Groups are cut into buckets of the order value; the last row of a bucket
    takes the smallest value of the next non-empty bucket.
    """
    by = list(by)
    marked = with_buckets(df, cut_points(df, [order])).withColumnRenamed(f"_b_{order}", bucket)
    firsts = marked.groupBy(*by, bucket).agg(F.min(order).alias("_first"))
    after = firsts.select(*by, bucket, F.lead("_first").over(W.partitionBy(*by).orderBy(bucket)).alias("_after"))
    inside = W.partitionBy(*by, bucket).orderBy(order)
    joined = null_safe_join(marked, sized(after, OFFSET_ROWS), [*by, bucket])
    return joined.withColumn(out, F.coalesce(F.lead(order).over(inside), F.col("_after"))).drop(bucket, "_after")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on same-named keys where null matches null."""
    right = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        eq = left[k].eqNullSafe(right[f"_r_{k}"])
        cond = eq if cond is None else cond & eq
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
                      order_buckets: int = BUCKETS) -> DataFrame:
    """Exact interpolated quantiles per group as one plan: ``by`` columns + names of ``probs``."""
    by = list(by)
    if not by:
        return grouped_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, order_buckets).drop("_all")
    base = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    counts = written(base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    run = running(counts, by, "_v", {"_before": "_n"}, cuts=cut_points(counts, ["_v"], order_buckets)["_v"])
    size = counts.groupBy(*by).agg(F.sum("_n").alias("_size"))
    run = null_safe_join(run, sized(size), by)
    upto = F.col("_before") + F.col("_n")
    aggs = []
    for name, q in probs.items():
        h = (F.col("_size") - 1) * F.lit(float(q))
        aggs += [F.min(F.when(upto > F.floor(h), F.col("_v"))).alias(f"_lo_{name}"),
                 F.min(F.when(upto > F.ceil(h), F.col("_v"))).alias(f"_hi_{name}")]
    got = run.groupBy(*by, "_size").agg(*aggs)
    return got.select(*by, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
         * ((F.col("_size") - 1) * F.lit(float(q)) - F.floor((F.col("_size") - 1) * F.lit(float(q))))).alias(n)
        for n, q in probs.items()])


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str, count: str | None = None) -> DataFrame:
    """Distinct values of a group with their count ``_n`` and average rank (ties share it).

    ``count`` names a column that says how often a row counts.
    """
    n = F.sum(count) if count else F.count(F.lit(1))
    counts = written(df.groupBy(*by, value).agg(n.alias("_n")), "value-counts")
    run = running(counts, by, value, {"_before": "_n"})
    return run.withColumn(out, F.col("_before") + (F.col("_n") + 1) / 2).drop("_before")


# ---- order by a uniform hash -------------------------------------------------

def prefix_digits(n_rows: int, target: int = 50_000) -> int:
    """Hex digits so that one prefix holds about ``target`` rows."""
    return max(1, math.ceil(math.log(max(n_rows / target, 1), 16)))


FIRST_DIGITS = 4   # prefixes that are ordered together; longer ones are ordered below these


def hash_offsets(df: DataFrame, hash_col: str, by: Sequence[str], digits: int) -> DataFrame:
    """(by, _p, _count, _before) per hash prefix; hashes are uniform so prefixes are even.

    Long prefixes are counted in two levels: before the first digits, and inside them.
    """
    by = list(by)
    counts = (df.groupBy(*by, F.substring(hash_col, 1, digits).alias("_p"))
              .agg(F.count(F.lit(1)).alias("_count")))

    def earlier(value, group, order):
        w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(w), F.lit(0))
    if digits <= FIRST_DIGITS:
        return counts.withColumn("_before", earlier("_count", by, "_p"))
    counts = counts.withColumn("_first", F.substring("_p", 1, FIRST_DIGITS))
    first = counts.groupBy(*by, "_first").agg(F.sum("_count").alias("_n"))
    first = first.select(*by, "_first", earlier("_n", by, "_first").alias("_offset"))
    inner = counts.withColumn("_inner", earlier("_count", [*by, "_first"], "_p"))
    joined = null_safe_join(inner, first, [*by, "_first"])
    return joined.select(*by, "_p", "_count", (F.col("_offset") + F.col("_inner")).alias("_before"))


def hash_rank(df: DataFrame, hash_col: str | Column, out: str, by: Sequence[str] = (), digits: int | None = None,
              hot: Column | None = None, tasks: int = 1) -> DataFrame:
    """1-based exact rank of each row in hash order within its group.

    A hash given as an expression is not dealt to the ``tasks`` with the rows, but formed again
    where they arrive. ``hot`` marks the groups that are cut by prefix; any other has one window.
    """
    by = list(by)
    digits = digits or prefix_digits(df.count())
    prefix = F.substring(hash_col, 1, digits)
    marked = df.withColumn("_p", prefix if hot is None else F.when(hot, prefix).otherwise(""))
    if isinstance(hash_col, str):
        order, offsets = hash_col, hash_offsets(df if hot is None else df.where(hot), hash_col, by, digits)
    else:
        cut = (df if hot is None else df.where(hot)).select(*by, hash_col.alias("_hash"))
        order, offsets = "_hash", hash_offsets(cut, "_hash", by, digits)
        marked = marked.repartition(tasks, *by, "_p").withColumn("_hash", hash_col)
    w = W.partitionBy(*by, "_p").orderBy(order)
    offsets = sized(offsets.drop("_count"), OFFSET_ROWS)
    joined = null_safe_join(marked, offsets, [*by, "_p"], "inner" if hot is None else "left")
    ranked = joined.withColumn(out, F.coalesce("_before", F.lit(0)) + F.row_number().over(w)).drop("_p", "_before")
    return ranked if isinstance(hash_col, str) else ranked.drop("_hash")


def sized(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """Run a small result once and hand it out for broadcast joins.

    Up to ``limit`` rows are fetched; if there are more the plan itself is
    returned without a hint, so joins against it shuffle (and AQE splits skew).
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def hash_thresholds(df: DataFrame, hash_col: str, wanted: DataFrame, by: Sequence[str] = (),
                    digits: int | None = None) -> DataFrame:
    """``wanted`` rows (by..., rank) plus ``threshold``: the hash at that 1-based rank.

    Rank 0 gives the empty string, which no hash is below or equal to. Rows are
    never sorted or shuffled as a whole: prefix counts locate the prefix holding
    a rank, and only rows of those prefixes are ranked.
    """
    by = list(by)
    if not by:
        everything = F.lit(0).alias("_all")
        return hash_thresholds(df.select("*", everything), hash_col, wanted.select("*", everything), ["_all"],
                               digits).drop("_all")
    digits = digits or prefix_digits(df.count())
    wanted = sized(wanted.select(*by, "rank"))
    step = min(digits, FIRST_DIGITS)
    offsets = hash_offsets(df, hash_col, by, step)
    inside = (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_count"))
    located = null_safe_join(offsets, wanted, by).where(inside)
    located = sized(located.select(*by, "rank", "_p", "_before"))
    while step < digits:   # look into the prefixes found, by more digits
        prefix, step = F.substring(hash_col, 1, step), min(digits, step + FIRST_DIGITS - 1)
        rows = df.select(*by, prefix.alias("_p"), F.substring(hash_col, 1, step).alias("_q"))
        rows = null_safe_join(rows, located.select(*by, "_p").distinct(), [*by, "_p"], "left_semi")
        inner = rows.groupBy(*by, "_p", "_q").agg(F.count(F.lit(1)).alias("_count"))
        w = W.partitionBy(*by, "_p").orderBy("_q").rowsBetween(W.unboundedPreceding, -1)
        inner = inner.withColumn("_inner", F.coalesce(F.sum("_count").over(w), F.lit(0)))
        located = null_safe_join(inner, located, [*by, "_p"]).withColumn("_before", F.col("_before") + F.col("_inner"))
        located = sized(located.where(inside).select(*by, "rank", F.col("_q").alias("_p"), "_before"))
    rows = df.select(*by, F.col(hash_col).alias("threshold"), F.substring(hash_col, 1, digits).alias("_p"))
    rows = null_safe_join(rows, located.select(*by, "_p").distinct(), [*by, "_p"], "left_semi")
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_p").orderBy("threshold")))
    hits = null_safe_join(rows, located, [*by, "_p"]).where(F.col("_before") + F.col("_r") == F.col("rank"))
    zero = wanted.where("rank <= 0").select(*by, "rank", F.lit("").alias("threshold"))
    return sized(hits.select(*by, "rank", "threshold").unionByName(zero))


def take_first(df: DataFrame, hash_col: str, wanted: DataFrame, by: Sequence[str] = (),
               out: str = "first", digits: int | None = None) -> DataFrame:
    """Flag rows whose hash rank within the group is at most the group's ``rank``.

    ``wanted`` has one row per group. The flag is a comparison with the group's
    threshold hash, so the data itself is neither sorted nor shuffled.
    """
    by = list(by)
    limits = hash_thresholds(df, hash_col, wanted, by, digits).drop("rank")
    if not by:
        return df.withColumn(out, F.col(hash_col) <= F.lit(limits.first()["threshold"]))
    joined = null_safe_join(df, limits, by, "left")
    return joined.withColumn(out, F.coalesce(F.col(hash_col) <= F.col("threshold"), F.lit(False))).drop("threshold")
