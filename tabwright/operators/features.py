"""Derived feature columns and feature selection."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F
from pyspark.sql.types import StringType

from ..functions.hashing import hash_int, seeded_hash
from ..session import forget, shuffles_dropped, written
from .fitted import Fitted
from .ordered import OFFSET_ROWS, hash_rank, prefix_digits, sized


def seeded_order(seed, names: Sequence) -> list:
    """Driver-side seeded permutation of a short list (columns, classes, configs)."""
    return sorted(names, key=lambda n: hashlib.md5(f"{seed}|{n}".encode()).hexdigest())


@dataclass(frozen=True)
class Scale(Fitted):
    """(x - shift) * factor + offset per column, optionally clipped."""

    params: dict  # column -> [shift, factor, offset]
    suffix: str = ""
    clip: list | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        def one(c, shift, factor, offset):
            x = (F.col(c).cast("double") - F.lit(shift)) * F.lit(factor) + F.lit(offset)
            if self.clip:
                x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(self.clip[0])), F.lit(self.clip[1])))
            return x
        return df.withColumns({c + self.suffix: one(c, *p) for c, p in self.params.items()})

    def inverse_values(self, column: str, values: list[float]) -> list[float]:
        shift, factor, offset = self.params[column]
        return [(v - offset) / factor + shift for v in values]

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c + self.suffix) - F.lit(o)) / F.lit(f) + F.lit(s)
                               for c, (s, f, o) in self.params.items()})


def fit_range(df: DataFrame, cols: Sequence[str], lo: float = 0.0, hi: float = 1.0,
              clip: bool = False, suffix: str = "") -> Scale:
    """Min-max into [lo, hi]; a constant column maps to ``lo``."""
    row = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    params = {}
    for i, c in enumerate(cols):
        a, b = row[f"a{i}"], row[f"b{i}"]
        a, b = (0.0, 0.0) if a is None else (float(a), float(b))
        params[c] = [a, (hi - lo) / (b - a) if b > a else hi - lo, lo]
    return Scale(params, suffix, [lo, hi] if clip else None)


def frequency_features(df: DataFrame, cols: Sequence[str], k: int = 4, base: float = 2.0,
                       max_wave: float = 4.0) -> DataFrame:
    """Sine and cosine of each column over k geometrically spaced wavelengths."""
    waves = [base**i / base ** (k - 1) * max_wave for i in range(k)]
    out = {}
    for c in cols:
        for i, w in enumerate(waves):
            angle = F.col(c).cast("double") * F.lit(2 * math.pi / w)
            out[f"{c}_sin{i}"], out[f"{c}_cos{i}"] = F.sin(angle), F.cos(angle)
    return df.withColumns(out)


@dataclass(frozen=True)
class Crosses(Fitted):
    """Originals divided by their standard deviation, and products of two of them."""

    scales: dict
    pairs: list

    def names(self) -> list[str]:
        return [f"{a}__x__{b}" for a, b in self.pairs]

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {c: F.col(c).cast("double") / F.lit(s) for c, s in self.scales.items()}
        return df.withColumns({**scaled, **{n: scaled[a] * scaled[b] for n, (a, b) in zip(self.names(), self.pairs)}})


def fit_crosses(df: DataFrame, cols: Sequence[str], max_features: int | None = None, seed: int = 0) -> Crosses:
    """Products x_i * x_j, i <= j, of std-scaled columns; at most ``max_features``, drawn by seed."""
    row = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in cols]).first()
    pairs = list(itertools.combinations_with_replacement(cols, 2))
    if max_features is not None and max_features < len(pairs):
        chosen = set(seeded_order(seed, [f"{a}|{b}" for a, b in pairs])[:max_features])
        pairs = [(a, b) for a, b in pairs if f"{a}|{b}" in chosen]
    return Crosses({c: row[c] or 1.0 for c in cols}, [list(p) for p in pairs])


FINGERPRINT_RANGE = 10**12
COPIES_AT_ONCE = 50_000   # copies of a row that are ranked in one window
ROWS_A_TASK = 250_000     # rows that one task ranks and prepares, on average


def _fingerprint(hash_hex: Column) -> Column:
    return F.pmod(hash_int(hash_hex, 15), F.lit(FINGERPRINT_RANGE)) / F.lit(float(FINGERPRINT_RANGE))


@dataclass(frozen=True)
class Fingerprint(Fitted):
    """Salted row hash in [0, 1) for rows seen after fitting; a narrow expression."""

    cols: list
    salt: int
    out: str = "fingerprint"

    def row_hash(self, copy: Column | None = None) -> Column:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.cols]
        return seeded_hash(self.salt, *parts, copy if copy is not None else F.lit(0))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, _fingerprint(self.row_hash()))

    def of_copy(self, df: DataFrame, copy: str) -> DataFrame:
        """Rows whose copies have been numbered from 0."""
        return df.withColumn(self.out, _fingerprint(self.row_hash(F.col(copy))))

    def transform_train(self, df: DataFrame, key: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Training rows: the i-th copy of a row hashes its copy number too.

        Only rows that occur more than once are ranked, or all if most rows or very many different
        ones do. Copies are ranked by hash of their key, in one window per row, but in (row, key-hash
        prefix) windows for a row with many copies, so that a row repeated a third of the time is
        still spread over many tasks. ``prepare`` makes the hashed columns from ``df``, row by row:
        only the columns of ``df`` are moved then, and prepared again where they arrive. ``df`` is
        read two to four times.
        """
        spark = df.sparkSession
        rows, back = (df, {c: F.col(f"`{c}`") for c in df.columns}) if prepare is None else _held(df, key)
        whole = (lambda d: d) if prepare is None else (lambda d: prepare(d.withColumns(back)))
        kept = rows.columns
        marked = whole(rows).select(*[f"`{c}`" for c in kept], F.unhex(self.row_hash()).alias("_row"))
        number = F.xxhash64("_row")     # rows whose numbers agree by chance are looked at, and told apart
        with shuffles_dropped(spark):
            counts, seen = marked.groupBy(number.alias("_id")).agg(F.count(F.lit(1)).alias("_n")), Observation()
            counts = counts.observe(seen, F.sum("_n").alias("rows"))
            repeated = written(counts.where("_n > 1"), "repeated-rows")
            many, most, copies = repeated.agg(F.count(F.lit(1)), F.max("_n"), F.sum("_n")).first()
        again, once, rows_seen = marked, None, seen.get["rows"] or 0
        split = many <= OFFSET_ROWS and 2 * (copies or 0) < rows_seen
        tasks = math.ceil(max(copies or 0 if split else rows_seen, 1) / ROWS_A_TASK)
        if split:
            few = sized(repeated.select("_id"), OFFSET_ROWS)
            same = number == F.col("_id")
            again, once = marked.join(few, same, "left_semi"), marked.join(few, same, "left_anti")
        hashed = seeded_hash(self.salt, back[key])
        if (most or 0) <= COPIES_AT_ONCE:
            again = again.repartition(tasks, "_row").withColumn("_key", hashed)
            again = again.withColumn("_copy", F.row_number().over(W.partitionBy("_row").orderBy("_key"))).drop("_key")
        else:
            with shuffles_dropped(spark):
                hot = sized(repeated.where(F.col("_n") > COPIES_AT_ONCE).select("_id"), OFFSET_ROWS)
                again = again.join(hot, number == F.col("_id"), "left")
                digits = prefix_digits(most, COPIES_AT_ONCE)
                again = hash_rank(again, hashed, "_copy", ["_row"], digits, F.col("_id").isNotNull(), tasks).drop("_id")
        ranked = again.withColumn("_copy", F.col("_copy").cast("long"))
        if once is not None:
            ranked = once.withColumn("_copy", F.lit(1).cast("long")).unionByName(ranked)
        done = whole(ranked).withColumn(self.out, _fingerprint(self.row_hash(F.col("_copy") - 1)))
        return done.drop("_row", "_copy", *(kept if prepare else []))


def _class(cols: Sequence[str]) -> Column:
    """Bytes that are equal for rows that are equal in the columns; a text goes with its length."""
    texts = [F.col(f"`{c}`").cast("string") for c in cols]
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])))


FEW_CLASSES = 4     # rows per class from which copies are numbered by class


def numbered_by_class(df: DataFrame, key: str, cols: Sequence[str], flags: Sequence[Column],
                      marks: Sequence[tuple[Callable[[DataFrame], DataFrame], Fingerprint]]) -> tuple[DataFrame, dict[str, Column]] | None:
    """Held rows with a copy number from 0 per flag, as :meth:`Fingerprint.transform_train` would count the flagged rows.

    Where the prepared rows of all marks, which share a salt, are equal if and only if rows are equal in
    ``cols``, they need not be prepared to be numbered, and are moved once for all marks. That is
    looked up on the different rows; none is returned if it does not hold, or if most rows differ.
    Rows without a flag are left out. Also how the columns are had again.
    """
    spark = df.sparkSession
    with shuffles_dropped(spark):
        counts, seen = df.groupBy(_class(cols).alias("_class")).agg(
            F.count(F.lit(1)).alias("_n"), *[F.first(F.col(f"`{c}`")).alias(c) for c in cols]), Observation()
        if df.groupBy().agg(F.approx_count_distinct(_class(cols), 0.02) * FEW_CLASSES > F.count(F.lit(1))).first()[0]:
            return None
        counts = written(counts.observe(seen, F.sum("_n").alias("rows"), F.max("_n").alias("most"), F.count(F.lit(1)).alias("classes")), "row-classes")
        total = seen.get
        for prepare, mark in marks:
            if prepare(counts.select(*[f"`{c}`" for c in cols])).select(mark.row_hash()).distinct().count() < total["classes"]:
                forget(counts)
                return None
        rows, back = _held(df, key)
        names = [f"_copy_{i}" for i in range(len(flags))]
        some, salt = reduce(Column.__or__, flags), marks[0][1].salt
        marked, parts = rows.withColumns(back).where(some).withColumn("_class", _class(cols)), [F.xxhash64("_class").alias("_id")]
        offsets = None
        if total["most"] > COPIES_AT_ONCE:
            hot = sized(counts.where(F.col("_n") > COPIES_AT_ONCE).select("_class", F.lit(True).alias("_hot")), OFFSET_ROWS)
            marked = marked.join(hot, "_class", "left")
            spread = F.when(F.col("_hot"), F.substring(seeded_hash(salt, key), 1, prefix_digits(total["most"], COPIES_AT_ONCE))).otherwise("")
            earlier = W.partitionBy("_class").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
            parts.append(spread.alias("_p"))
            sizes = marked.where("_hot").groupBy("_class", spread.alias("_p")).agg(
                *[F.count(F.when(flag, 1)).alias(n) for n, flag in zip(names, flags)])
            offsets = sized(sizes.select("_class", "_p", *[F.sum(n).over(earlier).alias(f"_before{n}") for n in names]), OFFSET_ROWS)
        forget(counts)
    by = ["_id", "_p"][:len(parts)]      # a constant prefix would not count as dealt by
    moved = marked.select(*[f"`{c}`" for c in rows.columns], *parts).repartition(math.ceil(total["rows"] / ROWS_A_TASK), *by)
    moved = moved.withColumns(back).withColumns({"_class": _class(cols), "_key": seeded_hash(salt, key)})
    if offsets is not None:
        moved = moved.join(offsets, ["_class", "_p"], "left")
    w = W.partitionBy(*by, "_class").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    before = lambda n: F.col(f"_before{n}") if offsets is not None else F.lit(None).cast("long")
    moved = moved.select(*[f"`{c}`" for c in rows.columns], *[
        (F.coalesce(before(n), F.lit(0)) + F.count(F.when(flag, 1)).over(w)).alias(n) for n, flag in zip(names, flags)])
    return moved, back


def _held(df: DataFrame, key: str) -> tuple[DataFrame, dict[str, Column]]:
    """The columns under names of their own, and how each one is had again.

    A text key of hex digits is held as bytes, which take half the room; any other stays as it is.
    """
    held, back = [], {}
    for i, c in enumerate(df.columns):
        x, name = F.col(f"`{c}`"), f"_in_{i}"
        if c == key and isinstance(df.schema[c].dataType, StringType):
            digits = F.coalesce(x.rlike("^([0-9a-f][0-9a-f])+$"), F.lit(False))
            held += [F.when(digits, F.unhex(x)).alias(name), F.when(~digits, x).alias(f"{name}_text")]
            back[c] = F.coalesce(F.lower(F.hex(name)), F.col(f"{name}_text"))
        else:
            held.append(x.alias(name))
            back[c] = F.col(name)
    return df.select(*held), back


@dataclass(frozen=True)
class DropColumns(Fitted):
    dropped: list

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


def fit_drop_constant(df: DataFrame, cols: Sequence[str]) -> DropColumns:
    """Drop columns that are all null, or single-valued without nulls."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.min(c).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    drop = [c for i, c in enumerate(cols)
            if row[f"n{i}"] == 0 or (row[f"n{i}"] == row["n"] and row[f"a{i}"] == row[f"b{i}"])]
    if len(drop) == len(cols):
        raise ValueError("all features are constant")
    return DropColumns(drop)


BLOCK_COLUMNS = 1_024     # columns that meet as many others in one pass over the rows


def correlations(df: DataFrame, cols: Sequence[str], block: int = BLOCK_COLUMNS) -> dict[tuple[str, str], float]:
    """Pearson correlation of every column pair (columns, not rows); null for pairs without variance.

    A row counts for the pairs in which both cells are there. The columns are cut into
    blocks; two blocks meet in one pass, whose tasks add up outer products.
    """
    cols = list(cols)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    mean = {c: means[f"_{i}"] or 0.0 for i, c in enumerate(cols)}
    mean = {c: m if math.isfinite(m) else 0.0 for c, m in mean.items()}
    blocks = [cols[at:at + block] for at in range(0, len(cols), block)]
    out = {}
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            r = _block_correlations(df, left, right, mean)
            place = {c: j for j, c in enumerate(right)}
            for a, first in enumerate(left):
                for second in (left[a + 1:] if right is left else right):
                    value = r[a, place[second]]
                    out[first, second] = None if np.isnan(value) else float(value)
    return out


def _block_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str], mean: dict) -> np.ndarray:
    """Correlations of every left with every right column, from sums of outer products of centred cells and their presence."""
    both = list(dict.fromkeys([*left, *right]))
    a, b = [both.index(c) for c in left], [both.index(c) for c in right]
    shape = (len(left), len(right))

    def partial(batches):
        sums = np.zeros((6, *shape))
        for batch in batches:
            if batch.num_rows:
                values = batch.column("v")
                x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(both))
                there = values.flatten().is_valid().to_numpy(zero_copy_only=False).astype(np.float64).reshape(x.shape)
                x = np.where(there > 0, x, 0.0)
                p, q, m, w = x[:, a], x[:, b], there[:, a], there[:, b]
                sums += np.stack([m.T @ w, p.T @ w, m.T @ q, (p * p).T @ w, m.T @ (q * q), p.T @ q])
        yield pa.RecordBatch.from_pydict({"i": np.arange(shape[0], dtype=np.int32),
                                          "row": list(sums.transpose(1, 0, 2).reshape(shape[0], -1))})

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    cells = F.array(*[F.col(f"`{c}`").cast("double") - F.lit(float(mean[c])) for c in both])
    parts = df.select(cells.alias("v")).mapInArrow(partial, "i int, row array<double>")
    rows = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).orderBy("i").collect()
    if not rows:
        return np.full(shape, np.nan)
    n, x, y, xx, yy, xy = np.array([r["row"] for r in rows]).reshape(shape[0], 6, shape[1]).transpose(1, 0, 2)
    with np.errstate(all="ignore"):
        vx, vy = xx - x * x / n, yy - y * y / n
        vx, vy = (np.where(v <= 1e-14 * s, 0.0, v) for v, s in ((vx, xx), (vy, yy)))   # constant where both cells are there
        return np.where(vx * vy > 0, (xy - x * y / n) / np.sqrt(vx * vy), np.nan)


def fit_drop_duplicate(df: DataFrame, cols: Sequence[str], threshold: float = 0.999) -> DropColumns:
    """Drop a column whose correlation with an earlier kept one exceeds the threshold."""
    corr = correlations(df, cols)
    kept: list[str] = []
    for c in cols:
        if not any((corr[(k, c)] or 0.0) > threshold for k in kept):
            kept.append(c)
    return DropColumns([c for c in cols if c not in kept])


def to_fixed_vector(df: DataFrame, cols: Sequence[str], width: int, group: int = 1, out: str = "vector",
                    used: int | None = None, root: bool = True) -> DataFrame:
    """Zero-padded vector scaled for its unused width, cut into groups of ``group`` entries.

    ``used`` is the number of non-constant features (at least 1), by default all.
    """
    if len(cols) > width:
        raise ValueError(f"{len(cols)} features do not fit width {width}")
    used = max(1, used if used is not None else len(cols))
    factor = math.sqrt(width / used) if root else width / used
    padded = math.ceil(width / group) * group
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(factor) for c in cols])
    flat = F.concat(values, F.array_repeat(F.lit(0.0), padded - len(cols)))
    grouped = F.transform(F.sequence(F.lit(0), F.lit(padded // group - 1)),
                          lambda i: F.slice(flat, i * group + 1, F.lit(group)))
    return df.withColumn(out, grouped)


def group_positions(cols: Sequence[str], categorical: Sequence[str], group: int) -> list[list[int]]:
    """Positions of the categorical columns inside each group of :func:`to_fixed_vector`."""
    count = math.ceil(len(cols) / group)
    return [[cols.index(c) - g * group for c in categorical if g * group <= cols.index(c) < (g + 1) * group]
            for g in range(count)]
