"""Distribution reshaping: fitted per-column transforms.

Every ``fit_*`` reads its statistics for all columns in one or a few aggregates
and returns a :class:`Fitted` that rewrites the columns in place with Column
expressions.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from glob import glob
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import seeded_hash
from ..functions.normal import probit, probit_values
from ..functions.vectors import let, literal_array
from ..session import forget, mounted_folder, scratch_table, written
from .clean import TRANSFORMS, finite_col
from .features import Scale, fit_range
from .fitted import Chain, Fitted
from .ordered import (OFFSET_ROWS, as_of, cut_points, hash_thresholds, order_statistics, quantile_table, quantiles, sized,
                      with_buckets)

INLINE_KNOTS = 2_000       # knots of a column held as literals; more are a written table
PROBIT_CLIP = 5.19933758270342   # fixed value: probit(1 - 1e-7)
IQR_NORMAL = 1.3489795003921634  # fixed value: probit(.75) - probit(.25)
# fixed values: bandwidth factors offered by name
ALPHAS = (0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0, 5.0)


def stats(df: DataFrame, cols: Sequence[str], train: Column | None = None) -> dict[str, dict]:
    """count, mean, population and sample deviation, min, max of the finite values, in one aggregate."""
    aggs = [F.count(F.lit(1) if train is None else F.when(train, 1)).alias("rows")]
    for i, c in enumerate(cols):
        x = finite_col(F.col(c))
        x = x if train is None else F.when(train, x)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"p{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    return {c: {"rows": r["rows"], "n": r[f"n{i}"], "mean": r[f"m{i}"], "pop": r[f"p{i}"], "samp": r[f"s{i}"],
                "min": r[f"a{i}"], "max": r[f"b{i}"]} for i, c in enumerate(cols)}


@dataclass(frozen=True)
class Finite(Fitted):
    """NaN and infinities -> null, then null -> the fitted fill value (if any)."""

    fills: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: finite_col(F.col(c)) if v is None else F.coalesce(finite_col(F.col(c)), F.lit(v))
                               for c, v in self.fills.items()})


def fit_standard(df: DataFrame, cols: Sequence[str], center: bool = True, impute: bool = True) -> Chain:
    """Safe standard scaler: finite values, missing -> mean, (x - mean) / population deviation (0 -> 1).

    Without ``center`` only the deviation is divided out. The deviation is that
    of the imputed column.
    """
    params, fills = {}, {}
    for c, s in stats(df, cols).items():
        mean = s["mean"] if s["mean"] is not None else 0.0
        sd = (s["pop"] or 0.0) * (math.sqrt(s["n"] / s["rows"]) if impute and s["rows"] else 1.0)
        params[c] = [mean if center else 0.0, 1.0 / sd if sd > 0 else 1.0, 0.0]
        fills[c] = mean if impute else None
    return Chain([Finite(fills), Scale(params)])


def fit_normalise(df: DataFrame, cols: Sequence[str], train: Column | None = None) -> Scale:
    """z-score by training rows only: sample deviation + 1e-20, clipped to +-100; deviation 1 for one row."""
    params = {}
    for c, s in stats(df, cols, train).items():
        sd = (s["samp"] if s["n"] > 1 and s["samp"] is not None else 1.0) + 1e-20
        params[c] = [s["mean"] or 0.0, 1.0 / sd, 0.0]
    return Scale(params, "", [-100.0, 100.0])


def fit_minmax(df: DataFrame, cols: Sequence[str], lo: float = 0.1, hi: float = 1.0) -> Scale:
    return fit_range(df, cols, lo, hi, clip=True)


def fit_robust(df: DataFrame, cols: Sequence[str]) -> Scale:
    """(x - median) / (IQR / 1.349); a zero IQR counts as 1."""
    params = {}
    for c, q in quantiles(df, cols, [0.25, 0.5, 0.75]).items():
        lo, mid, hi = q or (0.0, 0.0, 0.0)
        params[c] = [mid, IQR_NORMAL / ((hi - lo) or 1.0), 0.0]
    return Scale(params)


# ---- knots: quantile and smoothed-CDF transforms ------------------------------

def _normal_levels(levels: pa.Array) -> pa.Array:
    """Normal scores of levels from 0 to 1, clipped at a ten-millionth."""
    p = levels.to_numpy(zero_copy_only=False)
    z = probit_values(np.clip(np.nan_to_num(p, nan=0.5), 1e-7, 1 - 1e-7))
    z = np.where(p <= 1e-7, -PROBIT_CLIP, np.where(p >= 1 - 1e-7, PROBIT_CLIP, z))
    return pa.array(z, mask=levels.is_null().to_numpy(zero_copy_only=False))


@dataclass(frozen=True)
class KnotMap(Fitted):
    """Piecewise linear map through distinct knots, optionally followed by the probit.

    A knot has a level on its left and right (they differ for tied quantiles);
    a value on a knot takes the middle, outer values take 0 or 1. Many knots are a
    written table. Executors that reach its folder by name look values up in sorted files beside
    it, mapped into memory; else the distinct values of a column meet it in an as-of join.
    """

    knots: dict   # column -> [knots, left levels, right levels]
    normal: bool = False
    # column -> [path, number of the column in it, first knot, last knot, cut points, folder of sorted files or None]
    tables: dict = field(default_factory=dict)

    @property
    def per_batch(self) -> bool:
        return bool(self.tables)

    @property
    def per_row(self) -> bool:
        return all(self._folder(c) for c in self.tables)

    def _folder(self, c: str) -> str | None:
        """Where a table's knots lie as files, if executors reach the folder by name."""
        return self.tables[c][5] if len(self.tables[c]) > 5 else None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.knots:
            df = df.withColumns({c: self._level(c)(F.col(c).cast("double")) for c in self.knots})
        read = [c for c in self.tables if self._folder(c)]
        if read:
            df = df.withColumns({c: self._read_level(c)(F.col(c).cast("double")) for c in read})
        joined = [c for c in self.tables if c not in read]
        for c in joined:
            df = self._joined(df, c)
        if self.normal and joined:
            normal = F.arrow_udf(_normal_levels, "double")
            df = df.withColumns({c: normal(c) for c in joined})
        return df

    def _read_level(self, c: str):
        """The map of a column whose knots lie in files, on Arrow batches; rows stay where they are."""
        (_, number, first, last, _, folder), normal = self.tables[c], self.normal

        def level(x: pa.Array) -> pa.Array:
            v = x.to_numpy(zero_copy_only=False).astype(np.float64)
            done = pa.array(_file_levels(v, folder, number, first, last), mask=x.is_null().to_numpy(zero_copy_only=False))
            return _normal_levels(done) if normal else done
        return F.arrow_udf(level, "double")

    def _level(self, c: str):
        """The map of a column with literal knots, on Arrow batches."""
        knots, left, right = (np.array(k, dtype=np.float64) for k in self.knots[c])
        normal = self.normal

        def level(x: pa.Array) -> pa.Array:
            v = x.to_numpy(zero_copy_only=False)
            i = np.clip(np.searchsorted(knots, v, side="right") - 1, 0, max(len(knots) - 2, 0))
            j = np.minimum(i + 1, len(knots) - 1)
            with np.errstate(all="ignore"):
                y = right[i] + (left[j] - right[i]) * (v - knots[i]) / (knots[j] - knots[i])
            y = np.where(v == knots[i], (left[i] + right[i]) / 2, y)
            y = np.where(v <= knots[0], 0.0, np.where((v >= knots[-1]) | np.isnan(v), 1.0, y))     # NaN comes behind all numbers
            done = pa.array(y, mask=x.is_null().to_numpy(zero_copy_only=False))
            return _normal_levels(done) if normal else done
        return F.arrow_udf(level, "double")

    def _joined(self, df: DataFrame, c: str) -> DataFrame:
        path, number, first, last, cuts = self.tables[c][:5]
        table = df.sparkSession.read.parquet(path).where(F.col("c") == number).select("v", "lo", "hi")
        x = F.col(c).cast("double")
        inside = df.select(x.alias("_x")).where((F.col("_x") > first) & (F.col("_x") < last)).distinct()
        found = as_of(inside, "_x", table, "v", cuts)
        between = (F.col("_x") - F.col("prev.v")) / (F.col("next.v") - F.col("prev.v"))
        level = F.when(F.col("_x") == F.col("prev.v"), (F.col("prev.lo") + F.col("prev.hi")) / 2).otherwise(
            F.col("prev.hi") + (F.col("next.lo") - F.col("prev.hi")) * between)
        joined = df.join(found.select("_x", level.alias("_level")), x == F.col("_x"), "left")
        y = F.when(x <= first, 0.0).when(x >= last, 1.0).otherwise(F.col("_level"))
        return joined.withColumn(c, F.when(x.isNotNull(), y)).drop("_x", "_level")


PIECE_KNOTS = 1_000_000     # knots of one file
KNOT_FILES = "_files"       # their folder below the table, which Spark's readers pass over


def _knot_files(table: DataFrame, folder: str) -> None:
    """Write knots (c, v, lo, hi) as files of sorted doubles: all v, all lo, all hi; files of a column sort by name."""
    def write(batches):
        part, found = TaskContext.get().partitionId(), {}
        for batch in batches:
            c, values = batch.column(0).to_numpy(), np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)])
            for number in np.unique(c):
                found.setdefault(int(number), []).append(values[:, c == number])
        for number, values in found.items():
            trial = f"{folder}/{uuid.uuid4().hex}"
            np.concatenate(values, axis=1).tofile(trial)
            os.replace(trial, f"{folder}/c{number}-{part:06d}.knots")
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(found)], pa.int64())})
    os.makedirs(folder, exist_ok=True)
    parts = table.select("c", "v", "lo", "hi").repartitionByRange(math.ceil(table.count() / PIECE_KNOTS), "c", "v").sortWithinPartitions("c", "v")
    parts.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


@lru_cache(maxsize=64)
def _knot_pieces(folder: str, number: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A column's files, mapped into memory, and the first knot of each with its levels."""
    pieces = [np.memmap(name, np.float64, "r").reshape(3, -1) for name in sorted(glob(f"{folder}/c{number}-*.knots"))]
    return pieces, np.array([p[:, 0] for p in pieces])


def _file_levels(x: np.ndarray, folder: str, number: int, first: float, last: float) -> np.ndarray:
    """Levels of values between knots that lie in files; a batch looks into each file in rising order."""
    pieces, firsts = _knot_pieces(folder, number)
    y = np.where(x <= first, 0.0, 1.0)      # NaN comes behind all numbers
    inside = np.flatnonzero((x > first) & (x < last))
    inside = inside[np.argsort(x[inside], kind="stable")]
    at = np.searchsorted(firsts[:, 0], x[inside], side="right") - 1
    for k in np.unique(at):
        mine = inside[np.searchsorted(at, k):np.searchsorted(at, k, side="right")]
        knots, left, right = pieces[k]
        v, i = x[mine], np.searchsorted(knots, x[mine], side="right") - 1
        j, beyond = np.minimum(i + 1, len(knots) - 1), i + 1 == len(knots)
        then = firsts[min(k + 1, len(firsts) - 1)]      # the knot behind a file's last one
        high, low = np.where(beyond, then[0], knots[j]), np.where(beyond, then[1], left[j])
        with np.errstate(all="ignore"):
            level = right[i] + (low - right[i]) * ((v - knots[i]) / (high - knots[i]))
        y[mine] = np.where(v == knots[i], (left[i] + right[i]) / 2, level)
    return y


def fit_quantile(df: DataFrame, cols: Sequence[str], n_quantiles=None, output: str = "uniform") -> KnotMap:
    """Quantile transform with exact knots over all rows.

    ``n_quantiles`` is a number or a function of the column's count (default n // 5).
    A few knots are read at their ranks; more than INLINE_KNOTS follow from the ranks
    of all distinct values and are written as a table. Knots that lie on few values are
    literals again, so that such a column needs no join.
    """
    def size(n):
        m = n_quantiles(n) if callable(n_quantiles) else n_quantiles or max(n // 5, 2)
        return max(2, min(m, n))

    cols = list(cols)
    row = df.agg(*[F.count(finite_col(F.col(c).cast("double"))).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    counts = {c: row[f"_{i}"] for i, c in enumerate(cols)}
    many = {c: n for c, n in counts.items() if size(n) > INLINE_KNOTS}
    few = [c for c in cols if c not in many]
    knots = {}
    for c, (r, values) in quantile_table(df, few, lambda n: np.linspace(0, 1, size(n)).tolist()).items() if few else ():
        if not values:
            knots[c] = [[0.0], [0.0], [0.0]]
            continue
        distinct, left, right = [], [], []
        for v, level in zip(values, r):
            if distinct and v <= distinct[-1]:
                right[-1] = level
            else:
                distinct.append(v)
                left.append(level)
                right.append(level)
        knots[c] = [distinct, left, right]
    tables = _knot_tables(df, {c: (n, size(n)) for c, n in many.items()}) if many else {}
    held = _few_knots(df, tables)
    tables = {c: t for c, t in tables.items() if c not in held}
    if tables:
        path = next(iter(tables.values()))[0]        # one table holds all columns
        folder = mounted_folder(df.sparkSession, f"{path}/{KNOT_FILES}")
        if folder:
            _knot_files(df.sparkSession.read.parquet(path).where(F.col("c").isin([t[1] for t in tables.values()])), folder)
        tables = {c: [*t, folder] for c, t in tables.items()}
    return KnotMap(knots | held, output == "normal", tables)


def _ranked_values(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, list[float]]]:
    """(c, x, _n, before, after), written: distinct finite values per column number, rows before, next larger value.

    Also the cut points of the columns that the values were ordered by.
    """
    finite = df.select(*[finite_col(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    names = [f"x{i}" for i in range(len(cols))]
    cuts = cut_points(finite, names)
    marked = with_buckets(finite, cuts)
    long = marked.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_b_x{i}").alias("b"), F.col(f"x{i}").alias("x"))
                                             for i in range(len(cols))])).alias("s")).select("s.*").where("x is not null")
    counts = written(long.groupBy("c", "b", "x").agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    buckets = counts.groupBy("c", "b").agg(F.sum("_n").alias("rows"), F.min("x").alias("first"))
    order = W.partitionBy("c").orderBy("b")      # one row per bucket
    buckets = buckets.select("c", "b", F.coalesce(F.sum("rows").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"),
                             F.lead("first").over(order).alias("then"))
    inside = W.partitionBy("c", "b").orderBy("x")
    earlier = F.coalesce(F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.join(sized(buckets, OFFSET_ROWS), ["c", "b"])
    ranked = ranked.select("c", "x", "_n", (F.col("o") + earlier).alias("before"), F.coalesce(F.lead("x").over(inside), F.col("then")).alias("after"))
    ranked = written(ranked, "value-ranks")
    forget(counts)
    return ranked, {c: cuts[name] for c, name in zip(cols, names)}


def _knot_tables(df: DataFrame, sizes: dict[str, tuple[int, int]]) -> dict:
    """column -> [path, number, first, last, cut points] of written knots (c, v, lo, hi), for columns with (count, knots).

    Knot i of m lies at position i (n - 1) / (m - 1) of the n sorted values. A distinct
    value takes all knots on its positions as one row; the knots between it and the
    next value, at most one since m <= n, are interpolated.
    """
    cols = list(sizes)
    ranked, cuts = _ranked_values(df, cols)
    pick = lambda k: F.get(F.array(*[F.lit(sizes[c][k] - 1).cast("decimal(38,0)") for c in cols]), F.col("c"))
    rows = ranked.select("c", "x", "after", pick(0).alias("l"), pick(1).alias("k"), F.col("before").cast("decimal(19,0)").alias("first"),
                         (F.col("before") + F.col("_n") - 1).cast("decimal(19,0)").alias("last"))
    rows = rows.selectExpr("c", "x", "after", "l", "k", "last", "(first * k + l - 1) div l as i0", "(last * k) div l as i1")
    rows = rows.selectExpr("c", "x", "after", "k", "i0", "i1", "i1 + 1 as i2",
                           "cast((i1 + 1) * l - last * k as double) / cast(k as double) as part")
    kd = F.col("k").cast("double")
    on = F.when(F.col("i0") <= F.col("i1"), F.struct(F.col("x").alias("v"), (F.col("i0") / kd).alias("lo"), (F.col("i1") / kd).alias("hi")))
    between = F.when((F.col("part") < 1) & (F.col("i2") <= F.col("k")) & F.col("after").isNotNull(), F.struct(
        (F.col("x") + (F.col("after") - F.col("x")) * F.col("part")).alias("v"), (F.col("i2") / kd).alias("lo"), (F.col("i2") / kd).alias("hi")))
    knots = rows.select("c", F.explode(F.array_compact(F.array(on, between))).alias("s")).groupBy("c", "s.v").agg(
        F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"))
    path = scratch_table(df.sparkSession, "knots")
    knots.write.parquet(path)
    forget(ranked)
    ends = df.sparkSession.read.parquet(path).groupBy("c").agg(F.min("v").alias("first"), F.max("v").alias("last")).collect()
    return {cols[r["c"]]: [path, r["c"], r["first"], r["last"], cuts[cols[r["c"]]]] for r in ends}


def _few_knots(df: DataFrame, tables: dict) -> dict:
    """column -> [knots, left levels, right levels] of the written tables with INLINE_KNOTS different values at most.

    A column of one value keeps its table; nothing lies between its ends.
    """
    if not tables:
        return {}
    path = next(iter(tables.values()))[0]        # one table holds all columns
    written_knots = df.sparkSession.read.parquet(path)
    sizes = {r["c"]: r["count"] for r in written_knots.groupBy("c").count().collect()}
    few = {t[1]: c for c, t in tables.items() if 1 < sizes[t[1]] <= INLINE_KNOTS}
    rows = written_knots.where(F.col("c").isin(list(few))).orderBy("c", "v").collect() if few else []
    return {c: [[r[k] for r in rows if r["c"] == number] for k in ("v", "lo", "hi")] for number, c in few.items()}


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])


CELLS = 16            # data cells and least knot distance per kernel width
RISE = 5e-4           # rise of the smoothed CDF between two knots that are further apart
KERNEL = 8.5          # kernel widths beyond which a value counts as passed, or as not yet reached


def _smoothed(at: np.ndarray, mean: np.ndarray, weight: np.ndarray, width: np.ndarray, reach: float) -> np.ndarray:
    """Sum of the cells' weights times their kernels' CDF; only cells within ``reach`` are evaluated."""
    passed = np.concatenate([[0.0], np.cumsum(weight)])
    low, high = np.searchsorted(mean, at - reach), np.searchsorted(mean, at + reach)
    return np.array([passed[i] + float(weight[i:j] @ _normal_cdf((x - mean[i:j]) / width[i:j])) for x, i, j in zip(at, low, high)])


def _kernel_knots(mean: np.ndarray, weight: np.ndarray, width: np.ndarray, h: float, low: float, high: float, alone: np.ndarray):
    """Knots and levels of the smoothed CDF, rescaled to 0..1 between ``low`` and ``high``.

    Starts from quantiles of the cells and values that fill a cell alone. An interval
    is halved until the CDF rises by less than RISE in it, which bounds the error of
    any monotone curve, or until it is a CELLS-th of the kernel, where the curvature
    bounds it to 0.242 / (8 CELLS ** 2).
    """
    share = np.cumsum(weight) / weight.sum()
    grid = np.unique(np.concatenate([[low, high], mean[np.searchsorted(share, np.linspace(0, 1, 201)[1:-1])], alone]))
    grid = grid[(grid >= low) & (grid <= high)]
    level = _smoothed(grid, mean, weight, width, KERNEL * float(width.max()))
    while True:
        gap, rise = np.diff(grid), np.diff(level)
        wide = np.flatnonzero((rise > RISE * (level[-1] - level[0])) & (gap > h / CELLS))
        middle = (grid[wide] + grid[wide + 1]) / 2
        middle = middle[(middle > grid[wide]) & (middle < grid[wide + 1])]
        if not len(middle):
            break
        grid = np.concatenate([grid, middle])
        level = np.concatenate([level, _smoothed(middle, mean, weight, width, KERNEL * float(width.max()))])
        order = np.argsort(grid)
        grid, level = grid[order], level[order]
    level = np.maximum.accumulate((level - level[0]) / (level[-1] - level[0]))
    return grid.tolist(), level.tolist()


def fit_kdi(df: DataFrame, cols: Sequence[str], alpha: float = 1.0, output: str = "uniform") -> KnotMap:
    """Kernel-density-integral transform: normal kernel of width alpha * deviation.

    The finite values are counted in cells of a sixteenth of the kernel, one combined
    aggregate; a cell stands for its values by their number, mean and variance. Only
    cells with values exist: for n rows fewer than 32 K / alpha + n / K^2 of them for
    every K, since at most n / K^2 rows lie beyond K deviations. The curve's knots
    follow its rise (:func:`_kernel_knots`), so a far value costs no resolution; a value
    that fills its cell alone is a knot, and its level is the exact kernel sum.
    """
    cols = list(cols)
    st = stats(df, cols)
    fits = [c for c in cols if st[c]["min"] is not None and st[c]["max"] > st[c]["min"] and st[c]["samp"]]
    knots = {c: [[st[c]["min"] or 0.0], [0.0], [0.0]] for c in cols}
    cells = []
    for i, c in enumerate(fits):
        lo, step = st[c]["min"], alpha * st[c]["samp"] / CELLS
        x = finite_col(F.col(c).cast("double"))
        cell = F.floor((x - F.lit(lo)) / F.lit(step))
        cells.append(F.struct(F.lit(i).alias("c"), cell.alias("b"), x.alias("x")))
    if not fits:
        return KnotMap(knots, output == "normal")
    long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("x is not null")
    found = long.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"),
                                       F.min("x").alias("low"), F.max("x").alias("high")).toArrow().to_pandas()
    for i, c in enumerate(fits):
        mine, h = found[found["c"] == i].sort_values("mean"), alpha * st[c]["samp"]
        single = (mine["low"] == mine["high"]).to_numpy()
        mean = np.where(single, mine["low"], mine["mean"])
        width = np.sqrt(h * h + np.where(single, 0.0, np.maximum(mine["var"], 0)))
        alone = mean[single] if single.sum() <= INLINE_KNOTS else np.zeros(0)
        grid, level = _kernel_knots(mean, mine["n"].to_numpy(float) / st[c]["n"], width, h, st[c]["min"], st[c]["max"], alone)
        knots[c] = [grid, level, level]
    return KnotMap(knots, output == "normal")


# ---- power transforms ---------------------------------------------------------

def _coarse() -> list[float]:
    return [round(-2 + 0.1 * i, 2) for i in range(41)]


def power_expr(x: Column, lam: Column, method: str) -> Column:
    """Yeo-Johnson or Box-Cox of one value."""
    near0, near2 = F.abs(lam) < 1e-9, F.abs(lam - 2) < 1e-9
    if method == "box-cox":
        return F.when(x > 0, F.when(near0, F.log(x)).otherwise((F.pow(x, lam) - 1) / F.when(~near0, lam)))
    up = F.when(near0, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.when(~near0, lam))
    down = F.when(near2, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / F.when(~near2, 2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def _power_of_log(x: Column, log: Column, lam: Column, method: str) -> Column:
    """The same from log x or log(1 + |x|), so a grid of exponents takes one logarithm per value."""
    if method == "box-cox":
        return F.when(F.abs(lam) < 1e-9, log).otherwise(F.expm1(lam * log) / F.when(F.abs(lam) >= 1e-9, lam))
    e = F.when(x >= 0, lam).otherwise(2 - lam)
    y = F.when(F.abs(e) < 1e-9, log).otherwise(F.expm1(e * log) / F.when(F.abs(e) >= 1e-9, e))
    return F.when(x >= 0, y).otherwise(-y)


def _inverse_power(y: float, lam: float, method: str) -> float:
    """The x whose power transform is y; NaN where no x has it, infinity where it is too large for a number."""
    def root(base: float, power: float) -> float:
        try:
            return base ** power if base > 0 else 0.0 if base == 0 and power > 0 else math.nan
        except OverflowError:
            return math.inf

    def grown(v: float) -> float:
        return math.exp(v) if v < 700 else math.inf
    if method == "box-cox":
        return grown(y) if abs(lam) < 1e-9 else root(lam * y + 1, 1 / lam)
    if y >= 0:
        return grown(y) - 1 if abs(lam) < 1e-9 else root(lam * y + 1, 1 / lam) - 1
    return 1 - (grown(-y) if abs(lam - 2) < 1e-9 else root(1 - (2 - lam) * y, 1 / (2 - lam)))


@dataclass(frozen=True)
class Power(Fitted):
    """Power transform, then (y - mean) / deviation; a null exponent leaves the column standardised only."""

    params: dict  # column -> [lambda or None, mean, deviation]
    method: str

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (lam, mean, sd) in self.params.items():
            x = finite_col(F.col(c))
            y = x if lam is None else power_expr(x, F.lit(float(lam)), self.method)
            out[c] = finite_col((y - F.lit(mean)) / F.lit(sd))
        return df.withColumns(out)

    def inverse_values(self, column: str, values: list[float]) -> list[float]:
        lam, mean, sd = self.params[column]
        return [v * sd + mean if lam is None else _inverse_power(v * sd + mean, lam, self.method) for v in values]


def _powers(x: np.ndarray, lam: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Power transforms of ``x`` by every exponent, one row each, and the logarithms that they need once."""
    log = np.log(x) if method == "box-cox" else np.log1p(np.abs(x))
    e = np.broadcast_to(lam[:, None], (len(lam), len(x)))
    e = e if method == "box-cox" else np.where(x >= 0, e, 2 - e)
    near0 = np.abs(e) < 1e-9
    y = np.where(near0, log, np.expm1(e * log) / np.where(near0, 1.0, e))
    return (y, log) if method == "box-cox" else (np.where(x >= 0, y, -y), np.sign(x) * log)


def _merged(a: tuple, b: tuple) -> tuple:
    """Number, means, squared deviations, maxima and sum of logarithms of two parts together."""
    (n, mean, m2, top, jac), (n_b, mean_b, m2_b, top_b, jac_b) = a, b
    gap, both = mean_b - mean, n + n_b
    return both, mean + gap * (n_b / both), m2 + m2_b + gap * gap * (n * n_b / both), np.maximum(top, top_b), jac + jac_b


def _power_profile(df: DataFrame, cols: Sequence[str], grids: dict[str, list[float]], method: str):
    """(column, lambda) -> log-likelihood, mean, deviation, max, in one pass.

    A task transforms the distinct values of an Arrow batch by the whole grid and keeps
    five numbers per column and exponent; what the tasks have found is merged by column.
    """
    lams = [np.array(grids[c], dtype=np.float64) for c in cols]
    schema = "c int, n long, mean array<double>, m2 array<double>, top array<double>, jac double"

    def table(found: dict) -> pa.Table:
        rows = [(c, int(n), mean.tolist(), m2.tolist(), top.tolist(), float(jac)) for c, (n, mean, m2, top, jac) in found.items()]
        types = [pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64()]
        return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(
            zip(("c", "n", "mean", "m2", "top", "jac"), types))})

    def partial(batches):
        found: dict = {}
        for batch in batches:
            for c, lam in enumerate(lams):
                x, w = np.unique(batch.column(c).drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                some = x > 0 if method == "box-cox" else np.ones(len(x), bool)
                x, w = x[some], w[some].astype(np.float64)
                if not len(x):
                    continue
                with np.errstate(all="ignore"):
                    y, log = _powers(x, lam, method)
                    mean = y @ w / w.sum()
                    one = w.sum(), mean, np.square(y - mean[:, None]) @ w, y.max(axis=1), float(log @ w)
                    found[c] = _merged(found[c], one) if c in found else one
        yield from table(found).to_batches()

    def together(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        parts = [(r["n"], *(np.array(r[k]) for k in ("mean", "m2", "top")), r["jac"]) for r in rows]
        with np.errstate(all="ignore"):
            whole = parts[0]
            for other in parts[1:]:
                whole = _merged(whole, other)
        return table({rows[0]["c"]: whole})

    values = df.select(*[finite_col(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    got = values.mapInArrow(partial, schema).groupBy("c").applyInArrow(together, schema).collect()      # one row per column
    out: dict = {c: {} for c in cols}
    for r in got:
        for lam, mean, m2, top in zip(grids[cols[r["c"]]], r["mean"], r["m2"], r["top"]):
            sd = math.sqrt(m2 / r["n"]) if m2 >= 0 else math.nan
            # a deviation at the level of rounding is that of a constant column
            if sd and math.isfinite(sd) and sd > 1e-10 * abs(mean):
                ll = -r["n"] / 2 * math.log(sd * sd) + (lam - 1) * r["jac"]
                out[cols[r["c"]]][round(lam, 2)] = (ll, mean, sd, top)
    return out


def _best_exponents(df: DataFrame, cols: Sequence[str], method: str) -> dict[str, tuple]:
    """Column -> (exponent of maximum likelihood to 0.01, its profile entry).

    The grid starts as -2..2 by 0.1. While the last exponent tried on a side is
    as good as any, ever wider grids (steps 1, 10, ..) are appended there; then
    the step around the best is cut to a tenth until it is 0.01. Widening ends
    where results are not finite, or where doubles no longer hold 0.01.
    """
    def top(p):
        return max(p, key=lambda k: (round(p[k][0], 6), -k))

    grids, step = {c: _coarse() for c in cols}, dict.fromkeys(cols, 0.1)
    ends = {c: [-2.0, 2.0] for c in cols}
    seen: dict = {c: {} for c in cols}
    near: dict = {}
    while grids:
        found, todo = _power_profile(df, list(grids), grids, method), {}
        for c, p in found.items():
            seen[c].update(p)
            if not seen[c]:
                continue
            at = top(seen[c])
            sides = [k for k, end in enumerate(ends[c])
                     if end in seen[c] and round(seen[c][end][0], 6) == round(seen[c][at][0], 6)]
            if not sides or step[c] > 1e10:
                near[c] = at
                continue
            step[c] = 1.0 if step[c] < 1 else step[c] * 10
            todo[c] = []
            for k in sides:
                todo[c] += [round(ends[c][k] + (2 * k - 1) * i * step[c], 2) for i in range(1, 41)]
                ends[c][k] = todo[c][-1]
        grids = todo
    out: dict = {}
    while near:
        grids = {}
        for c, at in near.items():
            step[c] /= 10
            grids[c] = [round(at + step[c] * i, 2) for i in range(-10, 11)]
        found, near = _power_profile(df, list(grids), grids, method), {}
        for c, p in found.items():
            if p:
                at = top(p)
                out[c] = (at, p[at])
                if step[c] > 0.015:
                    near[c] = at
    return out


def fit_power(df: DataFrame, cols: Sequence[str], method: str = "yeo-johnson", safe: bool = False) -> Power:
    """Exponent of maximum likelihood to 0.01, without bounds, then unit variance.

    ``safe`` leaves a column untransformed if its result would not have unit
    variance or would exceed 100 deviations.
    """
    cols = list(cols)
    params = {c: [None, 0.0, 1.0] for c in cols}
    for c, (lam, (_, mean, sd, top)) in _best_exponents(df, cols, method).items():
        if safe and (not math.isfinite(top) or (top - mean) / sd > 100):
            continue
        params[c] = [lam, mean, sd]
    return Power(params, method)


def fit_box_cox(df: DataFrame, cols: Sequence[str], safe: bool = False) -> Chain:
    """Min-max into (0.1, 1), then Box-Cox."""
    scale = fit_minmax(df, cols)
    return Chain([scale, fit_power(scale.transform(df), cols, "box-cox", safe)])


# ---- linear algebra -----------------------------------------------------------

def gram(df: DataFrame, vector: Column, width: int) -> np.ndarray:
    """Sum over rows of v v': per-batch matrix products on executors, summed per matrix row by Spark."""
    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(np.float64)
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    parts = df.select(vector.cast("array<double>").alias("v")).mapInPandas(partial, "i int, row array<double>")
    rows = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect()
    out = np.zeros((width, width))
    for r in rows:  # width x width numbers
        out[r["i"]] = r["row"]
    return out


def _fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns flipped so that their largest loading is positive."""
    at = np.abs(vectors).argmax(axis=0)
    signs = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1, signs)


@dataclass(frozen=True)
class Combine(Fitted):
    """New columns as fixed linear combinations of scaled columns."""

    cols: list
    scales: list
    loadings: list  # one list of weights per output
    fills: list
    prefix: str = "svd"

    def names(self) -> list[str]:
        return [f"{self.prefix}_{j}" for j in range(len(self.loadings))]

    def transform(self, df: DataFrame) -> DataFrame:
        x = [F.coalesce(finite_col(F.col(c)), F.lit(f)) / F.lit(s) for c, s, f in zip(self.cols, self.scales, self.fills)]
        if len(self.cols) * len(self.loadings) > PRODUCT_TERMS:
            return self._product(df, x)
        out = {}
        for name, weights in zip(self.names(), self.loadings):
            total = F.lit(0.0)
            for xi, w in zip(x, weights):
                total = total + xi * F.lit(w)
            out[name] = total
        return df.withColumns(out)

    def _product(self, df: DataFrame, x: list[Column]) -> DataFrame:
        """Many outputs of many columns: one matrix product per Arrow batch instead of an expression per term."""
        weights = np.array(self.loadings).T

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(v.to_numpy()).astype(np.float64) @ weights) if len(v) else [], dtype=object)
        scored = df.withColumn("_scores", project(F.array(*[xi.cast("double") for xi in x])))
        return scored.withColumns({name: F.get("_scores", F.lit(j)) for j, name in enumerate(self.names())}).drop("_scores")


PRODUCT_TERMS = 256    # terms of linear combinations that are written out as expressions
GRAM_WIDTH = 1_024     # columns whose whole Gram matrix is formed; more are reduced to a range first
EXTRA = 10             # directions of the range beyond those wanted
PASSES = 30            # passes over the rows at most


def range_vectors(df: DataFrame, vector: Column, width: int, k: int, seed: int = 0, settled: float = 1e-9) -> np.ndarray:
    """The k leading right singular vectors, as columns, without a width x width matrix.

    A randomized range of k + EXTRA directions is multiplied by the Gram matrix, one
    pass over the rows each, and made orthogonal by a tall, thin QR on the driver
    (width x (k + EXTRA) numbers), until the wanted directions stand still.
    """
    size = min(width, k + EXTRA)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    for _ in range(PASSES):
        z = _gram_times(df, vector, q)
        values, inner = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        top = q @ inner[:, np.argsort(values)[::-1][:k]]
        after = np.linalg.qr(z)[0]
        if np.linalg.norm(top - after @ (after.T @ top)) < settled:
            break
        q = after
    return top


def _gram_times(df: DataFrame, vector: Column, q: np.ndarray) -> np.ndarray:
    """Sum over rows of v (v' q): per-task products, summed per matrix row by Spark."""
    def partial(batches):
        total = np.zeros(q.shape)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(np.float64)
                total += x.T @ (x @ q)
        yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    parts = df.select(vector.cast("array<double>").alias("v")).mapInPandas(partial, "i int, row array<double>")
    rows = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect()
    out = np.zeros(q.shape)
    for r in rows:  # width x directions numbers
        out[r["i"]] = r["row"]
    return out


def leading_vectors(df: DataFrame, vector: Column, width: int, k: int) -> np.ndarray:
    """The k leading right singular vectors with fixed signs, from the Gram matrix or, for wide tables, a range."""
    if width > GRAM_WIDTH:
        return _fixed_signs(range_vectors(df, vector, width, k))
    values, vectors = np.linalg.eigh(gram(df, vector, width))
    return _fixed_signs(vectors[:, np.argsort(values)[::-1][:k]])


def fit_svd(df: DataFrame, cols: Sequence[str], k: int | None = None) -> Combine | None:
    """Truncated SVD scores next to the originals; k = max(1, min(n // 10 + 1, f // 2)), none below two columns."""
    cols = list(cols)
    if len(cols) < 2:
        return None
    st = stats(df, cols)
    n = st[cols[0]]["rows"]
    k = k or max(1, min(n // 10 + 1, len(cols) // 2))
    fills = [st[c]["mean"] or 0.0 for c in cols]
    scales = [((st[c]["pop"] or 0.0) * math.sqrt(st[c]["n"] / n) if n else 0.0) or 1.0 for c in cols]
    vector = F.array(*[F.coalesce(finite_col(F.col(c)), F.lit(f)) / F.lit(s) for c, f, s in zip(cols, fills, scales)])
    return Combine(cols, scales, leading_vectors(df, vector, len(cols), k).T.tolist(), fills)


@dataclass(frozen=True)
class VectorProjection(Fitted):
    """(v - mean) times a loading matrix, in Arrow batches."""

    column: str
    out: str
    mean: list
    loadings: list  # k lists of d weights

    def transform(self, df: DataFrame) -> DataFrame:
        mean, weights = np.array(self.mean), np.array(self.loadings).T

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            return pd.Series(list((np.stack(v.to_numpy()).astype(np.float64) - mean) @ weights))
        return df.withColumn(self.out, project(F.col(self.column).cast("array<double>")))


def fit_pca(df: DataFrame, vector: str, k: int, out: str = "pca") -> VectorProjection:
    """Principal components of an embedding column, centred; one pass for mean and covariance."""
    width = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()[0]
    # a trailing 1 makes the last Gram row the column sums and the count
    g = gram(df.where(F.col(vector).isNotNull()), F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0))), width + 1)
    n, sums = g[-1, -1], g[-1, :-1]
    mean = sums / n
    cov = (g[:-1, :-1] - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    top = _fixed_signs(vectors[:, np.argsort(values)[::-1][:k]])
    return VectorProjection(vector, out, mean.tolist(), top.T.tolist())


# ---- clipping, targets, bins --------------------------------------------------

@dataclass(frozen=True)
class SoftClip(Fitted):
    """Values beyond [lo, hi] are compressed to the bound plus or minus log(1 + |x|)."""

    bounds: dict

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (lo, hi) in self.bounds.items():
            x = F.col(c).cast("double")
            raised = F.greatest(F.lit(lo) - F.log1p(F.abs(x)), x)
            out[c] = F.when(x.isNotNull(), F.least(F.lit(hi) + F.log1p(F.abs(raised)), raised))
        return df.withColumns(out)


def fit_soft_clip(df: DataFrame, cols: Sequence[str], n_sigma: float = 12.0, train: Column | None = None) -> SoftClip:
    """Bounds mean +- n sample deviations of the training rows, re-estimated without the outside values."""
    first = stats(df, cols, train)
    bounds = {c: (s["mean"] - n_sigma * (s["samp"] or 0.0), s["mean"] + n_sigma * (s["samp"] or 0.0))
              for c, s in first.items() if s["mean"] is not None}
    inside = df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in bounds.items()})
    second = stats(inside, list(bounds), train)
    return SoftClip({c: [s["mean"] - n_sigma * (s["samp"] or 0.0), s["mean"] + n_sigma * (s["samp"] or 0.0)]
                     for c, s in second.items()})


def fit_target_scale(df: DataFrame, c: str, suffix: str = "_z") -> Scale:
    """(y - mean) / (population deviation + 1e-20); ``inverse`` undoes it."""
    s = stats(df, [c])[c]
    return Scale({c: [s["mean"], 1.0 / ((s["pop"] or 0.0) + 1e-20), 0.0]}, suffix)


@dataclass(frozen=True)
class Bins(Fitted):
    """Right-closed bins (e_i, e_i+1] -> 0..n-1; outside -> null."""

    column: str
    edges: list
    out: str

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.col(self.column).cast("double")
        below = F.size(F.filter(literal_array(self.edges), lambda e: e < x))
        return df.withColumn(self.out, F.when((x > self.edges[0]) & (x <= self.edges[-1]), below - 1))


def fit_quantile_bins(df: DataFrame, c: str, n: int = 10, first_edge: float | None = 0.0, out: str | None = None) -> Bins:
    """Bins between the quantiles 0, 1/n, .., 1; the first edge is set to 0."""
    edges = quantiles(df, [c], [i / n for i in range(n + 1)])[c]
    if first_edge is not None:
        edges[0] = first_edge
    return Bins(c, edges, out or f"{c}_bin")


def bucket_borders(df: DataFrame, c: str, k: int, key: str | None = None, full_range: tuple | None = None,
                   equal_mass: bool = True, widen: float | None = None, seed: int = 0) -> list[float]:
    """K + 1 borders of a histogram distribution.

    Equal mass: borders half way between neighbouring buckets of n/K sorted
    values; n mod K rows (the last in seeded key order) are left out first.
    Equal width: evenly over ``full_range``.
    """
    if not equal_mass:
        lo, hi = full_range if full_range else ((s := stats(df, [c])[c])["min"], s["max"])
        return [lo + i * (hi - lo) / k for i in range(k)] + [hi]
    rows = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    n = rows.count()
    if n <= k:
        raise ValueError(f"{n} values are too few for {k} buckets")
    if n % k:
        if key is None:
            raise ValueError("a key is needed to choose the rows left out")
        marked = rows.withColumn("_h", seeded_hash(seed, key))
        wanted = df.sparkSession.createDataFrame([(n - n % k,)], "rank long")
        limit = hash_thresholds(marked, "_h", wanted).first()["threshold"]
        rows, n = marked.where(F.col("_h") <= limit), n - n % k
    s = n // k
    ranks = sorted({0, n - 1, *[i * s - 1 for i in range(1, k)], *[i * s for i in range(1, k)]})
    at = order_statistics(rows, {c: ranks})[c][1]
    lo, hi = full_range if full_range else (at[0], at[n - 1])
    if lo > at[0] or hi < at[n - 1]:
        raise ValueError("full_range does not cover the values")
    borders = [lo, *[(at[i * s - 1] + at[i * s]) / 2 for i in range(1, k)], hi]
    return [b * widen for b in borders] if widen else borders


def median_skew(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """3 (mean - median) / population deviation per column."""
    medians = quantiles(df, cols, [0.5])
    return {c: 3 * (s["mean"] - medians[c][0]) / s["pop"] if s["pop"] else 0.0 for c, s in stats(df, cols).items()}


TAIL_RANKS = 8    # ranks at either end whose normal scores are summed one by one


def _score_sum(first: Column, last: Column, n: Column) -> Column:
    """Sum of the normal scores of the ranks first..last of n, probit((i - 0.375) / (n + 0.25)).

    A long run is the integral of the scores, minus the density's difference, with the
    first Euler-Maclaurin term; the steep ends are summed one by one.
    """
    at = lambda t: probit((t - 0.375) / (n + 0.25))
    each = lambda a, b: F.when(a <= b, F.aggregate(F.transform(F.sequence(a, b), at), F.lit(0.0), lambda s, z: s + z)).otherwise(0.0)
    density = lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    a, b = F.greatest(first, F.lit(TAIL_RANKS + 1).cast("long")), F.least(last, n - TAIL_RANKS)
    ends = F.transform(F.array(a - 0.5, b + 0.5), lambda t: density(at(t)))
    long = let(ends, lambda d: (n + 0.25) * (d[0] - d[1]) - (1 / d[1] - 1 / d[0]) / (n + 0.25) / 24)
    split = (each(first, F.least(last, F.lit(TAIL_RANKS).cast("long"))) + F.when(a <= b, long).otherwise(0.0)
             + each(F.greatest(first, n - TAIL_RANKS + 1), last))
    return F.when(first == last, at(first)).when(last - first < 2 * TAIL_RANKS, each(first, last)).otherwise(split)


def _score_squares(n: int, ends: int = 2_000) -> float:
    """Sum of the squared normal scores of the ranks 1..n; the middle of a long table by its integral."""
    normal = NormalDist()
    at = lambda t: normal.inv_cdf((t - 0.375) / (n + 0.25))
    if n <= 2 * ends:
        return sum(at(i) ** 2 for i in range(1, n + 1))
    z = [at(ends + 0.5), at(n - ends + 0.5)]
    middle = [normal.cdf(v) - v * normal.pdf(v) for v in z]
    return 2 * sum(at(i) ** 2 for i in range(1, ends + 1)) + (n + 0.25) * (middle[1] - middle[0])


def _normality(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Shapiro-Francia W' per column: squared correlation of all finite values with normal scores; 0 if undefined."""
    ranked, _ = _ranked_values(df, cols)
    first = _value_moments(ranked)
    found = _normal_likeness(ranked, first, len(cols), list(first))
    return {c: found.get(i, 0.0) for i, c in enumerate(cols)}


def _value_moments(ranked: DataFrame) -> dict:
    """Per column number of written value ranks: distinct values u, rows n, mean, low, high."""
    return {r["c"]: r for r in ranked.groupBy("c").agg(
        F.count(F.lit(1)).alias("u"), F.sum("_n").alias("n"), (F.sum(F.col("x") * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.min("x").alias("low"), F.max("x").alias("high")).collect()}


def _per_column(first: dict, name: str, width: int) -> Column:
    """One number per column, looked up by the column's number."""
    return F.get(literal_array([float(first[i][name]) if i in first else 0.0 for i in range(width)]), F.col("c"))


def _normal_likeness(ranked: DataFrame, first: dict, width: int, some: list[int]) -> dict[int, float]:
    """W' of some columns of at least three rows and two values, one sum per run of equal values."""
    n, d = _per_column(first, "n", width).cast("long"), F.col("x") - _per_column(first, "mean", width)
    scores = _score_sum(F.col("before") + 1, F.col("before") + F.col("_n"), n)
    rows = ranked.where(F.col("c").isin(some)).select("c", d.alias("d"), "_n", scores.alias("s"))
    found = rows.groupBy("c").agg(F.sum(F.col("d") * F.col("s")).alias("p"), F.sum(F.col("d") * F.col("d") * F.col("_n")).alias("q"))
    return {r["c"]: r["p"] ** 2 / (r["q"] * _score_squares(first[r["c"]]["n"])) for r in found.collect()  # one row per column
            if first[r["c"]]["n"] >= 3 and r["q"] and math.isfinite(r["q"])}


def column_shape(df: DataFrame, cols: Sequence[str], key: str | None = None) -> dict[str, str]:
    """ordinal, skewed_pos_1_0, skewed_pos, skewed, normal or other, tested in that order.

    Every test looks at all rows, so no ``key`` is needed to choose some; it is
    accepted for callers that have one. All of them read one written table of distinct
    values with their ranks. Normality is the Shapiro-Francia W', the squared
    correlation of the finite values with normal scores, summed per run of equal values.
    """
    cols = list(cols)
    out = {c: "ordinal" for c in cols}
    if not cols:
        return out
    ranked, _ = _ranked_values(df, cols)
    odd = lambda c: [F.max(F.when(t, 1).otherwise(0)) for t in (
        F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.col(c).cast("double") == math.inf, F.col(c).cast("double") == -math.inf)]
    extra = df.agg(*[sum(odd(c)).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    first = _value_moments(ranked)
    rest = [i for i in first if first[i]["u"] + (extra[f"_{i}"] or 0) >= 10]
    if not rest:
        return out
    middle = (_per_column(first, "n", len(cols)).cast("long") - 1) / 2
    upto = F.col("before") + F.col("_n")
    second = {r["c"]: r for r in ranked.where(F.col("c").isin(rest)).groupBy("c").agg(
        F.sum(F.col("_n") * F.pow(F.col("x") - _per_column(first, "mean", len(cols)), 2)).alias("squares"),
        F.min(F.when(upto > F.floor(middle), F.col("x"))).alias("a"), F.min(F.when(upto > F.ceil(middle), F.col("x"))).alias("b")).collect()}
    even = []
    for i in rest:
        lo, hi, pop = first[i]["low"], first[i]["high"], math.sqrt(second[i]["squares"] / first[i]["n"])
        skew = 3 * (first[i]["mean"] - (second[i]["a"] + second[i]["b"]) / 2) / pop if pop else 0.0
        if skew > 1.1:
            out[cols[i]] = "skewed_pos_1_0" if lo >= 0 and hi <= 1 else "skewed_pos" if lo > 0 else "skewed"
        else:
            even.append(i)
    for i, w in (_normal_likeness(ranked, first, len(cols), even) if even else {}).items():
        out[cols[i]] = "normal" if w > 0.95 else "other"
    for i in even:
        if out[cols[i]] == "ordinal":     # no likeness: constant but for values that are not finite
            out[cols[i]] = "other"
    return out


# ---- named transforms ---------------------------------------------------------

@dataclass(frozen=True)
class Elementwise(Fitted):
    """A named function in place; results that are not finite become null."""

    cols: list
    fn: str

    def transform(self, df: DataFrame) -> DataFrame:
        apply = TRANSFORMS[self.fn][0]
        return df.withColumns({c: finite_col(apply(F.col(c).cast("double"))) for c in self.cols})


@dataclass(frozen=True)
class Union(Fitted):
    """Two transforms of the same columns side by side: suffix per part."""

    cols: list
    parts: dict  # suffix -> Fitted

    @property
    def per_batch(self) -> bool:
        return any(part.per_batch for part in self.parts.values())

    @property
    def per_row(self) -> bool:
        return all(part.per_row for part in self.parts.values())

    def names(self) -> list[str]:
        return [c + s for s in self.parts for c in self.cols]

    def transform(self, df: DataFrame) -> DataFrame:
        for suffix, part in self.parts.items():
            held = df.withColumns({f"_hold_{c}": F.col(c) for c in self.cols})
            done = part.transform(held)
            df = done.withColumns({c + suffix: F.col(c) for c in self.cols}).withColumns(
                {c: F.col(f"_hold_{c}") for c in self.cols}).drop(*[f"_hold_{c}" for c in self.cols])
        return df.drop(*self.cols)


def fit_norm_and_kdi(df: DataFrame, cols: Sequence[str]) -> Union:
    norm = fit_quantile(df, cols, lambda n: max(n // 10, 2), "normal")
    return Union(list(cols), {"__norm": norm, "__kdi": fit_kdi(df, cols, 1.0, "uniform")})


def fit_adaptive(df: DataFrame, cols: Sequence[str], key: str) -> Chain:
    """A transform per column by its shape class."""
    shapes = column_shape(df, cols, key)
    by_class: dict[str, list[str]] = {}
    for c, s in shapes.items():
        by_class.setdefault(s, []).append(c)
    fits = {
        "skewed_pos_1_0": lambda cs: Elementwise(cs, "exp"),
        "skewed_pos": lambda cs: fit_box_cox(df, cs, safe=True),
        "skewed": lambda cs: fit_power(df, cs, "yeo-johnson", safe=True),
        "other": lambda cs: fit_quantile(df, cs, lambda n: max(n // 10, 2), "normal"),
    }
    return Chain([fits[s](cs) for s, cs in by_class.items() if s in fits])


def fit_named(df: DataFrame, cols: Sequence[str], name: str, key: str | None = None) -> Fitted:
    """A transform by its configuration name."""
    cols = list(cols)
    coarse, fine = (lambda n: max(n // 10, 2)), (lambda n: n)
    table = {
        "none": lambda: Chain([]),
        "power": lambda: fit_power(df, cols), "safepower": lambda: fit_power(df, cols, safe=True),
        "power_box": lambda: fit_box_cox(df, cols), "safepower_box": lambda: fit_box_cox(df, cols, safe=True),
        "log": lambda: Elementwise(cols, "log"), "1_plus_log": lambda: Elementwise(cols, "log1p"),
        "exp": lambda: Elementwise(cols, "exp"), "robust": lambda: fit_robust(df, cols),
        "quantile_uni_coarse": lambda: fit_quantile(df, cols, coarse),
        "quantile_norm_coarse": lambda: fit_quantile(df, cols, coarse, "normal"),
        "quantile_uni": lambda: fit_quantile(df, cols),
        "quantile_norm": lambda: fit_quantile(df, cols, None, "normal"),
        "quantile_uni_fine": lambda: fit_quantile(df, cols, fine),
        "quantile_norm_fine": lambda: fit_quantile(df, cols, fine, "normal"),
        "kdi": lambda: fit_kdi(df, cols, 1.0, "normal"), "kdi_uni": lambda: fit_kdi(df, cols, 1.0, "uniform"),
        "norm_and_kdi": lambda: fit_norm_and_kdi(df, cols),
        "adaptive": lambda: fit_adaptive(df, cols, key),
        **{f"kdi_alpha_{a}": (lambda a=a: fit_kdi(df, cols, a, "normal")) for a in ALPHAS},
        **{f"kdi_alpha_{a}_uni": (lambda a=a: fit_kdi(df, cols, a, "uniform")) for a in ALPHAS},
    }
    if name in table:
        return table[name]()
    if name in TRANSFORMS:
        return Elementwise(cols, name)
    if name.startswith("kdi_random_alpha"):
        raise ValueError(f"{name} is not defined; choose a fixed bandwidth such as kdi_alpha_0.5")
    raise ValueError(f"unknown transform {name!r}, known: {sorted([*table, *TRANSFORMS])}")
