"""Statistics of histogram-shaped predictive distributions.

A row holds K logits; all rows share K + 1 borders. Each statistic is one fold
over the row's bars, so the work per row is K for any number of bars. With
``full_support`` the two end bars are half-normals whose scale puts half their
mass inside the end bar's width; CDF, quantiles and border translation treat
end bars as uniform in both forms.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as V
from ..functions.hashing import hash_unit, seeded_hash
from ..functions.normal import normal_cdf

HALF_NORMAL_MEDIAN = 0.6744897501960817  # fixed value: median of the half-normal with scale 1
HALF_NORMAL_MEAN = math.sqrt(2 / math.pi)


@dataclass(frozen=True)
class BarDistribution:
    """Column expressions over a prepared ``bars`` column of (p, l, r, i) structs."""

    borders: tuple
    full_support: bool = False
    column: str = "_bars"

    def __post_init__(self):
        b = self.borders
        if len(b) < 2 or any(y < x for x, y in zip(b, b[1:])):
            raise ValueError("borders must ascend")

    @property
    def k(self) -> int:
        return len(self.borders) - 1

    @property
    def scales(self) -> tuple[float, float]:
        b = self.borders
        return (b[1] - b[0]) / HALF_NORMAL_MEDIAN, (b[-1] - b[-2]) / HALF_NORMAL_MEDIAN

    def prepare(self, df: DataFrame, logits: str, temperature: float = 1.0) -> DataFrame:
        """Add the bars of a logits column; every statistic reads them."""
        edges = V.literal_array(self.borders)
        return df.withColumn("_p", V.softmax(logits, temperature)).withColumn(self.column, F.transform(
            "_p", lambda p, i: F.struct(p.alias("p"), F.get(edges, i).alias("l"), F.get(edges, i + 1).alias("r"),
                                        i.alias("i")))).drop("_p")

    def _sum(self, term) -> Column:
        return F.aggregate(F.col(self.column), F.lit(0.0), lambda acc, b: acc + b["p"] * term(b))

    def _ends(self, b, first, inner, last) -> Column:
        """A per-bar term with its own form in the half-normal end bars."""
        if not self.full_support:
            return inner
        return F.when(b["i"] == 0, first).when(b["i"] == self.k - 1, last).otherwise(inner)

    def cdf(self, y: Column) -> Column:
        def share(b):
            inside = F.try_divide(y - b["l"], b["r"] - b["l"])
            return F.when(y >= b["r"], 1.0).when(y <= b["l"], 0.0).otherwise(inside)
        return F.when(y.isNotNull(), self._sum(share))

    def bar_index(self, y: Column) -> Column:
        """Left-open bar of y; both outer borders belong to their end bar."""
        at = F.size(F.filter(V.literal_array(self.borders), lambda e: e < y)) - 1
        at = F.when(y == self.borders[0], 0).when(y == self.borders[-1], self.k - 1).otherwise(at)
        if self.full_support:
            at = F.least(F.greatest(at, F.lit(0)), F.lit(self.k - 1))
        return F.when(y.isNotNull(), at)

    def quantile(self, q: float | Column) -> Column:
        """First bar whose cumulative mass reaches q, linear inside."""
        q = q if isinstance(q, Column) else F.lit(float(q))
        start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("x"))

        def step(acc, b):
            reach = acc["cum"] + b["p"]
            last = b["i"] == self.k - 1  # rounding may leave the total just below q
            here = b["l"] + (b["r"] - b["l"]) * F.try_divide(q - acc["cum"], b["p"])
            x = F.when(acc["x"].isNotNull(), acc["x"]).when((reach >= q) | last, F.coalesce(here, b["l"]))
            return F.struct(reach.alias("cum"), x.alias("x"))
        return F.aggregate(F.col(self.column), start, step, lambda acc: acc["x"])

    def _quantile_at(self, q: Column) -> Column:
        return V.let(q, self.quantile)  # a computed level is evaluated once, not per bar

    def median(self) -> Column:
        return self.quantile(0.5)

    def interval(self, level: float = 0.682) -> Column:
        side = (1 - level) / 2
        return F.struct(self.quantile(side).alias("low"), self.quantile(1 - side).alias("high"))

    def upper_confidence(self, rest: float = (1 - 0.682) / 2, maximise: bool = True) -> Column:
        return self.quantile(1 - rest if maximise else rest)

    def mean(self) -> Column:
        s0, s1 = self.scales
        return self._sum(lambda b: self._ends(
            b, F.lit(self.borders[1] - s0 * HALF_NORMAL_MEAN), (b["l"] + b["r"]) / 2,
            F.lit(self.borders[-2] + s1 * HALF_NORMAL_MEAN)))

    def mean_of_square(self) -> Column:
        s0, s1 = self.scales
        spread = 1 - 2 / math.pi
        first = s0 * s0 * spread + (self.borders[1] - s0 * HALF_NORMAL_MEAN) ** 2
        last = s1 * s1 * spread + (self.borders[-2] + s1 * HALF_NORMAL_MEAN) ** 2
        return self._sum(lambda b: self._ends(
            b, F.lit(first), (b["l"] * b["l"] + b["r"] * b["r"] + b["l"] * b["r"]) / 3, F.lit(last)))

    def variance(self) -> Column:
        return self.mean_of_square() - self.mean() * self.mean()

    def mode(self) -> Column:
        """Middle of the densest bar, the first one on ties."""
        ranked = F.transform(F.col(self.column), lambda b: F.struct(
            F.try_divide(b["p"], b["r"] - b["l"]).alias("d"), (-b["i"]).alias("i"), ((b["l"] + b["r"]) / 2).alias("m")))
        return F.array_max(ranked)["m"]

    def log_density(self, y: Column) -> Column:
        """Log density at y, null outside bounded bars."""
        bar = F.get(F.col(self.column), self.bar_index(y))
        inner = F.log(bar["p"]) - F.log(bar["r"] - bar["l"])
        if not self.full_support:
            return F.when((y >= self.borders[0]) & (y <= self.borders[-1]), inner)

        def tail(d, s):
            d = F.greatest(d, F.lit(1e-8))
            return F.log(bar["p"]) + 0.5 * math.log(2 / math.pi) - math.log(s) - d * d / (2 * s * s)
        s0, s1 = self.scales
        return (F.when(bar["i"] == 0, tail(self.borders[1] - y, s0))
                .when(bar["i"] == self.k - 1, tail(y - self.borders[-2], s1)).otherwise(inner))

    def loss(self, y: Column) -> Column:
        """Negative log density; a missing target costs nothing."""
        return F.when(y.isNull() | F.isnan(y), 0.0).otherwise(-self.log_density(y))

    def density(self, y: Column) -> Column:
        return F.exp(self.log_density(y))

    def expected_improvement(self, best: float) -> Column:
        """E[(X - best)+]."""
        f = float(best)

        def inner(b):
            c = F.least(F.greatest(F.lit(f), b["l"]), b["r"])
            return F.try_divide((b["r"] * b["r"] - c * c) / 2 - f * (b["r"] - c), b["r"] - b["l"])
        (s0, s1), b1, b2 = self.scales, self.borders[1], self.borders[-2]
        d = b1 - f
        first = 0.0
        if d > 0:  # E[(d - H)+] for a half-normal H reaching to the left
            cdf = math.erf(d / s0 / math.sqrt(2))
            first = d * cdf - s0 * HALF_NORMAL_MEAN * (1 - math.exp(-d * d / (2 * s0 * s0)))
        e = f - b2
        if e <= 0:
            last = -e + s1 * HALF_NORMAL_MEAN
        else:
            last = s1 * HALF_NORMAL_MEAN * math.exp(-e * e / (2 * s1 * s1)) - e * math.erfc(e / s1 / math.sqrt(2))
        return self._sum(lambda b: self._ends(b, F.lit(first), inner(b), F.lit(last)))

    def improvement_probability(self, best: float | Column) -> Column:
        """P(X > best); a column ``best`` uses the normal CDF column in the tails."""
        f = best if isinstance(best, Column) else F.lit(float(best))

        def inner(b):
            share = F.try_divide(f - b["l"], b["r"] - b["l"])
            return 1 - F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
        (s0, s1), b1, b2 = self.scales, self.borders[1], self.borders[-2]
        first = F.when(f < b1, 2 * normal_cdf((b1 - f) / s0) - 1).otherwise(0.0)
        last = F.when(f <= b2, 1.0).otherwise(2 - 2 * normal_cdf((f - b2) / s1))
        return self._sum(lambda b: self._ends(b, first, inner(b), last))

    def cross_entropy(self, target: Column) -> Column:
        """-sum target_i log p_i against another distribution over the same bars."""
        return -V.vsum(F.zip_with(target, F.col(self.column), lambda t, b: t * F.log(b["p"])))

    def sample(self, key: str, seed: int = 0) -> Column:
        """One draw per row at a hashed uniform; the temperature is that of the prepared bars."""
        return self._quantile_at(hash_unit(seeded_hash(seed, key)))


def distribution_stats(df: DataFrame, borders: Sequence[float], stats: Sequence[str], logits: str = "logits",
                       y: str | None = None, best: float | None = None, probs: Sequence[float] = (),
                       full_support: bool = False, by: Sequence[str] | None = None, key: str | None = None,
                       temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """Add the named statistics per row, or with ``by`` their group means.

    Names: mean, variance, mode, median, quantiles (q_<p> columns), interval
    (low, high), upper_confidence, cdf, bar, loss, density, covered,
    expected_improvement, improvement_probability, sample.
    """
    d = BarDistribution(tuple(float(b) for b in borders), full_support)
    rows = d.prepare(df, logits, temperature)
    target = F.col(y).cast("double") if y else None
    side = (1 - 0.682) / 2
    out: dict[str, Column] = {}
    for name in stats:
        if name == "quantiles":
            out.update({f"q_{str(p).replace('.', '_')}": d.quantile(p) for p in probs or [i / 10 for i in range(1, 10)]})
        elif name == "interval":
            out.update({"low": d.quantile(side), "high": d.quantile(1 - side)})
        elif name == "covered":
            out["covered"] = target.between(d.quantile(side), d.quantile(1 - side)).cast("double")
        elif name in ("cdf", "loss", "density"):
            out[name] = getattr(d, name)(target)
        elif name == "bar":
            out["bar"] = d.bar_index(target)
        elif name in ("expected_improvement", "improvement_probability"):
            out[name] = getattr(d, name)(best)
        elif name == "sample":
            out["sample"] = d.sample(key, seed)
        elif name in ("mean", "variance", "mode", "median", "upper_confidence"):
            out[name] = getattr(d, name)()
        else:
            raise ValueError(f"unknown statistic {name!r}")
    rows = rows.withColumns(out).drop(d.column)
    if by is None:
        return rows
    means = [F.avg(n).alias(n) for n in out if n != "bar"]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *means)


def loss_per_bar(df: DataFrame, borders: Sequence[float], y: str, logits: str = "logits",
                 full_support: bool = False) -> DataFrame:
    """(bar, n, loss): summed loss of the targets in each bar over the number of rows."""
    rows = distribution_stats(df, borders, ["bar", "loss"], logits, y, full_support=full_support)
    total = rows.count()
    return rows.where(F.col("bar").between(0, len(borders) - 2)).groupBy("bar").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("loss") / total).alias("loss"))


OUTPUTS = ("mean", "median", "mode", "quantiles")


def regression_outputs(df: DataFrame, borders: Sequence[float], logits: str = "logits", shift: float = 0.0,
                       scale: float = 1.0, probs: Sequence[float] = (), full_support: bool = True,
                       outputs: Sequence[str] = OUTPUTS) -> DataFrame:
    """mean, median, mode and quantiles on the target's own scale (borders * scale + shift), on Arrow batches."""
    d = BarDistribution(tuple(float(b * scale + shift) for b in borders), full_support)
    edges = np.array(d.borders)
    left, width, middle = edges[:-1], np.diff(edges), (edges[:-1] + edges[1:]) / 2
    centre = middle.copy()
    if full_support:
        s0, s1 = d.scales
        centre[0], centre[-1] = edges[1] - s0 * HALF_NORMAL_MEAN, edges[-2] + s1 * HALF_NORMAL_MEAN
    levels = {f"q_{str(q).replace('.', '_')}": float(q) for q in probs or [i / 10 for i in range(1, 10)]}
    names = [n for name in OUTPUTS if name in outputs for n in (levels if name == "quantiles" else [name])]

    def at_level(p: np.ndarray, upto: np.ndarray, q: float) -> np.ndarray:
        """First bar whose cumulative mass reaches q, or the last if rounding leaves the total below; linear inside."""
        reached = upto >= q
        i = np.where(reached.any(axis=1), reached.argmax(axis=1), d.k - 1)
        row = np.arange(len(p))
        before, mass = np.where(i > 0, upto[row, i - 1], 0.0), p[row, i]
        return np.where(mass == 0, left[i], left[i] + width[i] * ((q - before) / mass))

    def found(values: pa.Array) -> pa.Array:
        there = values.is_valid().to_numpy(zero_copy_only=False)
        flat = values.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d.k)
        there[there] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d.k).all(axis=1)
        x = x[there[values.is_valid().to_numpy(zero_copy_only=False)]]
        with np.errstate(all="ignore"):
            p = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
            p = p / p.sum(axis=1, keepdims=True)
            upto, out = np.cumsum(p, axis=1), {}
            for name in names:
                if name == "mean":
                    y = p @ centre
                elif name == "mode":
                    y = middle[np.where(width > 0, p / width, -np.inf).argmax(axis=1)] if len(x) else np.zeros(0)
                else:
                    y = at_level(p, upto, levels.get(name, 0.5))
                whole = np.zeros(len(there))
                whole[there] = y
                out[name] = pa.array(whole, mask=~there)
        return pa.StructArray.from_arrays([out[n] for n in names], names=names)
    rows = df.withColumn("_found", F.arrow_udf(found, ", ".join(f"`{n}` double" for n in names))(V.as_double(logits)))
    return rows.withColumns({n: F.col(f"_found.{n}") for n in names}).drop("_found")
