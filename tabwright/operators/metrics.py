"""Scores of predictions: one registry, few shared plans, any grouping.

Input rows hold ``y_true`` and what a metric needs: ``y_pred`` (value or class
id), ``probs`` (array over classes 0..K-1), ``score`` (positive-class score),
``weight``. Class metrics share one confusion aggregate, curve metrics one
prefix-sum plan over distinct scores, everything else one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vectors as V
from ..session import written
from .ordered import average_ranks, grouped_quantiles, null_safe_join, running

EPS = 2.220446049250313e-16   # fixed values: guards of the percentage errors,
LOG_EPS = 1e-15               # the log loss,
PAC_EPS = 3e-8                # and the probabilistic accuracy
FLOOR = 1e-15
BINARY, MULTICLASS, REGRESSION = "binary", "multiclass", "regression"


@dataclass(frozen=True)
class Scorer:
    """A metric with its direction: score = sign * metric, error = sign * optimum - score."""

    name: str
    family: str
    problems: tuple
    optimum: float = 1.0
    greater_is_better: bool = True
    needs: str = "pred"          # pred, class, proba, threshold or quantile
    aliases: tuple = ()
    fn: Callable | None = field(default=None, compare=False)

    @property
    def sign(self) -> int:
        return 1 if self.greater_is_better else -1

    def score(self, metric: Column) -> Column:
        return metric * self.sign

    def error(self, metric: Column) -> Column:
        return F.lit(self.sign * self.optimum) - self.score(metric)


REGISTRY: dict[str, Scorer] = {}


def add_scorer(scorer: Scorer) -> Scorer:
    for name in (scorer.name, *scorer.aliases):
        if name in REGISTRY:
            raise ValueError(f"metric name {name} is taken")
    for name in (scorer.name, *scorer.aliases):
        REGISTRY[name] = scorer
    return scorer


def register_metric(name: str, column_fn: Callable, optimum: float = 1.0, greater_is_better: bool = True,
                    needs: str = "pred", problems: Sequence[str] = (BINARY, MULTICLASS, REGRESSION),
                    aliases: Sequence[str] = ()) -> Scorer:
    """Add a metric given as an aggregate Column: ``column_fn(y, p, w)``.

    ``p`` is the prediction, class, probability array or score, as ``needs`` says. For
    'quantile' it is the array of predicted quantiles, and the function takes a fourth
    argument, the array of their levels.
    """
    if needs not in ("pred", "class", "proba", "threshold", "quantile"):
        raise ValueError(f"unknown input kind {needs}")
    return add_scorer(Scorer(name, "custom", tuple(problems), optimum, greater_is_better, needs,
                             tuple(aliases), column_fn))


def get_metric(name: str | Scorer, problem: str | None = None) -> Scorer:
    """Look a metric up by name or alias; errors name what would be valid."""
    if isinstance(name, Scorer):
        return name
    valid = {p: sorted({s.name for s in REGISTRY.values() if p in s.problems})
             for p in (BINARY, MULTICLASS, REGRESSION)}
    if problem is not None and problem not in valid:
        raise ValueError(f"unknown problem type {problem!r}, valid: {list(valid)}")
    found = REGISTRY.get(name)
    if found is None:
        raise ValueError(f"unknown metric {name!r}, valid: {valid if problem is None else valid[problem]}")
    if problem is not None and problem not in found.problems:
        raise ValueError(f"{name!r} is not a {problem} metric but one of {list(found.problems)}; "
                         f"valid {problem} metrics: {valid[problem]}")
    return found


# ---- plain aggregates ---------------------------------------------------------

def wmean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def _r2(y, p, w):
    mean = F.sum(y * w) / F.sum(w)
    total = F.sum(y * y * w) - mean * F.sum(y * w)
    left = F.sum((y - p) * (y - p) * w)
    return F.when(total > 0, 1 - left / total).otherwise(F.when(left == 0, 1.0).otherwise(0.0))


def pinball_loss(y: Column, q: Column, w: Column, levels: Column) -> Column:
    """Mean quantile loss over the levels, for :func:`register_metric` with ``needs='quantile'``."""
    each = F.zip_with(q, levels, lambda v, a: F.greatest(a * (y - v), (a - 1) * (y - v)))
    return wmean(V.vsum(each) / F.size(q), w)


def _clip(p: Column, eps: float) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def _binary_loss(y, p, w, eps=LOG_EPS):
    p = _clip(p, eps)
    return wmean(-(y * F.log(p) + (1 - y) * F.log(1 - p)), w)


def _class_loss(y, probs, w, eps=LOG_EPS):
    total = V.vsum(probs)
    return wmean(-F.log(_clip(F.get(probs, y.cast("int")) / F.greatest(total, F.lit(eps)), eps)), w)


def _pearson(y, p, w):
    n, my, mp = F.sum(w), F.sum(y * w) / F.sum(w), F.sum(p * w) / F.sum(w)
    cov = F.sum(y * p * w) / n - my * mp
    return F.try_divide(cov, F.sqrt(F.greatest((F.sum(y * y * w) / n - my * my) * (F.sum(p * p * w) / n - mp * mp), F.lit(0.0))))


def true_class_rank(y: Column, probs: Column) -> Column:
    """1 + classes with a larger probability; equal ones count if their id is smaller.

    Null, and so never a hit, for a label that is no class or has no probability.
    """
    y = y.cast("int")
    mine = F.get(probs, y)
    above = F.filter(probs, lambda v, j: (v > mine) | ((v == mine) & (j < y)))
    return F.when(mine.isNotNull() & ~F.isnan(mine), F.size(above) + 1)


def top_k_hit(y: Column, probs: Column, k: int) -> Column:
    return F.coalesce((true_class_rank(y, probs) <= k).cast("double"), F.lit(0.0))


def any_label_hit(labels: Column, probs: Column, k: int) -> Column:
    """1 if any valid label is among the k most probable classes; null without labels."""
    order = F.slice(F.array_sort(F.transform(probs, lambda p, j: F.struct((-p).alias("p"), j.alias("j")))), 1, k)
    return F.when(F.size(labels) > 0, F.arrays_overlap(F.transform(order, lambda s: s["j"]), labels).cast("double"))


def brier(y: Column, probs: Column) -> Column:
    """Squared distance to the one-hot truth, summed over classes."""
    y = y.cast("int")
    return V.vsum(F.transform(probs, lambda p, j: F.pow(p - F.when(j == y, 1.0).otherwise(0.0), F.lit(2.0))))


# without weights the library aggregates are used, which do not cancel for large means
UNWEIGHTED = {
    "r2": lambda y, p: F.when(F.var_pop(y) > 0, 1 - F.avg((y - p) * (y - p)) / F.var_pop(y)).otherwise(
        F.when(F.sum((y - p) * (y - p)) == 0, 1.0).otherwise(0.0)),
    "pearsonr": lambda y, p: F.corr(y, p),
}

for _name, _aliases, _fn in [
    ("mean_squared_error", ("mse",), lambda y, p, w: wmean((y - p) * (y - p), w)),
    ("root_mean_squared_error", ("rmse",), lambda y, p, w: F.sqrt(wmean((y - p) * (y - p), w))),
    ("mean_absolute_error", ("mae",), lambda y, p, w: wmean(F.abs(y - p), w)),
    ("mean_absolute_percentage_error", ("mape",),
     lambda y, p, w: wmean(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS)), w)),
    ("symmetric_mean_absolute_percentage_error", ("smape",),
     lambda y, p, w: wmean(F.abs(y - p) / F.greatest(F.abs(y) + F.abs(p), F.lit(EPS)), w)),
]:
    add_scorer(Scorer(_name, "agg", (REGRESSION,), 0.0, False, "pred", _aliases, _fn))
add_scorer(Scorer("r2", "agg", (REGRESSION,), fn=_r2))
add_scorer(Scorer("pearsonr", "agg", (REGRESSION,), fn=_pearson))
add_scorer(Scorer("spearmanr", "ranks", (REGRESSION,)))
add_scorer(Scorer("median_absolute_error", "median", (REGRESSION,), 0.0, False, aliases=("medae",)))
add_scorer(Scorer("log_loss", "loss", (BINARY, MULTICLASS), 0.0, False, "proba", ("nll",)))
add_scorer(Scorer("pac", "pac", (BINARY, MULTICLASS), needs="proba", aliases=("pac_score",)))
add_scorer(Scorer("brier", "agg", (MULTICLASS,), 0.0, False, "proba", (), lambda y, p, w: wmean(brier(y, p), w)))
for _k in (1, 5):
    add_scorer(Scorer(f"top_{_k}", "agg", (MULTICLASS,), needs="proba",
                      fn=lambda y, p, w, k=_k: wmean(top_k_hit(y, p, k), w)))
    add_scorer(Scorer(f"top_{_k}_macro", "classmean", (MULTICLASS,), needs="proba",
                      fn=lambda y, p, k=_k: top_k_hit(y, p, k)))
add_scorer(Scorer("expected_calibration_error", "ece", (BINARY, MULTICLASS), 0.0, False, "proba", ("ece",)))
for _name, _problems, _aliases in [
    ("accuracy", (BINARY, MULTICLASS), ("acc",)), ("balanced_accuracy", (BINARY, MULTICLASS), ()),
    ("mcc", (BINARY, MULTICLASS), ()), ("quadratic_kappa", (BINARY, MULTICLASS), ()),
    *[(f"{m}{a}", (BINARY, MULTICLASS) if a else (BINARY,), ())
      for m in ("precision", "recall", "f1") for a in ("", "_macro", "_micro", "_weighted")],
]:
    add_scorer(Scorer(_name, "confusion", _problems, needs="class", aliases=_aliases))
add_scorer(Scorer("roc_auc", "curve", (BINARY,), needs="threshold"))
add_scorer(Scorer("average_precision", "curve", (BINARY,), needs="threshold"))
for _name, _aliases in [("roc_auc_ovo", ("roc_auc_ovo_macro",)), ("roc_auc_ovo_weighted", ()),
                        ("roc_auc_ovr", ("roc_auc_ovr_macro",)), ("roc_auc_ovr_micro", ()),
                        ("roc_auc_ovr_weighted", ())]:
    add_scorer(Scorer(_name, "curve", (MULTICLASS,), needs="proba", aliases=_aliases))


# ---- confusion matrix ---------------------------------------------------------

def confusion(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred",
              weight: str | None = None) -> DataFrame:
    """(by..., t, p, n): weighted counts of the class pairs that occur."""
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*by, F.col(y_true).cast("long").alias("t"), F.col(y_pred).cast("long").alias("p")).agg(
        F.sum(w.cast("double")).alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence[int], normalise: str | None = None, y_true: str = "y_true",
                     y_pred: str = "y_pred", weight: str | None = None) -> DataFrame:
    """Dense (t, p, value) over the given labels; ``normalise`` by 'true', 'pred' or 'all', 0/0 = 0."""
    spark = df.sparkSession
    ids = [int(v) for v in labels]
    grid = spark.createDataFrame([(a, b) for a in ids for b in ids], "t long, p long")  # K x K cells
    cells = confusion(df, (), y_true, y_pred, weight).where(F.col("t").isin(ids) & F.col("p").isin(ids))
    dense = grid.join(cells, ["t", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    over = {None: None, "true": W.partitionBy("t"), "pred": W.partitionBy("p"), "all": W.partitionBy()}[normalise]
    value = F.col("n") if over is None else F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(over)), F.lit(0.0))
    return dense.select("t", "p", value.alias("value"))


def class_totals(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., class, t, m, tp): truth totals, prediction totals and hits per class."""
    sides = F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("t"), F.lit(0.0).alias("m"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0).alias("tp")),
        F.struct(F.col("p").alias("class"), F.lit(0.0).alias("t"), F.col("n").alias("m"), F.lit(0.0).alias("tp")))
    return cells.select(*by, F.explode(sides).alias("_it")).groupBy(*by, F.col("_it.class").alias("class")).agg(
        F.sum("_it.t").alias("t"), F.sum("_it.m").alias("m"), F.sum("_it.tp").alias("tp"))


def confusion_scores(cells: DataFrame, by: Sequence[str] = (), problem: str = MULTICLASS,
                     strict: bool = False) -> DataFrame:
    """All class metrics as columns, from the confusion cells.

    Balanced accuracy counts a class that is predicted but never true with
    recall 1 unless ``strict``.
    """
    if not by:
        return confusion_scores(cells.withColumn("_all", F.lit(0)), ["_all"], problem, strict).drop("_all")
    t, m, tp = F.col("t"), F.col("m"), F.col("tp")
    zero = F.lit(0.0)
    per_class = class_totals(cells, by).withColumns({
        "prec": F.coalesce(F.try_divide(tp, m), zero),
        "rec": F.coalesce(F.try_divide(tp, t), zero),
        "f": F.coalesce(F.try_divide(2 * tp, t + m), zero),
        "bal": F.greatest(tp, F.lit(FLOOR)) / F.greatest(t, F.lit(FLOOR)),
    })
    bal = F.avg(F.when(t > 0, F.col("bal"))) if strict else F.avg("bal")
    if problem == BINARY:
        positive = F.sum(F.when(F.col("class") == 1, F.col("bal")).otherwise(0.0))
        negative = F.sum(F.when(F.col("class") == 0, F.col("bal")).otherwise(0.0))
        bal = (positive + negative) / 2
    n, c = F.sum("t"), F.sum("tp")
    tm, tt, mm = F.sum(t * m), F.sum(t * t), F.sum(m * m)
    root = F.sqrt((n * n - mm) * (n * n - tt))
    cls = F.col("class").cast("double")
    expected = (F.sum(cls * cls * t) + F.sum(cls * cls * m)) - 2 * F.sum(cls * t) * F.sum(cls * m) / n
    aggs = {
        "accuracy": c / n,
        "balanced_accuracy": bal,
        "mcc": F.when(root > 0, F.try_divide(c * n - tm, root)).otherwise(0.0),
        "_expected": expected,
    }
    for name, col in (("precision", "prec"), ("recall", "rec"), ("f1", "f")):
        aggs[name] = F.coalesce(F.max(F.when(F.col("class") == 1, F.col(col))), zero)
        aggs[f"{name}_macro"] = F.avg(col)
        aggs[f"{name}_micro"] = c / n
        aggs[f"{name}_weighted"] = F.sum(F.col(col) * t) / n
    totals = per_class.groupBy(*by).agg(*[v.alias(k) for k, v in aggs.items()])
    gap = F.col("t") - F.col("p")
    observed = cells.groupBy(*by).agg(F.sum((gap * gap) * F.col("n")).alias("_observed"))
    joined = null_safe_join(totals, observed, by)
    return joined.withColumn("quadratic_kappa", F.when(F.col("_expected") > 0, 1 - F.try_divide(
        F.col("_observed"), F.col("_expected"))).otherwise(0.0)).drop("_expected", "_observed")


# ---- curves -------------------------------------------------------------------

def curve_areas(df: DataFrame, by: Sequence[str], score: str, pos: str, neg: str) -> DataFrame:
    """(by..., auc, ap, pos, neg) from rows with positive and negative weight.

    Rows shrink to distinct scores before prefix sums; equal scores share one
    step, which is the trapezoid for the AUC.
    """
    points = df.groupBy(*by, (-F.col(score)).alias("_s")).agg(F.sum(pos).alias("_pos"), F.sum(neg).alias("_neg"))
    points = written(points, "curve-points")
    run = running(points, by, "_s", {"_pb": "_pos", "_nb": "_neg"})
    seen_pos, seen = F.col("_pb") + F.col("_pos"), F.col("_pb") + F.col("_pos") + F.col("_nb") + F.col("_neg")
    return run.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("_neg") * (F.col("_pb") + F.col("_pos") / 2)), F.sum("_pos") * F.sum("_neg")).alias("auc"),
        F.try_divide(F.sum(F.col("_pos") * F.try_divide(seen_pos, seen)), F.sum("_pos")).alias("ap"),
        F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg"))


def class_areas(df: DataFrame, by: Sequence[str], micro: bool = True) -> DataFrame:
    """(by..., kind, a, b, auc, pos, neg) of all one-vs-rest, pair and micro curves of class probabilities.

    One row per prediction and class is reduced to weights per (class, score, true
    class). Along the scores of class a, the weight of true a passed so far gives the
    area against every other true class b at once: the pairs (a, b), and their sum is
    one-vs-rest. The same weights, with the classes put together, give the micro curve.
    """
    by = list(by)
    each = df.select(*by, F.col("_y").cast("int").alias("b"), "_w", F.posexplode("_probs").alias("a", "_p"))
    cells = written(each.groupBy(*by, "a", (-F.col("_p")).alias("_s"), "b").agg(F.sum("_w").alias("_w")), "class-scores")
    own = F.col("a") == F.col("b")
    pos = F.coalesce(F.sum(F.when(own, F.col("_w"))), F.lit(0.0)).alias("_pos")
    rest = F.collect_list(F.when(~own, F.struct("b", F.col("_w").alias("w")))).alias("_rest")   # at most one entry a class
    run = running(cells.groupBy(*by, "a", "_s").agg(pos, rest), [*by, "a"], "_s", {"_before": "_pos"})
    passed = run.select(*by, "a", (F.col("_before") + F.col("_pos") / 2).alias("_h"), F.explode("_rest").alias("_it"))
    wins = passed.groupBy(*by, "a", F.col("_it.b").alias("b")).agg(F.sum(F.col("_h") * F.col("_it.w")).alias("_wins"))
    sizes = cells.where("a = 0").groupBy(*by, F.col("b").alias("_c")).agg(F.sum("_w").alias("_n"))   # one row a class
    of = lambda c, out: sizes.select(*by, F.col("_c").alias(c), F.col("_n").alias(out))
    pairs = null_safe_join(null_safe_join(wins, of("a", "pos"), [*by, "a"]), of("b", "neg"), [*by, "b"])
    area = lambda wins, p, n: F.try_divide(wins, p * n).alias("auc")
    ovo = pairs.select(*by, F.lit("ovo").alias("kind"), "a", "b", area(F.col("_wins"), F.col("pos"), F.col("neg")), "pos", "neg")
    ovr = pairs.groupBy(*by, "a").agg(F.sum("_wins").alias("_wins"), F.max("pos").alias("pos"), F.sum("neg").alias("neg"))
    ovr = ovr.select(*by, F.lit("ovr").alias("kind"), "a", F.lit(-1).alias("b"), area(F.col("_wins"), F.col("pos"), F.col("neg")), "pos", "neg")
    out = ovo.unionByName(ovr)
    if micro:
        neg = F.coalesce(F.sum(F.when(~own, F.col("_w"))), F.lit(0.0)).alias("_neg")
        steps = running(cells.groupBy(*by, "_s").agg(pos, neg), by, "_s", {"_before": "_pos"})
        total = steps.groupBy(*by).agg(F.sum(F.col("_neg") * (F.col("_before") + F.col("_pos") / 2)).alias("_wins"),
                                       F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg"))
        out = out.unionByName(total.select(*by, F.lit("micro").alias("kind"), F.lit(-1).alias("a"), F.lit(-1).alias("b"),
                                           area(F.col("_wins"), F.col("pos"), F.col("neg")), "pos", "neg"))
    return out


def curve_scores(df: DataFrame, by: Sequence[str], wanted: set[str]) -> DataFrame:
    by = list(by)
    parts = []
    if wanted & {"roc_auc", "average_precision"}:
        hit = F.col("_y") == 1
        rows = df.select(*by, F.col("_s").cast("double").alias("s"), F.when(hit, F.col("_w")).otherwise(0.0).alias("pos"),
                         F.when(hit, 0.0).otherwise(F.col("_w")).alias("neg"))
        parts.append(curve_areas(rows, by, "s", "pos", "neg").withColumn("kind", F.lit("binary")))
    if wanted - {"roc_auc", "average_precision"}:
        parts.append(class_areas(df, by, "roc_auc_ovr_micro" in wanted))
    areas = parts[0]
    for part in parts[1:]:
        areas = areas.unionByName(part, allowMissingColumns=True)
    if "ap" not in areas.columns:
        areas = areas.withColumn("ap", F.lit(None).cast("double"))

    def pick(kind, x):
        return F.when(F.col("kind") == kind, x)
    auc, size = F.col("auc"), F.col("pos") + F.col("neg")
    # a class or pair without rows on one side has no area and is left out of the means
    out = {
        "roc_auc": F.max(pick("binary", auc)), "average_precision": F.max(pick("binary", F.col("ap"))),
        "roc_auc_ovr": F.avg(pick("ovr", auc)), "roc_auc_ovr_micro": F.max(pick("micro", auc)),
        "roc_auc_ovr_weighted": F.try_divide(F.sum(pick("ovr", auc * F.col("pos"))),
                                             F.sum(pick("ovr", F.when(auc.isNotNull(), F.col("pos"))))),
        "roc_auc_ovo": F.avg(pick("ovo", auc)),
        "roc_auc_ovo_weighted": F.try_divide(F.sum(pick("ovo", auc * size)),
                                             F.sum(pick("ovo", F.when(auc.isNotNull(), size)))),
    }
    got = areas.groupBy(*by).agg(*[out[m].alias(m) for m in sorted(wanted)])
    if not by and "roc_auc" in wanted:
        got = got.withColumn("roc_auc", F.coalesce("roc_auc", F.raise_error(
            "only one class in y_true, ROC AUC is not defined").cast("double")))
    return got


def spearman(df: DataFrame, by: Sequence[str], y: str = "_y", p: str = "_p") -> DataFrame:
    """Rank correlation with average ranks, over distinct (y, p) pairs with counts."""
    by = list(by)
    pairs = written(df.groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("_c")), "value-pairs")
    ry = average_ranks(pairs, by, y, "_ry", "_c").drop("_n")
    rp = average_ranks(pairs, by, p, "_rp", "_c").drop("_n")
    ranked = null_safe_join(null_safe_join(pairs, ry, [*by, y]), rp, [*by, p])
    c, a, b = F.col("_c"), F.col("_ry"), F.col("_rp")
    n = F.sum(c)
    mean = (n + 1) / 2
    cov = F.sum(c * a * b) / n - mean * mean
    return ranked.groupBy(*by).agg(F.try_divide(cov, F.sqrt(
        (F.sum(c * a * a) / n - mean * mean) * (F.sum(c * b * b) / n - mean * mean))).alias("spearmanr"))


def calibration_bins(df: DataFrame, by: Sequence[str] = (), bins: int = 15) -> DataFrame:
    """(by..., bin, conf, acc, n) over bins (i/15, (i+1)/15] of the top probability."""
    conf = F.array_max("_probs")
    hit = (V.argmax("_probs") == F.col("_y").cast("int")).cast("double")
    # a value on a bin edge belongs to the lower bin
    at = F.least(F.greatest(F.ceil(F.round(conf * bins, 9)) - 1, F.lit(0)), F.lit(bins - 1))
    return df.groupBy(*by, at.cast("int").alias("bin")).agg(
        wmean(conf, F.col("_w")).alias("conf"), wmean(hit, F.col("_w")).alias("acc"), F.sum("_w").alias("n"))


def _pac(df: DataFrame, by: Sequence[str], problem: str) -> DataFrame:
    """exp(-log loss) rescaled so that the class priors score 0 and certainty 1."""
    y, w = F.col("_y"), F.col("_w")
    if problem == BINARY:
        point = -(y * F.log(_clip(F.col("_s"), PAC_EPS)) + (1 - y) * F.log(1 - _clip(F.col("_s"), PAC_EPS)))
    else:
        share = F.get(F.col("_probs"), y.cast("int")) / F.greatest(V.vsum("_probs"), F.lit(PAC_EPS))
        point = -F.log(_clip(share, PAC_EPS))
    per_class = df.groupBy(*by, "_y").agg(F.sum(point * w).alias("_loss"), F.sum(w).alias("_n"))
    total = F.sum("_n").over(W.partitionBy(*by))  # over the class table
    parts = per_class.withColumn("_f", F.col("_n") / total)
    got = parts.groupBy(*by).agg((F.sum("_loss") / F.sum("_n")).alias("_l"),
                                 (-F.sum(F.col("_f") * F.log(F.greatest("_f", F.lit(FLOOR))))).alias("_l0"))
    base = F.exp(-F.col("_l0"))
    return got.select(*by, ((F.exp(-F.col("_l")) - base) / F.greatest(F.lit(1e-7), 1 - base)).alias("pac"))


# ---- evaluate -----------------------------------------------------------------

def _needed(col: Column, what: str) -> Column:
    """The column; a null in it is an error, the same for every metric."""
    return F.when(col.isNull(), F.raise_error(F.lit(f"null {what}")).cast("double")).otherwise(col.cast("double"))


def _prepare(df: DataFrame, by, y_true, y_pred, probs, score, weight, quantiles=None, levels=None) -> DataFrame:
    """Rename the contract columns; classes follow from probabilities when absent. Null values are errors."""
    cols = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)] + [
        _needed(F.col(y_true), "true value").alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")]
    if levels is not None:
        q = V.as_double(quantiles)
        wrong = F.raise_error(F.lit(f"not one quantile for each of {len(levels)} levels")).cast("array<double>")
        cols.append(F.when((F.size(q) != len(levels)) | q.isNull() | F.exists(q, lambda v: v.isNull()), wrong).otherwise(q).alias("_q"))
    if probs in df.columns:
        cols.append(V.as_double(probs).alias("_probs"))
    if score in df.columns:
        cols.append(_needed(F.col(score), "score").alias("_s"))
    if y_pred in df.columns:
        cols.append(_needed(F.col(y_pred), "prediction").alias("_p"))
    elif probs in df.columns:
        cols.append(_needed(V.argmax(V.as_double(probs)), "probabilities").alias("_p"))
    elif score in df.columns:
        cols.append((_needed(F.col(score), "score") > 0.5).cast("double").alias("_p"))
    return df.select(*cols)


def _long(wide: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(by..., metric, value) from one column per metric."""
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_it")).select(
            *by, "_it.metric", "_it.value")


def evaluate(df: DataFrame, metrics: Sequence[str | Scorer], by: Sequence[str] = (), problem: str | None = None,
             y_true: str = "y_true", y_pred: str = "y_pred", probs: str = "probs", score: str = "score",
             weight: str | None = None, quantiles: str = "quantiles", quantile_levels: Sequence[float] | None = None) -> DataFrame:
    """Long table (by..., metric, score, error); larger scores are better, error 0 is perfect.

    Metrics of quantiles read the array column ``quantiles``, one value for each of
    ``quantile_levels``.
    """
    scorers = {s.name: s for s in (get_metric(m, problem) for m in metrics)}
    asked = any(s.needs == "quantile" for s in scorers.values())
    if asked and not quantile_levels:
        raise ValueError("quantile_levels is needed to score quantiles")
    data = _prepare(df, by, y_true, y_pred, probs, score, weight, quantiles, quantile_levels if asked else None)
    groups = {f"_by{i}": c for i, c in enumerate(by)}  # own names, so groups may be called anything
    by = list(groups)
    kind = problem or (MULTICLASS if "_probs" in data.columns else BINARY)
    y, w = F.col("_y"), F.col("_w")
    source = {"pred": "_p", "class": "_p", "proba": "_probs" if "_probs" in data.columns else "_s", "threshold": "_s"}
    need = {s: [m for m in scorers.values() if m.family == s] for s in {m.family for m in scorers.values()}}
    pieces = []

    plain = {s.name: s.fn(y, F.col("_q"), w, V.literal_array(quantile_levels)) if s.needs == "quantile" else s.fn(y, F.col(source[s.needs]), w)
             for f in ("agg", "custom") for s in need.get(f, [])}
    if weight is None:
        plain.update({n: fn(y, F.col("_p")) for n, fn in UNWEIGHTED.items() if n in plain})
    if "loss" in need:
        plain["log_loss"] = (_class_loss(y, F.col("_probs"), w) if source["proba"] == "_probs"
                             else _binary_loss(y, F.col("_s"), w))
    if plain:
        pieces.append(_long(data.groupBy(*by).agg(*[c.alias(n) for n, c in plain.items()]), by, list(plain)))
    if "confusion" in need:
        cells = confusion(data, by, "_y", "_p", "_w")
        pieces.append(_long(confusion_scores(cells, by, kind), by, [s.name for s in need["confusion"]]))
    if "curve" in need:
        names = {s.name for s in need["curve"]}
        pieces.append(_long(curve_scores(data, by, names), by, sorted(names)))
    if "classmean" in need:
        each = data.groupBy(*by, "_y").agg(*[wmean(s.fn(y, F.col("_probs")), w).alias(s.name) for s in need["classmean"]])
        names = [s.name for s in need["classmean"]]
        pieces.append(_long(each.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names]), by, names))
    if "ranks" in need:
        pieces.append(_long(spearman(data, by), by, ["spearmanr"]))
    if "median" in need:
        gaps = data.select(*by, F.abs(y - F.col("_p")).alias("_e"))
        pieces.append(_long(grouped_quantiles(gaps, by, "_e", {"median_absolute_error": 0.5}), by, ["median_absolute_error"]))
    if "pac" in need:
        pieces.append(_long(_pac(data, by, BINARY if source["proba"] == "_s" else MULTICLASS), by, ["pac"]))
    if "ece" in need:
        rows = data if "_probs" in data.columns else data.withColumn("_probs", F.array(1 - F.col("_s"), F.col("_s")))
        bins = calibration_bins(rows, by)
        gap = F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")
        pieces.append(_long(bins.groupBy(*by).agg(gap.alias("expected_calibration_error")), by, ["expected_calibration_error"]))

    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    signs = F.create_map(*[x for s in scorers.values() for x in (F.lit(s.name), F.lit(float(s.sign)))])
    best = F.create_map(*[x for s in scorers.values() for x in (F.lit(s.name), F.lit(float(s.sign * s.optimum)))])
    signed = F.col("value") * signs[F.col("metric")]
    return out.select(*[F.col(b).alias(c) for b, c in groups.items()], "metric", signed.alias("score"),
                      (best[F.col("metric")] - signed).alias("error"))


def classwise_top_k(df: DataFrame, ks: Sequence[int], y_true: str = "y_true", probs: str = "probs") -> DataFrame:
    """(class, n, top_k...) hit rates per true class."""
    y, p = F.col(y_true), V.as_double(probs)
    return df.groupBy(y.alias("class")).agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(top_k_hit(y, p, k)).alias(f"top_{k}") for k in ks])


def multilabel_hit_rate(df: DataFrame, labels: str, probs: str, ks: Sequence[int]) -> DataFrame:
    """Share of rows with a valid label in the top k; rows without labels do not count."""
    return df.agg(F.count(F.when(F.size(labels) > 0, 1)).alias("n"), *[
        F.avg(any_label_hit(F.col(labels), V.as_double(probs), k)).alias(f"top_{k}") for k in ks])


def threshold_scores(df: DataFrame, y_true: str = "y_true", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Balanced accuracy and average precision of hard 0/1 decisions at a threshold."""
    hard = df.select(F.col(y_true).alias("_y"), (F.col(score) > threshold).cast("long").alias("_p"), F.lit(1.0).alias("_w"))
    cells = confusion(hard, (), "_y", "_p", "_w").withColumn("_all", F.lit(0))
    balanced = confusion_scores(cells, ["_all"], BINARY).select("_all", "balanced_accuracy")
    c = {(t, p): F.sum(F.when((F.col("t") == t) & (F.col("p") == p), F.col("n")).otherwise(0.0)) for t in (0, 1) for p in (0, 1)}
    pos, n = c[1, 0] + c[1, 1], F.sum("n")
    hits = F.coalesce(F.try_divide(c[1, 1], pos), F.lit(0.0))
    precise = F.coalesce(F.try_divide(c[1, 1], c[1, 1] + c[0, 1]), F.lit(0.0))
    ap = cells.groupBy("_all").agg((hits * precise + (1 - hits) * pos / n).alias("average_precision"))
    return balanced.join(ap, "_all").drop("_all")
