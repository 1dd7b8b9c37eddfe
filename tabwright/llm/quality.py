"""Text statistics and robust multivariate outliers per language and source."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.ordered import null_safe_join, sized
from .common import SPACE, WORD, Scratch, text_of

SYMBOLS = "[#*$%&|<>]"
WHITE = "\t\n\x0b\x0c\r "
WINDOW = 5


def text_statistics(docs: DataFrame, text="text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_capitals (longs).

    Windows of words are told apart by 64-bit hashes within one text. Only texts in
    which a window occurs twice go through the sort that finds the words such windows
    cover. All of it is built-in functions of one row; a null text counts as empty.
    """
    t = text_of(text)
    trimmed = F.btrim(t, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    lines = F.filter(F.split(t, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    rows = docs.withColumns({
        "_hashes": F.transform(words, lambda w: F.xxhash64(w)),
        "_lines": F.when(F.contains(t, F.lit("\n")), lines),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(f"[{SPACE}]"))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_capitals": F.regexp_count(t, F.lit("[A-Z]")).cast("long")})
    at = lambda i, k: F.get("_hashes", i + k)
    windows = F.transform(F.slice("_hashes", 1, F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))),
                          lambda h, i: F.xxhash64(h, *[at(i, k) for k in range(1, WINDOW)]))
    rows = rows.withColumns({"_windows": windows, "n_words": F.size("_hashes").cast("long"),
                             "n_dup_lines": F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long")})
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_pairs", F.when(twice, pairs))
    same = lambda p, j: F.get("_pairs", j)["h"].eqNullSafe(p["h"])
    starts = F.sort_array(F.array_compact(F.transform(
        "_pairs", lambda p, j: F.when(same(p, j - 1) | same(p, j + 1), p["i"]))))
    rows = rows.withColumn("_starts", starts)
    covered = F.transform("_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - p, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    return rows.drop("_hashes", "_lines", "_windows", "_pairs", "_starts")


# ---- robust outliers ---------------------------------------------------------

#: name -> (statistic of a text, least scale of it). The added constants keep a few
#: words from looking extreme; the least scales say which differences never count.
FEATURES = {
    "length": ("ln(n_words + 1D)", 0.25),
    "word": ("ln((word_chars + 100D) / (n_words + 20D))", 0.05),
    "symbols": ("sqrt(n_symbols / (word_chars + 50D))", 0.04),
    "capitals": ("sqrt(n_capitals / (word_chars + 50D))", 0.05),
    "lines": ("ln(n_dup_lines + 1D)", 0.5),
    "repeats": ("n_repeat_words / (n_words + 20D)", 0.1),
}
NAMES = list(FEATURES)
SUBSET = 0.6          # share of a group's rows in the subset of least determinant
MIN_ROWS = 200        # smaller groups are estimated together
TAIL = 1e-8           # share of normal vectors that may lie outside
STEPS = 30            # concentration steps at most
SETTLED = 1e-2        # change of a log determinant below which a group has converged
LEVELS = 200          # steps per unit of a distance's logarithm that a subset may end at
GRID = 100            # grid cells per unit when quantiles are counted


def _chi2(x: float, df: int) -> float:
    """P(chi-square with an even number of degrees of freedom <= x)."""
    term, total = 1.0, 1.0
    for k in range(1, df // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, df) < p else (low, mid)
    return high


def grid_quantile(df: DataFrame, group: str, columns: dict[str, float], share: float) -> DataFrame:
    """Per group and column the quantile at ``share``, to a hundredth of the column's unit.

    Values are counted on a grid, combined map-side, so a group of any size is a few
    hundred rows, and the result does not depend on the order of the rows.
    """
    pairs = ", ".join(f"'{c}', cast(round({c} / {unit} * {GRID}) as long)" for c, unit in columns.items())
    cells = df.selectExpr(group, f"stack({len(columns)}, {pairs}) as (c, v)").groupBy(group, "c", "v").count()
    upto = f"sum(count) over (partition by {group}, c order by v rows unbounded preceding)"
    cells = cells.selectExpr(group, "c", "v", f"{upto} >= ceil(sum(count) over (partition by {group}, c) * {share}) as reached")
    return cells.groupBy(group).agg(*[F.expr(f"min(case when reached and c = '{c}' then v end) * {unit} / {GRID} as {c}")
                                      for c, unit in columns.items()])


def _group_names(rows: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source, group): a group of its own from ``min_rows`` on, else the language's rest, else the rest."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("0"))
    small = F.col("n") < min_rows
    rest = F.sum(F.when(small, F.col("n"))).over(W.partitionBy("lang"))   # one row per source
    name = (F.when(~small, F.concat_ws("|", F.lit("source"), mark("lang"), mark("source")))
            .when(rest >= min_rows, F.concat_ws("|", F.lit("language"), mark("lang"))).otherwise(F.lit("rest")))
    return sized(sizes.select("lang", "source", name.alias("group")))


def _distance(rows: DataFrame) -> DataFrame:
    """Add ``distance``, the squared Mahalanobis distance, from the centre m_i and the inverse factor v_i_j."""
    parts = [" + ".join(f"v_{i}_{k} * ({NAMES[k]} - m_{k})" for k in range(i + 1)) for i in range(len(NAMES))]
    return rows.withColumn("distance", F.expr(" + ".join(f"power({z}, 2)" for z in parts)))


def _factored(moments: DataFrame, scale: float) -> DataFrame:
    """Centre and inverse Cholesky factor of scale * covariance + squared least scales, one row per group."""
    p = len(NAMES)
    floor = [FEATURES[c][1] ** 2 for c in NAMES]
    out = moments.selectExpr("group", "was", *[f"s_{i} / n as m_{i}" for i in range(p)], *[
        f"{scale} * greatest(s_{i}_{i} / n - power(s_{i} / n, 2), 0D) + {floor[i]} as c_{i}_{i}" if i == j else
        f"{scale} * (s_{i}_{j} / n - s_{i} / n * s_{j} / n) as c_{i}_{j}" for i in range(p) for j in range(i + 1)])
    less = lambda i, j: "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
    for j in range(p):
        out = out.selectExpr("*", f"sqrt(greatest(c_{j}_{j}{less(j, j)}, {floor[j] / 4})) as l_{j}_{j}")
        if j + 1 < p:
            out = out.selectExpr("*", *[f"(c_{i}_{j}{less(i, j)}) / l_{j}_{j} as l_{i}_{j}" for i in range(j + 1, p)])
    out = out.selectExpr("*", *[f"1 / l_{i}_{i} as v_{i}_{i}" for i in range(p)])
    for gap in range(1, p):
        out = out.selectExpr("*", *[
            "-(" + " + ".join(f"l_{i}_{k} * v_{k}_{i - gap}" for k in range(i - gap, i)) + f") / l_{i}_{i} as v_{i}_{i - gap}"
            for i in range(gap, p)])
    return out.selectExpr("group", "was", "2 * (" + " + ".join(f"ln(l_{i}_{i})" for i in range(p)) + ") as log_det",
                          *[f"m_{i}" for i in range(p)], *[f"v_{i}_{j}" for i in range(p) for j in range(i + 1)])


def robust_fit(rows: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant centre and factor per group of ``rows`` (group and the features).

    Starts from medians and median deviations. Each concentration step takes the
    ``subset`` of the group with the smallest distances and computes its mean and
    covariance anew, which never raises the determinant, until no group's changes.
    Counts and sums per group and level of distance, combined map-side, give both
    the subset and its moments in one pass over the rows; the state is one row per
    group.
    """
    p = len(NAMES)
    triangle = [(i, j) for i in range(p) for j in range(i + 1)]
    units = {c: floor for c, (_, floor) in FEATURES.items()}
    centre = sized(grid_quantile(rows, "group", units, 0.5).withColumnsRenamed({c: f"m_{i}" for i, c in enumerate(NAMES)}))
    off = rows.join(centre, "group").selectExpr("group", *[f"abs({c} - m_{i}) as {c}" for i, c in enumerate(NAMES)])
    spread = grid_quantile(off, "group", units, 0.5)
    state = sized(centre.join(spread, "group").selectExpr(
        "group", "double('infinity') as log_det", *[f"m_{i}" for i in range(p)], *[
            f"1 / greatest({NAMES[i]} * 1.4826D, {FEATURES[NAMES[i]][1]}) as v_{i}_{i}" if i == j else f"0D as v_{i}_{j}"
            for i, j in triangle]))
    # consistency at the normal model of a covariance over the nearest share of the rows
    scale = subset / _chi2(_chi2_quantile(subset, p), p + 2)
    sums = [f"s_{i}" for i in range(p)] + [f"s_{i}_{j}" for i, j in triangle]
    before = None
    for _ in range(steps):
        near = _distance(rows.join(state, "group")).selectExpr(
            "group", "log_det", f"cast(round(ln(distance + 1e-6) * {LEVELS}) as long) as level", *NAMES)
        levels = near.groupBy("group", "level").agg(
            F.expr("count(1) as n"), F.expr("first(log_det) as was"), *[F.expr(f"sum({c}) as s_{i}") for i, c in enumerate(NAMES)],
            *[F.expr(f"sum({NAMES[i]} * {NAMES[j]}) as s_{i}_{j}") for i, j in triangle])
        nearer = "coalesce(sum(n) over (partition by group order by level rows between unbounded preceding and 1 preceding), 0)"
        inside = levels.selectExpr("*", f"{nearer} < ceil(sum(n) over (partition by group) * {subset}) as inside").where("inside")
        moments = sized(inside.groupBy("group").agg(F.expr("sum(n) as n"), F.expr("first(was) as was"),
                                                    *[F.expr(f"sum({c}) as {c}") for c in sums]))
        state = _factored(moments, scale)
        now = {r["group"]: r["was"] for r in moments.select("group", "was").collect()}
        if before and all(abs(now[g] - before[g]) < SETTLED for g in now):
            break
        before = now
    return state.drop("was")


def _features(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.expr(e) for c, (e, _) in FEATURES.items()})


BASE = "(n_words < 10 or 100 * n_repeat_words > 20 * n_words)"


def fit(statistics: DataFrame, min_rows: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """(group names, robust estimates) from statistics with lang and source; rows the base rules reject are left out."""
    scratch = Scratch(statistics.sparkSession)
    sound = statistics.where(f"not {BASE}")
    names = _group_names(sound, min_rows)
    rows = scratch.keep(_features(null_safe_join(sound, names, ["lang", "source"])).select("group", *NAMES), "features")
    return names, robust_fit(rows)


def judged(statistics: DataFrame, names: DataFrame, estimates: DataFrame, tail: float = TAIL) -> DataFrame:
    """``statistics`` plus base_failed, distance and kept."""
    limit = _chi2_quantile(1 - tail, len(NAMES))
    rows = null_safe_join(statistics, names, ["lang", "source"], "left")
    rows = _distance(_features(rows).join(estimates, "group", "left"))
    return rows.withColumns({"base_failed": F.expr(BASE),
                             "kept": F.expr(f"not {BASE}") & F.coalesce(F.col("distance") <= limit, F.lit(True))})


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals"]


def quality_rules(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", source="source") -> DataFrame:
    """doc_id, the base counts, base_failed, distance and kept per row.

    A null text counts as empty and fails the base rules; null languages and sources
    are groups like any other. Groups below MIN_ROWS rows are estimated together with
    the language's other small groups, or with all other small ones; however few rows
    are left, the least scales keep their covariance regular. Repeated rows come back
    as often as they are there; an empty table gives an empty result. Other columns
    of the input are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    rows = scratch.keep(text_statistics(rows).drop("text"), "statistics")
    names, estimates = fit(rows)
    return judged(rows, names, estimates).select("doc_id", *COUNTS, "base_failed", "distance", "kept")


def accepted(docs: DataFrame, text="text", lang="lang", source="source") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; texts are neither shuffled nor written.

    The statistics are computed twice: once for the estimates, which need those of all
    rows and are written without texts, and once beside the rows for their verdicts.
    """
    scratch = Scratch(docs.sparkSession)
    view = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
                       F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    rows = text_statistics(view, f"row.{text}")
    names, estimates = fit(scratch.keep(rows.drop("row"), "statistics"))
    # behind a generator: a filter on the statistics that is pushed down would compute them anew for each use
    counts = F.struct(*[F.col(c) for c in COUNTS])
    rows = rows.select("row", "lang", "source", F.explode_outer(F.array(counts)).alias("s")).select("row", "lang", "source", "s.*")
    kept = judged(rows, names, estimates).where("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
