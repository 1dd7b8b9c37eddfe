"""Categorical encoding and column typing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import scratch_table, written
from .features import seeded_order
from .fitted import Fitted
from .ordered import as_of, cut_points, running, sized, with_buckets

VOCABULARY_LIMIT = 100_000  # values kept on the driver over all columns; more go to a written table
INLINE_LIMIT = 64           # codes looked up in an expression instead of a join


def cell_text(df: DataFrame, c: str):
    """A cell as category text: null for NaN, and one text per number whatever its type."""
    if isinstance(df.schema[c].dataType, T.DecimalType):
        return F.regexp_replace(F.col(c).cast("string"), r"\.0+$|(\.\d*[1-9])0+$", "$1")
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        whole = (F.abs(F.col(c)) < 2.0**53) & (F.col(c) == F.floor(c))
        return F.when(~F.isnan(c), F.when(whole, F.col(c).cast("long").cast("string")).otherwise(F.col(c).cast("string")))
    return F.col(c).cast("string")


def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(c, text, num): every categorical cell as a row, ready for one combined aggregate."""
    kinds = {f.name: f.dataType for f in df.schema}

    def num(c):  # null and NaN are one missing value
        return F.nanvl(F.col(c).cast("double"), F.lit(None)) if isinstance(kinds[c], T.NumericType) else F.lit(None).cast("double")
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), cell_text(df, c).alias("text"), num(c).alias("num"))
        for c in cols])).alias("s")).select("s.*")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(c, text, num, n) over all listed columns from one map-side combined aggregate."""
    return long_values(df, cols).groupBy("c", "text", "num").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Codes(Fitted):
    """Value -> code per column, in sorted or seeded order.

    Small vocabularies live in ``values`` (list position = code). A vocabulary
    above the limit is a written table (text, code) in ``tables`` and is joined
    without a hint, so AQE may split hot values.
    """

    values: dict
    tables: dict
    unknown: str | float | None = "error"
    suffix: str = ""

    @property
    def per_row(self) -> bool:
        return not self.tables and all(len(v) <= INLINE_LIMIT for v in self.values.values())

    def transform(self, df: DataFrame) -> DataFrame:
        for c in [*self.values, *self.tables]:
            df = self._encode(df, c)
        return df

    def _finish(self, c: str, text: Column, code: Column) -> Column:
        if self.unknown == "error":
            problem = F.raise_error(F.concat(F.lit(f"unknown value in column {c}: "), text))
            missing = problem.cast("double")
        else:
            missing = F.lit(None if self.unknown is None else float(self.unknown)).cast("double")
        return F.when(text.isNull(), F.lit(None)).when(code.isNotNull(), code.cast("double")).otherwise(missing)

    def _encode(self, df: DataFrame, c: str) -> DataFrame:
        text, out = cell_text(df, c), c + self.suffix
        vocabulary = self.values.get(c)
        if vocabulary is not None and len(vocabulary) <= INLINE_LIMIT:
            if not vocabulary:
                return df.withColumn(out, self._finish(c, text, F.lit(None).cast("int")))
            position = F.array_position(F.array(*[F.lit(v) for v in vocabulary]), text)
            return df.withColumn(out, self._finish(c, text, F.when(position > 0, position - 1)))
        if vocabulary is not None:
            rows = [(v, i) for i, v in enumerate(vocabulary)]
            table = F.broadcast(df.sparkSession.createDataFrame(rows, "_text string, _code int"))
        else:
            table = df.sparkSession.read.parquet(self.tables[c]).select(
                F.col("text").alias("_text"), F.col("code").alias("_code"))
        joined = df.join(table, text == F.col("_text"), "left")
        return joined.withColumn(out, self._finish(c, text, F.col("_code"))).drop("_text", "_code")

    def inverse(self, df: DataFrame, c: str, out: str, kind: str = "string") -> DataFrame:
        """Code column ``c + suffix`` back to the original value."""
        code = F.col(c + self.suffix).cast("int")
        if c in self.tables:
            table = df.sparkSession.read.parquet(self.tables[c]).select(
                F.col("text").alias(out), F.col("code").alias("_code"))
            return df.join(table, code == F.col("_code"), "left").drop("_code").withColumn(out, F.col(out).cast(kind))
        return df.withColumn(out, F.get(F.array(*[F.lit(v) for v in self.values[c]]), code).cast(kind))


def _written_codes(counts: DataFrame, c: str, seed) -> str:
    """Codes of one large vocabulary, numbered over range partitions and written.

    The range-partitioned copy is written first, so its bounds cannot change
    between the count and the numbering, also when an executor is lost.
    """
    spark = counts.sparkSession
    if seed is None:
        ordered = counts.select("text", "num", F.col("num").alias("_a"), F.col("text").alias("_b"))
    else:
        key = F.md5(F.concat_ws("|", F.lit(str(seed)), "text"))
        ordered = counts.select("text", "num", F.lit(None).cast("double").alias("_a"), key.alias("_b"))
    staged, path = scratch_table(spark, f"vocabulary-{c}"), scratch_table(spark, f"codes-{c}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered.repartitionByRange(parts, "_a", "_b").withColumn("_part", F.spark_partition_id()).write.parquet(staged)
    table = spark.read.parquet(staged)
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(W.partitionBy("_part").orderBy("_a", "_b"))
    (table.join(sized(before), "_part").select("text", (F.col("_before") + rank - 1).alias("code"))
     .write.parquet(path))
    return path


def fit_codes(df: DataFrame, cols: Sequence[str], unknown: str | float | None = "error", suffix: str = "",
              shuffle_seed: int | None = None, gate: str | None = None,
              limit: int = VOCABULARY_LIMIT) -> Codes:
    """Ordinal codes: sorted distinct values -> 0..K-1 (numbers sort as numbers).

    ``unknown`` is 'error', a code, or None for missing. ``gate='common'`` keeps
    only columns whose rarest category has at least 10 rows, 'very_common' also
    asks for fewer distinct values than a tenth of the rows; other columns stay.
    """
    cols = list(cols)
    counts = value_counts(df, cols)
    per_column = counts.groupBy("c").agg(F.count(F.lit(1)).alias("uniques"), F.min("n").alias("rarest"),
                                         F.sum("n").alias("rows"))
    profile = {r["c"]: r for r in per_column.collect()}  # one row per column
    if gate:
        cols = [c for c in cols if profile[c]["rarest"] >= 10
                and (gate == "common" or profile[c]["uniques"] < profile[c]["rows"] // 10)]
    small, room = [], limit
    for c in sorted(cols, key=lambda c: profile[c]["uniques"] if c in profile else 0):
        size = profile[c]["uniques"] if c in profile else 0
        if size <= room:
            small.append(c)
            room -= size
    values: dict = {c: [] for c in cols if c in small}
    if small:
        for r in counts.where(F.col("c").isin(small) & F.col("text").isNotNull()).collect():
            values[r["c"]].append((r["num"] if r["num"] is not None else 0.0, r["text"]))
    values = {c: [t for _, t in sorted(v, key=lambda p: (p[0], p[1].encode()))] for c, v in values.items()}
    if shuffle_seed is not None:
        values = {c: seeded_order(shuffle_seed, v) for c, v in values.items()}
    tables = {c: _written_codes(counts.where((F.col("c") == c) & F.col("text").isNotNull()), c, shuffle_seed)
              for c in cols if c not in small}
    return Codes(values, tables, unknown, suffix)


def fit_label(df: DataFrame, c: str, suffix: str = "") -> Codes:
    return fit_codes(df, [c], "error", suffix)


@dataclass(frozen=True)
class OneHot(Fitted):
    """0/1 columns per known value; unknown values are all zeros."""

    values: dict          # column -> values, None for missing
    keep: bool = False

    def names(self) -> list[str]:
        return [self._name(c, v) for c in self.values for v in self._flags(c)]

    @staticmethod
    def _name(c: str, v) -> str:
        # a dot would read as a field access; escaped so that no two values share a name
        return f"{c}={'' if v is None else v}".replace("%", "%25").replace(".", "%2E")

    def _flags(self, c: str) -> list:
        v = self.values[c]
        return v[1:] if len(v) == 2 else v

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.values:
            text = cell_text(df, c)
            for v in self._flags(c):
                hit = text.isNull() if v is None else text.eqNullSafe(F.lit(v))
                out[self._name(c, v)] = hit.cast("int")
        df = df.withColumns(out) if out else df
        return df if self.keep else df.drop(*self.values)


def fit_onehot(df: DataFrame, cols: Sequence[str], max_cells: int | None = None, keep: bool = False,
               limit: int = 2_000) -> OneHot | None:
    """One flag per value, a single flag for a two-valued column.

    With ``max_cells`` the encoder steps aside (None) when rows x width reaches
    it. Above ``limit`` flags use :func:`onehot_long`.
    """
    rows = value_counts(df, cols).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} one-hot columns, use onehot_long")
    n = sum(r["n"] for r in rows if r["c"] == cols[0])
    values = {c: [r["text"] for r in sorted((r for r in rows if r["c"] == c), key=lambda r: (
        r["text"] is None, r["num"] or 0.0, (r["text"] or "").encode()))] for c in cols}
    fitted = OneHot(values, keep)
    width = len(df.columns) - len(cols) + len(fitted.names())
    if max_cells is not None and n * width >= max_cells:
        return None
    return fitted


def onehot_long(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Sparse one-hot: (key, feature) for every non-null cell, of any vocabulary size."""
    return df.select(key, F.explode(F.array(*[
        F.concat(F.lit(f"{c}="), cell_text(df, c)) for c in cols])).alias("feature")).where(F.col("feature").isNotNull())


def least_common_count(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).count().agg(F.min("count").alias("least_common"))


def unique_counts(df: DataFrame, cols: Sequence[str], upto: int) -> tuple[int, dict[str, int]]:
    """Row count and distinct counts (null and NaN are one value), exact wherever they are near ``upto`` or less.

    A sketch over all columns picks those worth an exact count, so columns full
    of distinct values are never shuffled.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.approx_count_distinct(F.coalesce(cell_text(df, c), F.lit("\0null"))).alias(f"_{i}")
        for i, c in enumerate(cols)]).first()
    out = {c: row[f"_{i}"] for i, c in enumerate(cols)}
    near = [c for c in cols if out[c] <= 4 * upto + 100]
    if near:
        exact = value_counts(df, near).groupBy("c").agg(F.count(F.lit(1)).alias("u"))
        out.update({r["c"]: r["u"] for r in exact.collect()})
    return row["n"], out


def infer_categorical(df: DataFrame, cols: Sequence[str], listed: Sequence[str] = (), min_rows: int = 100,
                      max_uniques: int = 30, min_numeric_uniques: int = 4) -> list[str]:
    """Listed columns with at most 30 values, and unlisted ones with fewer than 4 in tables above 100 rows."""
    n, uniques = unique_counts(df, cols, max(max_uniques, min_numeric_uniques))
    return [c for c in cols if (c in listed and uniques[c] <= max_uniques)
            or (c not in listed and n > min_rows and uniques[c] < min_numeric_uniques)]


def infer_roles(df: DataFrame, min_numeric_uniques: int = 4) -> dict[str, str]:
    """'categorical' for text and for columns with fewer than 4 values, else 'numeric'."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    rest = [c for c in df.columns if c not in text]
    _, uniques = unique_counts(df, rest, min_numeric_uniques) if rest else (0, {})
    return {c: "categorical" if c in text or uniques[c] < min_numeric_uniques else "numeric" for c in df.columns}


@dataclass(frozen=True)
class TargetRank(Fitted):
    """y -> number of distinct training targets below y (binary search in the JVM).

    Many targets are a written table, which the distinct values asked for meet in an
    as-of join.
    """

    column: str
    targets: list
    out: str
    table: str | None = None
    cuts: list | None = None

    @property
    def per_batch(self) -> bool:
        return self.table is not None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.table is not None:
            y = F.col(self.column).cast("double")
            asked = df.select(y.alias("_y")).where("_y is not null").distinct()
            found = as_of(asked, "_y", df.sparkSession.read.parquet(self.table), "v", self.cuts)
            below = F.when(F.col("prev").isNull(), 0).when(F.col("prev.v") == F.col("_y"), F.col("prev.below")).otherwise(F.col("prev.below") + 1)
            return df.join(found.select("_y", below.cast("int").alias(self.out)), y == F.col("_y"), "left").drop("_y")
        marked = with_buckets(df, {self.column: self.targets}, "_rank_")
        at = F.col(f"_rank_{self.column}")  # number of targets <= y
        equal = F.get(F.array(*[F.lit(t) for t in self.targets]), at - 1) == F.col(self.column).cast("double")
        return marked.withColumn(self.out, F.when(F.col(self.column).isNotNull(), F.when(
            F.coalesce(equal, F.lit(False)), at - 1).otherwise(at))).drop(f"_rank_{self.column}")


def fit_target_rank(df: DataFrame, c: str, out: str, limit: int = 5_000) -> TargetRank:
    """Fitted ranks for a target; more than ``limit`` distinct values are written as a table."""
    values = df.select(F.col(c).cast("double").alias("v")).where("v is not null").distinct()
    rows = values.limit(limit + 1).collect()
    if len(rows) <= limit:
        return TargetRank(c, sorted(r[0] for r in rows), out)
    path = scratch_table(df.sparkSession, "target-ranks")
    cuts = cut_points(values, ["v"])["v"]
    running(values.withColumn("_one", F.lit(1)), [], "v", {"below": "_one"}, cuts=cuts).select("v", "below").write.parquet(path)
    return TargetRank(c, [], out, path, cuts)


def rank_against(df: DataFrame, train: DataFrame, c: str, out: str) -> DataFrame:
    """The same rank for any number of distinct targets: prefix counts over distinct values, joined back."""
    known = train.select(F.col(c).cast("double").alias("_y"), F.lit(1).alias("_t"))
    asked = df.select(F.col(c).cast("double").alias("_y"), F.lit(0).alias("_t"))
    values = known.unionByName(asked).where("_y is not null").groupBy("_y").agg(F.max("_t").alias("_t"))
    ranks = running(values, [], "_y", {out: "_t"}).drop("_t")
    return df.join(ranks, F.col(c).cast("double") == F.col("_y"), "left").drop("_y")


def class_priors(df: DataFrame, c: str) -> DataFrame:
    """(class, n, prior); the total is taken over the class table."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prior", F.col("n") / F.sum("n").over(W.partitionBy()))


def permute_class(y: Column, permutation: Column) -> Column:
    """Class id -> permuted id (``permutation`` is an array column, usually of the member table)."""
    return F.get(permutation, y.cast("int"))


def unpermute_probs(probs: Column, permutation: Column) -> Column:
    """Probabilities of permuted classes back in the original class order."""
    return F.transform(permutation, lambda p: F.get(probs, p))


# ---- text n-grams ------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]{2,}"  # fixed value: words of two or more letters, digits or underscores


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ngrams(tokens: str | Column, lo: int, hi: int) -> Column:
    """All blank-joined runs of ``lo`` to ``hi`` tokens."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    parts = []
    for n in range(lo, hi + 1):
        size = F.size(tokens) - (n - 1)
        grams = F.slice(tokens, F.lit(1), F.greatest(size, F.lit(0)))
        for k in range(1, n):
            tail = F.slice(tokens, F.lit(k + 1), F.greatest(size, F.lit(0)))
            grams = F.zip_with(grams, tail, lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(grams)
    return F.concat(*parts)


@dataclass(frozen=True)
class NgramCounts(Fitted):
    """Counts of a fitted n-gram vocabulary as an array column, without a shuffle."""

    text: str
    lo: int
    hi: int
    vocabulary: list
    out: str = "ngram_counts"

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import CountVectorizerModel
        from pyspark.ml.functions import vector_to_array
        model = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="_grams", outputCol="_counts")
        grams = df.withColumn("_tokens", words(F.coalesce(F.col(self.text), F.lit("")))).withColumn(
            "_grams", ngrams("_tokens", self.lo, self.hi))
        return model.transform(grams).withColumn(self.out, vector_to_array("_counts")).drop("_tokens", "_grams", "_counts")


MOST_WORDS = 200_000   # words that longer n-grams are searched with; with more, all n-grams are counted at once


def ngram_vocabulary(df: DataFrame, text: str, lo: int = 1, hi: int = 3, min_df: int = 30,
                     top: int = 300) -> DataFrame:
    """(gram, df, tf): the most frequent n-grams that occur in at least ``min_df`` texts.

    Level by level: an n-gram is in no more texts, and occurs no more often, than any of
    its parts. So level n only looks at n-grams both of whose parts of n - 1 words are in
    ``min_df`` texts and occur at least as often as the last of the ``top`` found so far;
    all other words are masked in place. A task adds up its batches' counts, and only
    distinct n-grams are shuffled. Very many words (``MOST_WORDS``) that pass are not
    sent to the tasks; then every n-gram is counted.
    """
    tokens = df.where(F.col(text).isNotNull()).select(words(text).alias("w"))
    found, passed, least = [], None, 0
    for n in range(1, hi + 1):
        level = _gram_level(tokens, n, passed).groupBy("gram").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        level = level.where(F.col("df") >= min_df)
        if n < hi:
            level = written(level, f"grams-{n}")
        if n >= lo:
            found.append(level)
            best = _all_rows(found).orderBy(F.desc("tf"), "gram").limit(top)
            if n < hi:
                first = best.agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("least")).first()
                least = first["least"] if first["n"] == top else 0
        if n < hi:
            rows = level.where(F.col("tf") >= least).select("gram").limit(MOST_WORDS + 1).collect()
            if len(rows) > MOST_WORDS:
                return all_ngrams(tokens, lo, hi, min_df, top)
            passed = sorted(r["gram"] for r in rows)
    return best


def _all_rows(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


PIECE_WORDS = 300_000   # words of a task's texts that are looked at together


def _pieces(lists: pa.ListArray, words: int = PIECE_WORDS) -> list[pa.ListArray]:
    """Consecutive texts with at most ``words`` words together; a longer text is alone."""
    ends = lists.offsets.to_numpy()
    out, start = [], 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + words, side="right")) - 1)
        out.append(lists.slice(start, stop - start))
        start = stop
    return out


def _gram_level(tokens: DataFrame, n: int, passed: list[str] | None) -> DataFrame:
    """(gram, df, tf) per batch of texts: n-grams both of whose parts of n - 1 words are in ``passed`` (None: all words)."""
    known = pa.array(passed or [], pa.string())
    vocabulary = pa.array(sorted({w for g in passed or [] for w in g.split(" ")}), pa.string())

    def run(batches):
        for lists in (piece for batch in batches for piece in _pieces(batch.column("w"))):
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            coded = flat.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            if passed is None:
                names, at = coded.dictionary, np.arange(len(codes))
                part = codes
            else:
                # words that no part has are masked; runs of n unmasked words of one text are candidates
                seen = pc.index_in(coded.dictionary, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                word = seen[codes] if len(codes) else codes
                size = len(codes) - n + 1
                at = np.arange(max(size, 0))
                for k in range(n):
                    at = at[(word[at + k] >= 0) & (doc[at + k] == doc[at])]
                columns = [vocabulary.take(pa.array(word[at + k])) for k in range(n)]
                grams = pc.binary_join_element_wise(*columns, " ") if len(at) else pa.array([], pa.string())
                if n > 2 and len(at):
                    left, right = (pc.binary_join_element_wise(*columns[k:k + n - 1], " ") for k in (0, 1))
                    both = pc.and_(pc.is_in(left, known), pc.is_in(right, known))
                    at, grams = at[both.to_numpy(zero_copy_only=False)], grams.filter(both)
                coded = grams.dictionary_encode()
                names, part = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            if not len(at):
                continue
            pairs = np.unique(doc[at].astype(np.int64) * len(names) + part) % len(names)
            yield pa.RecordBatch.from_arrays([
                names, pa.array(np.bincount(pairs, minlength=len(names))), pa.array(np.bincount(part, minlength=len(names)))],
                names=["gram", "df", "tf"])

    return tokens.mapInArrow(run, "gram string, df long, tf long")


def all_ngrams(tokens: DataFrame, lo: int, hi: int, min_df: int, top: int) -> DataFrame:
    """The same from all n-grams of every text.

    Each text is reduced to (gram, count) inside its own row before the explode,
    so one aggregate with map-side combine gives both frequencies.
    """
    firsts = (tokens.select(F.sort_array(ngrams("w", lo, hi)).alias("g"))
              .select(F.explode_outer(F.transform("g", lambda x, i: F.struct(
                  x.alias("gram"),
                  F.when((i > 0) & (F.get(F.col("g"), i - 1) == x), 0).otherwise(1).alias("first")))).alias("s")))
    # the outer explode keeps the n-grams from being computed again in an inferred filter;
    # texts without words give one null gram, whose null df fails the test below
    counts = firsts.groupBy("s.gram").agg(F.sum("s.first").alias("df"), F.count(F.lit(1)).alias("tf"))
    return counts.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "gram").limit(top)


def fit_ngrams(df: DataFrame, text: str, lo: int = 1, hi: int = 3, min_df: int = 30, top: int = 300,
               out: str = "ngram_counts") -> NgramCounts:
    rows = ngram_vocabulary(df, text, lo, hi, min_df, top).select("gram").collect()  # at most ``top`` rows
    return NgramCounts(text, lo, hi, sorted((r["gram"] for r in rows), key=str.encode), out)
