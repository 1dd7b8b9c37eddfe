"""Projection, filters, imputing and string cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .fitted import Fitted

INF = float("inf")


def project(df: DataFrame, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Keep the listed columns, or all but the dropped ones."""
    return df.select(*[c for c in (keep or df.columns) if c not in set(drop)])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def fill_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in cols})


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(cols) if cols else None)


def finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN and infinities become null."""
    return df.withColumns({c: finite_col(F.col(c)) for c in cols})


def finite_col(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == INF), None).otherwise(x)


def missing_indicator(df: DataFrame, cols: Sequence[str], suffix: str = "_missing") -> DataFrame:
    """-2 for NaN or null, 2 for +inf, 4 for -inf, else 0; run before :func:`finite`."""
    def flag(c):
        x = F.col(c).cast("double")
        return (F.when(x.isNull() | F.isnan(x), -2.0).when(x == INF, 2.0)
                .when(x == -INF, 4.0).otherwise(0.0))
    return df.withColumns({c + suffix: flag(c) for c in cols})


@dataclass(frozen=True)
class FillValues(Fitted):
    """Null -> one fitted value per column."""

    values: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})


def fill_constant(df: DataFrame, cols: Sequence[str], value=0) -> DataFrame:
    """Fill nulls with a constant; a column without nulls is left as it is by definition."""
    return df.na.fill(value, subset=list(cols))


def fit_sentinel(df: DataFrame, cols: Sequence[str]) -> FillValues:
    """Missing -> column minimum - 1 (an empty column gets -1)."""
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return FillValues({c: (row[c] if row[c] is not None else 0.0) - 1 for c in cols})


def sentinel_per_split(df: DataFrame, cols: Sequence[str], split: str) -> DataFrame:
    """The variant that imputes every split with its own minimum.

    Splits are few, so the per-split minima are joined back after a pre-aggregation.
    """
    from .ordered import null_safe_join, sized
    mins = df.groupBy(split).agg(*[(F.coalesce(F.min(F.col(c).cast("double")), F.lit(0.0)) - 1).alias(f"_m_{c}")
                                   for c in cols])
    out = null_safe_join(df, sized(mins), [split], "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in cols}).drop(
        *[f"_m_{c}" for c in cols])


def fit_mean_impute(df: DataFrame, cols: Sequence[str]) -> FillValues:
    """Missing -> column mean; an empty column is kept as zeros."""
    row = df.agg(*[F.avg(F.col(c)).alias(c) for c in cols]).first()
    return FillValues({c: row[c] if row[c] is not None else 0.0 for c in cols})


def concat_text(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Join text fields with blanks; nulls count as empty fields and keep their blank."""
    return df.withColumn(out, F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def last_year(text: Column) -> Column:
    """The last run of four digits as an int, or null."""
    return F.regexp_extract(text, r"(?s).*(\d{4})", 1).try_cast("int")


def normalise_types(df: DataFrame, categorical: Sequence[str] = ()) -> DataFrame:
    """Numbers and booleans -> double, listed columns and text -> string; dates are refused."""
    out = {}
    for field in df.schema:
        kind = field.dataType
        if field.name in categorical or isinstance(kind, T.StringType):
            out[field.name] = F.col(field.name).cast("string")
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            out[field.name] = F.col(field.name).cast("double")
        else:
            raise ValueError(f"column {field.name}: {kind.simpleString()} is not supported, derive a number first")
    return df.withColumns(out)


def strip_cast(text: Column, pattern: str, kind: str = "int") -> Column:
    """Remove a pattern and cast; what does not parse becomes null."""
    return F.regexp_replace(text, pattern, "").try_cast(kind)


def first_token(text: Column, delimiter: str = "-", kind: str = "int") -> Column:
    return F.split_part(text, F.lit(delimiter), F.lit(1)).try_cast(kind)


def contains_label(text: Column, needle: str) -> Column:
    return F.contains(text, F.lit(needle)).cast("int")


def replace_values(df: DataFrame, c: str, mapping: Mapping) -> DataFrame:
    return df.replace(dict(mapping), subset=[c])


def onehot_to_label(flags: Mapping[str, str] | Sequence[str]) -> Column:
    """Name of the first flag column that equals 1, else null."""
    names = dict(flags) if isinstance(flags, Mapping) else {c: c for c in flags}
    return F.coalesce(*[F.when(F.col(c) == 1, F.lit(label)) for c, label in names.items()])


def path_parts(df: DataFrame, path: str) -> DataFrame:
    """dir_name, base_name, stem and extension of a slash path."""
    parts = F.split(F.col(path), "/")
    base = F.element_at(parts, -1)
    return df.withColumns({
        "dir_name": F.get(parts, F.size(parts) - 2),
        "base_name": base,
        "stem": F.regexp_extract(base, r"^(.*?)(\.[^.]*)?$", 1),
        "extension": F.regexp_extract(base, r"\.([^.]*)$", 1),
    })


def elementwise(df: DataFrame, cols: Sequence[str], fn: str, suffix: str = "") -> DataFrame:
    """A named function over columns: log, log1p, exp or a registered transform."""
    apply = TRANSFORMS[fn][0]
    return df.withColumns({c + suffix: apply(F.col(c).cast("double")) for c in cols})


# name -> (function, inverse), both over Columns
TRANSFORMS = {
    "identity": (lambda x: x, lambda x: x),
    "log": (lambda x: F.when(x > 0, F.log(x)), F.exp),
    "log1p": (lambda x: F.when(x > -1, F.log1p(x)), F.expm1),
    "exp": (F.exp, lambda x: F.when(x > 0, F.log(x))),
}


def register_transform(name: str, fn, inverse=None, replace: bool = False) -> None:
    """Add an elementwise Column function for :func:`elementwise` and reshaping."""
    if name in TRANSFORMS and not replace:
        raise ValueError(f"transform {name} exists")
    TRANSFORMS[name] = (fn, inverse)
