"""Fitted transforms: small statistics on the driver, Columns on the data."""

from __future__ import annotations

import dataclasses
import json
from typing import ClassVar

from pyspark.sql import DataFrame


class Fitted:
    """Base of frozen dataclasses whose fields are JSON-ready statistics."""

    kinds: ClassVar[dict[str, type]] = {}

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        Fitted.kinds[cls.__name__] = cls

    @property
    def per_batch(self) -> bool:
        """Whether a stream has to apply it batch by batch, since it looks at all rows it is given at once."""
        return False

    @property
    def per_row(self) -> bool:
        """Whether a row follows from itself alone, so that rows keep their place and order."""
        return not self.per_batch

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def inverse_values(self, column: str, values: list[float]) -> list[float]:
        """A few numbers of a transformed column, such as borders, back on its own scale; NaN where there is none."""
        raise ValueError(f"{type(self).__name__} cannot be undone")

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.transform(df)

    def to_json(self) -> str:
        return json.dumps(_pack(self))

    @staticmethod
    def from_json(text: str) -> "Fitted":
        return _unpack(json.loads(text))


def _pack(x):
    if isinstance(x, Fitted):
        return {"kind": type(x).__name__,
                **{f.name: _pack(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    if isinstance(x, (list, tuple)):
        return [_pack(v) for v in x]
    if isinstance(x, dict):
        return {k: _pack(v) for k, v in x.items()}
    return x


def _unpack(x):
    if isinstance(x, dict):
        body = {k: _unpack(v) for k, v in x.items() if k != "kind"}
        return Fitted.kinds[x["kind"]](**body) if "kind" in x else body
    if isinstance(x, list):
        return [_unpack(v) for v in x]
    return x


@dataclasses.dataclass(frozen=True)
class Chain(Fitted):
    """Fitted steps in order."""

    steps: list

    @property
    def per_batch(self) -> bool:
        return any(step.per_batch for step in self.steps)

    @property
    def per_row(self) -> bool:
        return all(step.per_row for step in self.steps)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def inverse_values(self, column: str, values: list[float]) -> list[float]:
        for step in reversed(self.steps):
            values = step.inverse_values(column, values)
        return values


@dataclasses.dataclass(frozen=True)
class Copy(Fitted):
    """Suffixed copies of columns, as doubles."""

    cols: list
    suffix: str

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c + self.suffix: df[c].cast("double") for c in self.cols})
