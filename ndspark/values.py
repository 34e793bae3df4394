"""Payloads: arrays, lists and DataFrames on their way into tensors."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import TensorSpec


class TensorValue:
    """A payload with its shape checked. values: an array, a list of arrays (jagged), or a scalar.

    Jagged rows may differ in their trailing sizes but not in rank."""

    def __init__(self, values: Any, jagged: bool = False):
        self.jagged = jagged
        if jagged:
            self.rows = [np.asarray(v) for v in values]
            if len({r.ndim for r in self.rows}) > 1:
                raise ValueError("rows of a jagged tensor have one rank")
            inner = [max(s) for s in zip(*[r.shape for r in self.rows], strict=True)] if self.rows else []
            self.shape = (len(self.rows), *inner)
        else:
            self.array = np.asarray(values)
            if self.array.dtype == object and any(isinstance(v, (list, np.ndarray)) for v in self.array.ravel()):
                raise ValueError("rows of different sizes need a jagged tensor")
            self.shape = self.array.shape
        self.rank = len(self.shape)

    def __len__(self) -> int:
        return self.shape[0] if self.rank else 1

    def axis0(self, k: int) -> int:
        return self.shape[k]

    def pandas(self, start: int, moved: bool = False) -> pd.DataFrame:
        """idx and v, and shape for jagged values."""
        idx = np.arange(start, start + len(self), dtype=np.int64)
        if self.jagged:
            return pd.DataFrame({"idx": idx, "shape": [[*map(int, r.shape)] for r in self.rows], "v": [r.ravel().tolist() for r in self.rows]})
        a = self.array
        return pd.DataFrame({"idx": idx, "v": a.tolist() if self.rank == 1 else [r.ravel().tolist() for r in a]})


def frame(spark: SparkSession, spec: TensorSpec, value: TensorValue, start: int) -> DataFrame:
    """Typed rows of a payload: (idx, v) or (idx, shape, v), values cast to the tensor's type."""
    kind = spec.kind
    wide = "string" if kind.name == "string" else "boolean" if kind.name == "bool" else "decimal(20,0)" if kind.name == "uint64" else "bigint" if kind.python is int else "double"
    as_wide = {"string": str, "boolean": bool, "bigint": lambda x: math.trunc(x), "double": float}
    from decimal import Decimal

    convert = as_wide.get(wide, lambda x: Decimal(int(x)))
    rows = value.pandas(start)
    flat = value.rank == 1 and not value.jagged
    data = [(int(r[0]), *([list(r[1])] if value.jagged else []), convert(r[-1]) if flat else [convert(x) for x in r[-1]]) for r in rows.itertuples(index=False)]
    shape = "shape array<int>, " if value.jagged else ""
    df = spark.createDataFrame(data, f"idx long, {shape}v {wide if flat else f'array<{wide}>'}")
    v = kind.cast(F.col("v")) if flat else F.transform("v", kind.cast)
    return df.select("idx", *(["shape"] if value.jagged else []), v.alias("v"))
