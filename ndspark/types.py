"""Element types of tensors, the Spark types that hold them, and the casts between them."""

from __future__ import annotations

import numbers
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DType:
    """name: as declared; spark: the type of the column; python: what constants are cast to."""

    name: str
    spark: T.DataType
    python: type
    low: int | None = None
    high: int | None = None

    @property
    def default(self) -> Any:
        return self.python()

    def literal(self, value: Any) -> Any:
        """A constant in this type, as comparisons use it: 10.7 against integers is 10, 10 against strings "10"."""
        if isinstance(value, np.generic):
            value = value.item()
        if self.name == "string":
            return value if isinstance(value, str) else str(value)
        if isinstance(value, str):
            return self.python(float(value)) if self.python is int else self.python(value)
        if not isinstance(value, numbers.Number):
            raise TypeError(f"{value!r} is no constant of type {self.name}")
        return self.python(value)

    def lit(self, value: Any) -> Column:
        return F.lit(Decimal(value) if self.name == "uint64" else value)

    def cast(self, column: Column) -> Column:
        """The column in this type; values out of range raise, as Spark's ANSI casts do."""
        if self.name == "float16":
            return half(column.cast("float"))
        out = column.cast(self.spark)
        if self.name.startswith("uint"):
            fits = out.isNull() | out.between(self.lit(self.low), self.lit(self.high))
            return F.when(fits, out).otherwise(F.raise_error(F.concat(F.lit(f"out of range for {self.name}: "), out.cast("string"))).cast(self.spark))
        return out


def half(x: Column) -> Column:
    """The nearest half-precision number, as a float: 11 significant bits, ties to even."""
    exponent = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14))
    step = F.pow(F.lit(2.0), exponent - 10)
    rounded = (F.rint(x / step) * step).cast("float")
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).when(F.abs(rounded) > 65504, F.signum(x) * float("inf")).otherwise(rounded).cast("float")


_INTS = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0)}
DTYPES: dict[str, DType] = {
    "bool": DType("bool", T.BooleanType(), bool),
    **{n: DType(n, t, int, *((0, 2 ** int(n[4:]) - 1) if n[0] == "u" else (-(2 ** (int(n[3:]) - 1)), 2 ** (int(n[3:]) - 1) - 1))) for n, t in _INTS.items()},
    "float16": DType("float16", T.FloatType(), float),
    "float32": DType("float32", T.FloatType(), float),
    "float64": DType("float64", T.DoubleType(), float),
    "string": DType("string", T.StringType(), str),
}

_FROM_SPARK = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "string": "string"}


def dtype(name: str) -> DType:
    if name not in DTYPES:
        raise TypeError(f"{name!r} is no element type; one of {', '.join(DTYPES)}")
    return DTYPES[name]


def dtype_of(kind: T.DataType) -> str | None:
    """The element type that a Spark type holds, or None for types that tensors don't have."""
    return _FROM_SPARK.get(kind.simpleString())
