"""Element-wise statistics as aggregate columns; all of them in one pass over the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _moment(f: Callable[[Column], Column]) -> Callable[[Column, Column, Column], Column]:
    return lambda x, raw, at: f(x)


#: name -> (values as doubles, values as they are, position) -> aggregate
STATISTICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "sum": _moment(F.sum),
    "count": lambda x, raw, at: F.count(F.lit(1)),
    "nnz": _moment(lambda x: F.count_if((x > 0) & ~F.isnan(x))),  # greater than zero, as the name doesn't say
    "nonzero": _moment(lambda x: F.count_if(x != 0)),
    "mean": _moment(F.avg),
    "variance": _moment(F.var_samp),
    "sd": _moment(F.stddev_samp),
    "skewness": _moment(F.skewness),
    "kurtosis": _moment(lambda x: F.kurtosis(x) + 3),  # not the excess
    "min": lambda x, raw, at: F.min(raw),
    "max": lambda x, raw, at: F.max(raw),
    "first": lambda x, raw, at: F.min_by(raw, at),
}

#: Where Spark has NULL for undefined moments, numpy has NaN.
UNDEFINED = ("variance", "sd", "skewness", "kurtosis")


def aggregate(name: str, value: Column, at: Column, nan: bool = False) -> Column:
    if name not in STATISTICS:
        raise ValueError(f"{name!r} is no statistic; one of {', '.join(STATISTICS)}")
    out = STATISTICS[name](value.cast("double"), value, at)
    return F.coalesce(out, F.lit(float("nan"))) if nan and name in UNDEFINED else out
