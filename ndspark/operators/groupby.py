"""Grouped element-wise statistics along the first axis."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import STATISTICS, aggregate
from ..plans import layout, select
from ..plans.staging import staged
from .filters import IndicesFilter
from .view import View

if TYPE_CHECKING:
    from ..workspace import Dimension


class Grouped:
    """view.groupby(labels): labels are a rank-1 tensor's name, a DataFrame (idx, label), an array aligned
    with the selection (or the whole dimension), or None for one group 0.0. projection maps a label Column to
    another; for a function of Python values pass pandas_udf of it.

    Each statistic gives a DataFrame (label, [i1, ...], <statistic>); stats() gives all in one pass."""

    def __init__(self, view: View, labels: Any = None, projection: Callable[[Column], Column] | None = None):
        self.view, self.labels, self.projection = view, labels, projection
        if isinstance(labels, str) and view.ws._get_tensor(labels).rank != 1:
            raise ValueError("labels need a tensor of rank 1")

    def _labelled(self, rows: DataFrame, on: str, axis: Any) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("label", F.lit(0.0))
        if isinstance(self.labels, str):
            t = self.view.ws._get_tensor(self.labels)
            if t.axes[0] != axis:
                raise ValueError(f"labels lie on {t.axes[0]!r}, the values on {axis!r}")
            found = View(self.view.ws, [f for f in self.view.filters if f.axis == axis]).columns(self.labels).withColumnRenamed(self.labels, "label")
            if isinstance(self.view.axes.get(axis), IndicesFilter):
                found = found.distinct()  # positions given twice
        elif isinstance(self.labels, DataFrame):
            found = self.labels.select("idx", "label")
        else:
            values = np.asarray(self.labels)
            f = self.view.axes.get(axis)
            known = None if f is None else f.positions()
            at = np.arange(len(values)) if known is None else known
            n = self.view.get_length(axis)
            if len(values) != n:
                raise ValueError(f"{len(values)} labels for {n} positions")
            found = self.view.ws._spark.createDataFrame(pa.table({"idx": pa.array(at, pa.int64()), "label": pa.array(values.tolist())}))
            if f is not None and known is None:  # the n-th label is for the n-th selected position
                order = layout.numbered(staged(self.view.positions(axis).orderBy("idx")).withColumnRenamed("idx", "at"), 0)
                found = order.join(found, "idx").select(F.col("at").alias("idx"), "label")
        return rows.join(found.withColumnRenamed("idx", on), on)

    def _beside(self, own: DataFrame, path: str, axis: Any) -> DataFrame:
        """Rows of a file with their label, read from the same file where it holds the labels too."""
        if isinstance(self.labels, str) and self.labels in select.held(self.view.ws, path, own) and self.view.ws._get_tensor(self.labels).axes[0] == axis:
            return own.withColumn("label", F.col(self.labels))
        return self._labelled(own, "idx", axis)

    def stats(self, of: str, names: list[str] | None = None, nan: bool = False, order: bool = False) -> DataFrame:
        """The named statistics (all by default) of a tensor in one pass. nan: NaN, not NULL, where moments are
        undefined. order: also `order`, the first position of each label."""
        t = self.view.ws._get_tensor(of)
        if t.jagged:
            raise NotImplementedError("jagged tensors can't be grouped")
        if t.rank == 0:
            raise ValueError("a scalar has no groups")
        names = list(STATISTICS) if names is None else names
        if t.dtype == "string" and set(names) - {"count", "first", "min", "max"}:
            raise TypeError("strings have no moments")
        if t.rank == 1:
            direct = isinstance(self.labels, str) and self.view.ws._get_tensor(self.labels).axes == t.axes
            both = [of, self.labels] if direct and self.labels != of else [of]
            rows = self.view.columns(*both).withColumn("v", F.col(of))
            rows, on, keys = rows.withColumn("label", F.col(self.labels)) if direct else rows, "idx", []
            rows = rows if direct else self._labelled(rows, on, t.axes[0])
        else:
            rows, on, keys = self.view.long(of, lambda own, path: self._beside(own, path, t.axes[0])), "i0", [f"i{k}" for k in range(1, t.rank)]
        if self.projection:
            rows = rows.withColumn("label", self.projection(F.col("label")))
        value = F.col("v").cast("int") if t.dtype == "bool" else F.col("v")
        columns = [aggregate(n, value, F.col(on), nan).alias(n) for n in names]
        return rows.groupBy("label", *keys).agg(*columns, *([F.min(on).alias("order")] if order else []))

    def to_numpy(self, of: str, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(labels, values), labels in the order in which they first appear."""
        t = self.view.ws._get_tensor(of)
        rows = self.stats(of, [name], nan=True, order=True)
        keys = [f"i{k}" for k in range(1, t.rank)]
        got = rows.orderBy("order", "label", *keys).collect()
        labels = list(dict.fromkeys(r.label for r in got))
        shape = self.view.get_shape(of)[1:]
        return np.array(labels), np.array([r[name] for r in got]).reshape(len(labels), *shape)


def _add(name: str) -> None:
    def one(self: Grouped, of: str) -> DataFrame:
        return self.stats(of, [name])

    one.__name__, one.__doc__ = name, f"(label, [i1, ...], {name}) of a tensor."
    setattr(Grouped, name, one)


for _name in STATISTICS:
    _add(_name)


class GroupViewBy(Grouped):
    """Groups within a view."""


class GroupDimensionBy(Grouped):
    """Groups over a whole dimension; values must lie on it."""

    def __init__(self, dim: Dimension, labels: Any = None, projection: Callable[[Column], Column] | None = None):
        super().__init__(View(dim.ws, []), labels, projection)
        self.dim = dim

    def stats(self, of: str, names: list[str] | None = None, nan: bool = False, order: bool = False) -> DataFrame:
        if self.view.ws._get_tensor(of).axes[:1] != (self.dim.name,):
            raise ValueError(f"{of} doesn't begin with dimension {self.dim.name}")
        return super().stats(of, names, nan, order)


class Accumulator:
    """Moments of one group, kept up as arrays come; two accumulators merge."""

    def __init__(self) -> None:
        self.n = 0

    def add(self, x: Any) -> None:
        x, one = np.asarray(x, float), Accumulator()
        one.n, one.first, one.least, one.most, one.positive = 1, x, x, x, (x > 0).astype(float)
        one.mean_, one.m2, one.m3, one.m4 = x, 0 * x, 0 * x, 0 * x
        self.merge(one)

    def merge(self, other: Accumulator) -> None:
        if other.n == 0:
            return
        if self.n == 0:
            self.__dict__.update(other.__dict__)
            return
        a, b = self.n, other.n
        n, d = a + b, other.mean_ - self.mean_
        m4 = self.m4 + other.m4 + d**4 * a * b * (a * a - a * b + b * b) / n**3 + 6 * d**2 * (a * a * other.m2 + b * b * self.m2) / n**2 + 4 * d * (a * other.m3 - b * self.m3) / n
        m3 = self.m3 + other.m3 + d**3 * a * b * (a - b) / n**2 + 3 * d * (a * other.m2 - b * self.m2) / n
        self.m2, self.m3, self.m4 = self.m2 + other.m2 + d**2 * a * b / n, m3, m4
        self.mean_, self.n = self.mean_ + d * b / n, n
        self.least, self.most, self.positive = np.minimum(self.least, other.least), np.maximum(self.most, other.most), self.positive + other.positive

    def get(self, name: str) -> Any:
        with np.errstate(all="ignore"):
            return {
                "count": lambda: self.n,
                "sum": lambda: self.mean_ * self.n,
                "mean": lambda: self.mean_,
                "nnz": lambda: self.positive,
                "first": lambda: self.first,
                "min": lambda: self.least,
                "max": lambda: self.most,
                "variance": lambda: self.m2 / (self.n - 1) if self.n > 1 else self.m2 * np.nan,
                "sd": lambda: np.sqrt(self.get("variance")),
                "skewness": lambda: np.sqrt(self.n) * self.m3 / self.m2**1.5,
                "kurtosis": lambda: self.n * self.m4 / self.m2**2,
            }[name]()
