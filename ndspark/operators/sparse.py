"""Coordinates of the non-zero values of a matrix."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters as fl
from .view import View

if TYPE_CHECKING:
    from ..workspace import TensorRef


def reindexed(rows: DataFrame, on: str, view: View, t: TensorRef, axis: int, into: str) -> DataFrame:
    """The rank of each position among the selected ones: by arithmetic for slices, else by a small join."""
    f = view.filter_of(t, axis)
    if f is None:
        return rows.withColumn(into, F.col(on))
    if isinstance(f, fl.SliceFilter):
        r = f.range if f.range.step > 0 else f.range[::-1]
        return rows.withColumn(into, F.floor((F.col(on) - r.start) / r.step).cast("long"))
    from ..plans import layout, select
    from ..plans.staging import staged

    at = select.selected(view.ws, t.axes[axis], f).distinct().orderBy("idx")
    table = layout.numbered(staged(at.withColumnRenamed("idx", on)), 0).withColumnRenamed("idx", into)
    return rows.join(table, on)


def coo(t: TensorRef, rows: Any = None, cols: Any = None) -> DataFrame:
    """(row, col, v): non-zero values of a matrix within filters (or index expressions) on its axes, row and
    col counted among the selected positions, each once."""
    if t.rank != 2 or t.jagged:
        raise ValueError("a sparse matrix needs rank 2")
    as_item = lambda x: slice(None) if x is None else x
    view = t.view((as_item(rows), as_item(cols)))
    unique = [f if not isinstance(f, fl.IndicesFilter) else _set(f) for f in view.filters]
    view = View(t.ws, unique)
    out = view.long(t.name).where((F.col("v") != 0) | F.isnan(F.col("v").cast("double")))
    for axis, into in ((0, "row"), (1, "col")):
        out = reindexed(out, f"i{axis}", view, t, axis, into)
    return out.select("row", "col", "v")


def _set(f: fl.IndicesFilter) -> fl.IndicesFilter:
    return fl.IndicesFilter(f.axis, f.n, np.unique(f.at))
