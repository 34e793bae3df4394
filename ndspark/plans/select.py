"""From filters to rows: predicates where the columns are at hand, semi-joins on idx where not."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters as fl
from . import layout

if TYPE_CHECKING:
    from ..workspace import WorkspaceManager

#: Index arrays up to this length are broadcast.
BROADCAST = 1_000_000


def index_table(ws: WorkspaceManager, at: np.ndarray | DataFrame, name: str) -> DataFrame:
    """Positions, as the client gave them; those of a DataFrame once each."""
    if isinstance(at, DataFrame):
        return at.toDF(name).distinct()
    table = ws._spark.createDataFrame(pa.table({name: pa.array(at, pa.int64())}))
    return F.broadcast(table) if len(at) <= BROADCAST else table


def dimension_rows(ws: WorkspaceManager, names: list[str]) -> DataFrame:
    """(idx, <names>) for rank-1 tensors of one dimension."""
    return layout.columns(ws._catalog, {n: ws._get_tensor(n).spec for n in names})


def held(ws: WorkspaceManager, path: str, rows: DataFrame) -> set[str]:
    """Rank-1 tensors that lie in the files of one segment only, and so can be filtered on where they are."""
    return {t.name for t in ws._tensors() if t.rank == 1 and [s.path for s in t.spec.segments] == [path] and t.spec.segments[0].column == t.name and t.name in rows.columns}


def flagged(ws: WorkspaceManager, rows: DataFrame, on: str, f: fl.Filter) -> DataFrame:
    """rows with a boolean column for each long index array in f."""
    for flag, at in f.tables().items():
        table = index_table(ws, at, "__at").withColumn(flag, F.lit(True))
        rows = rows.join(table, F.col(on) == F.col("__at"), "left").drop("__at")
    return rows


def keep(ws: WorkspaceManager, rows: DataFrame, on: str, f: fl.Filter, have: set[str]) -> DataFrame:
    """The rows whose position `on` is in f; have: rank-1 tensors of that axis among the columns."""
    if isinstance(f, fl.IndicesFilter) and (len(f.at) > fl.IN_LIST or len(np.unique(f.at)) < len(f.at)):
        return rows.join(index_table(ws, f.at, on), on)  # a join keeps duplicates
    if f.tensors <= have:
        columns = rows.columns
        return flagged(ws, rows, on, f).where(f.predicate(F.col(on), F.col)).select(*columns)
    return rows.join(selected(ws, f.axis, f).withColumnRenamed("idx", on), on, "left_semi")


def selected(ws: WorkspaceManager, axis: fl.Axis, f: fl.Filter) -> DataFrame:
    """(idx): the positions of f."""
    if isinstance(f, fl.IndicesFilter):
        return index_table(ws, f.at, "idx")
    if not f.tensors:
        rows = ws._spark.range(f.n).withColumnRenamed("id", "idx")
    else:
        rows = dimension_rows(ws, sorted(f.tensors))
    return flagged(ws, rows, "idx", f).where(f.predicate(F.col("idx"), F.col)).select("idx")
