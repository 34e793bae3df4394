"""Annotated-matrix bundles: a matrix with tables of its rows and columns, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sparse import coo
from .view import View

if TYPE_CHECKING:
    from ..workspace import WorkspaceManager

#: A column is categorical if it has fewer distinct values than this share of the rows.
CATEGORICAL = 0.1


@dataclass
class Bundle:
    """X and layers: (row, col, v). obs, var: a row per position, with idx and key. obsm, varm: (idx, v) arrays."""

    X: DataFrame
    obs: DataFrame
    var: DataFrame
    shape: tuple[int, int]
    layers: dict[str, DataFrame] = field(default_factory=dict)
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    categorical: dict[str, list[str]] = field(default_factory=dict)

    def to_pandas(self, side: str = "obs"):  # noqa: ANN201
        """One of the tables on the client, in order, with its categorical columns."""
        table = getattr(self, side).orderBy("idx").toPandas().set_index("idx")
        return table.astype(dict.fromkeys(self.categorical.get(side, []), "category"))


def renamed(names: Iterable[str]) -> dict[str, str]:
    """Names by tensor from entries "Tensor" or "Tensor->New"."""
    return {a.strip(): (b.strip() or a.strip()) for a, _, b in (n.partition("->") for n in names)}


def automatic(ws: WorkspaceManager, dim: str, other: str, rank: int) -> list[str]:
    """Tensors of this rank on dim; matrices against the other dimension are no annotations."""
    return [t.name for t in ws._tensors() if t.rank == rank and not t.jagged and t.dims[0] == dim and not (rank == 2 and t.dims[1] == other)]


def chosen(ws: WorkspaceManager, given: str | Iterable[str] | None, dim: str, other: str, rank: int) -> dict[str, str]:
    """"auto" (alone or among "Old->New" entries) takes all that fit."""
    names = ["auto"] if given == "auto" else list(given or [])
    out = dict.fromkeys(automatic(ws, dim, other, rank)) if "auto" in names else {}
    out = {n: n for n in out}
    return out | renamed(n for n in names if n != "auto")


def unique_names(rows: DataFrame, key: str) -> DataFrame:
    """key made unique: the second "a" becomes "a-1", and so on."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1
    return rows.withColumn("__nth", nth).withColumn(key, F.when(F.col("__nth") > 0, F.concat_ws("-", F.col(key), F.col("__nth"))).otherwise(F.col(key).cast("string"))).drop("__nth")


def table(view: View, names: dict[str, str], dim: str, key: str | None) -> DataFrame:
    wanted = {**names, **({key: key} if key and key not in names else {})}
    rows = view.columns(*wanted) if wanted else view.positions(dim)
    rows = rows.withColumnsRenamed({a: b for a, b in wanted.items() if a != b})
    return unique_names(rows, wanted[key]) if key else rows


def categorical(rows: DataFrame, share: float = CATEGORICAL) -> list[str]:
    """Text columns with few distinct values, counted exactly."""
    texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
    if not texts:
        return []
    got = rows.agg(F.count("*").alias("__n"), *[F.count_distinct(c).alias(c) for c in texts]).first()
    return [c for c in texts if got[c] < share * got["__n"]]


def bundle(view: View, X: str = "Expression", obs="auto", var="auto", obsm="auto", varm="auto", layers=(), obs_key: str | None = None, var_key: str | None = None, rows: str = "cells", cols: str = "genes") -> Bundle:  # noqa: ANN001, N803
    """The selection as a bundle; rows and cols name the two dimensions."""
    ws = view.ws
    on = lambda dim: view.axes.get(dim)
    matrix = lambda name: coo(ws._get_tensor(name), on(rows), on(cols))
    obs_table = table(view, chosen(ws, obs, rows, cols, 1), rows, obs_key)
    var_table = table(view, chosen(ws, var, cols, rows, 1), cols, var_key)
    arrays = lambda given, dim, other: {new: View(ws, [f for f in view.filters if f.axis == dim]).rows(old) for old, new in chosen(ws, given, dim, other, 2).items()}
    return Bundle(matrix(X), obs_table, var_table, (view.get_length(rows), view.get_length(cols)), {new: matrix(old) for old, new in renamed(layers).items()}, arrays(obsm, rows, cols), arrays(varm, cols, rows), {"obs": categorical(obs_table), "var": categorical(var_table)})


def selected_bundle(ws: WorkspaceManager, only_selected: bool = False, valid_genes: str | None = None, selected: str = "Selected", rows: str = "cells", cols: str = "genes", **how) -> Bundle:  # noqa: ANN003
    """The bundle of rows that a boolean tensor marks (if only_selected) and of columns that another marks (if given)."""
    filters = ([ws._get_tensor(selected) == True] if only_selected else []) + ([ws._get_tensor(valid_genes) == True] if valid_genes else [])  # noqa: E712
    return bundle(View(ws, filters), rows=rows, cols=cols, **how)
