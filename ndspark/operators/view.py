"""Views: filters per axis, through which tensors are read, grouped and written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import layout, select
from ..schema import Segment
from . import filters as fl

if TYPE_CHECKING:
    from ..workspace import TensorRef, WorkspaceManager


class View:
    """ws[f, g]: one filter per axis; several on one axis hold together. Lazy: reading gives DataFrames.

    Rank 1 reads as (idx, <name>), rank >= 2 as (i0, i1, ..., v), jagged tensors as (idx, shape, v); idx
    and i0... are positions in the tensor. Rows carry them instead of an order; sort by them where it matters."""

    def __init__(self, ws: WorkspaceManager, filters: list[fl.Filter]):
        axes: dict[fl.Axis, fl.Filter] = {}
        for f in filters:
            axes[f.axis] = axes[f.axis] & f if f.axis in axes else f
        self.__dict__.update(ws=ws, axes=axes)

    @property
    def filters(self) -> list[fl.Filter]:
        return list(self.axes.values())

    def single_filter(self) -> fl.Filter:
        if len(self.axes) != 1:
            raise ValueError("a view takes part in filter algebra if it has exactly one filter")
        return self.filters[0]

    def __and__(self, other: Any) -> fl.Filter:
        return self.single_filter() & other

    def __or__(self, other: Any) -> fl.Filter:
        return self.single_filter() | other

    def __xor__(self, other: Any) -> fl.Filter:
        return self.single_filter() ^ other

    def __sub__(self, other: Any) -> fl.Filter:
        return self.single_filter() - other

    def __invert__(self) -> fl.Filter:
        return ~self.single_filter()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def __getitem__(self, name: str) -> DataFrame:
        if not isinstance(name, str):
            raise KeyError("a view is read by tensor names")
        return self.read(name)

    def __setattr__(self, name: str, values: Any) -> None:
        self.write(name, values)

    __setitem__ = __setattr__

    # -- reading

    def filter_of(self, tensor: TensorRef, axis: int) -> fl.Filter | None:
        return self.axes.get(tensor.axes[axis])

    def read(self, name: str) -> DataFrame:
        t = self.ws._get_tensor(name)
        if t.rank == 0:
            return self.ws._spark.createDataFrame([(t.spec.value,)], f"v {t.spec.kind.spark.simpleString()}")
        if t.jagged:
            return self._jagged(t)
        return self.columns(name) if t.rank == 1 else self.long(name)

    def columns(self, *names: str) -> DataFrame:
        """(idx, <names>): rank-1 tensors of one dimension, aligned by position."""
        tensors = [self.ws._get_tensor(n) for n in names]
        if any(t.rank != 1 or t.axes != tensors[0].axes for t in tensors):
            raise ValueError("aligned columns need rank-1 tensors of one dimension")
        f = self.filter_of(tensors[0], 0)
        if f is None:
            return select.dimension_rows(self.ws, list(names))
        rows = select.dimension_rows(self.ws, [*names, *(t for t in sorted(f.tensors) if t not in names)])
        return select.keep(self.ws, rows, "idx", f, set(rows.columns)).select("idx", *names)

    def long(self, name: str, label: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
        """(i0, i1, ..., v) of a tensor of rank 2 or more. The first axis is filtered, and given the column that
        label adds to (idx, ...) of a file, before rows are taken apart."""
        t = self.ws._get_tensor(name)
        first = self.filter_of(t, 0)
        rows = {}
        spec = t.spec
        for s in spec.segments:
            own = self.ws._catalog.frame(s.path)
            rows[s.path] = select.keep(self.ws, own, "idx", first, select.held(self.ws, s.path, own)) if first is not None else own
            if label:
                rows[s.path] = label(rows[s.path], s.path)
        spec, rows = self._sliced(t, spec, rows)
        out = layout.long_form(self.ws._catalog, spec, rows, ["label"] if label else [])
        for k in range(1, t.rank):
            if (f := self.filter_of(t, k)) is not None:
                out = select.keep(self.ws, out, f"i{k}", f, set())
        return out

    def _sliced(self, t: TensorRef, spec, rows: dict[str, DataFrame]):  # noqa: ANN001, ANN202
        """Rank 2 with a contiguous slice of the second axis: cut the arrays before they are taken apart."""
        f = self.filter_of(t, 1) if t.rank == 2 else None
        if not isinstance(f, fl.SliceFilter) or f.range.step != 1 or any(s.offsets != (0,) for s in spec.segments):
            return spec, rows
        from dataclasses import replace

        size = len(f.range)
        cut = {p: r.withColumn(s.column, F.slice(s.column, f.range.start + 1, size) if size else F.slice(s.column, 1, 0)) for s in spec.segments for p, r in rows.items() if p == s.path}
        return replace(spec, segments=tuple(Segment(s.path, s.column, (f.range.start,), (size,)) for s in spec.segments)), cut

    def rows(self, name: str) -> DataFrame:
        """(idx, v): rows of a tensor of rank 2 or more as arrays, last axis fastest; only for filters on the first axis."""
        t = self.ws._get_tensor(name)
        whole = layout.row_form(self.ws._catalog, t.spec)
        if whole is None or any(self.filter_of(t, k) is not None for k in range(1, t.rank)):
            return layout.rows_of(self.long(name), t.rank)
        f = self.filter_of(t, 0)
        return whole if f is None else select.keep(self.ws, whole, "idx", f, set())

    def _jagged(self, t: TensorRef) -> DataFrame:
        """(idx, shape, v): filters on trailing axes are clipped by each row's own size."""
        parts = [self.ws._catalog.frame(s.path).select("idx", "shape", F.col(s.column).alias("v")) for s in t.spec.segments]
        if not parts:
            return self.ws._spark.createDataFrame([], f"idx long, shape array<int>, v array<{t.spec.kind.spark.simpleString()}>")
        rows = layout.union(parts)
        if (f := self.filter_of(t, 0)) is not None:
            rows = select.keep(self.ws, rows, "idx", f, set())
        chosen = {k: self.filter_of(t, k) for k in range(1, t.rank) if self.filter_of(t, k) is not None}
        if not chosen:
            return rows
        known = {k: f.positions() for k, f in chosen.items()}
        if any(p is None for p in known.values()):
            raise NotImplementedError("trailing axes of jagged tensors are filtered by position")
        for k, at in known.items():
            size, none = F.get("shape", F.lit(k - 1)), F.array().cast("array<int>")
            if isinstance(chosen[k], fl.SliceFilter):
                last = F.least(F.lit(int(at[-1])), size - 1) if len(at) else F.lit(-1)
                step = int(at[1] - at[0]) if len(at) > 1 else 1
                there = F.when(last >= (int(at[0]) if len(at) else 0), F.sequence(F.lit(int(at[0]) if len(at) else 0), last, F.lit(step))).otherwise(none)
            else:
                there = F.filter(F.array(*[F.lit(int(p)) for p in at]).cast("array<int>"), lambda p, size=size: p < size)
            inner = F.aggregate(F.slice("shape", k + 1, max(1, t.rank)), F.lit(1), lambda a, b: a * b)
            outer = F.aggregate(F.slice("shape", 1, k - 1), F.lit(1), lambda a, b: a * b) if k > 1 else F.lit(1)
            rows = rows.select("idx", "shape", "v", size.alias("size"), inner.alias("inner"), there.alias("there"), outer.alias("outer"))
            blocks = F.flatten(F.transform(F.when(F.col("outer") > 0, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.array().cast("array<int>")), lambda o: F.transform("there", lambda p: F.slice("v", (o * F.col("size") + p) * F.col("inner") + 1, F.col("inner")))))
            shape = F.transform("shape", lambda s, j: F.when(j == k - 1, F.size("there")).otherwise(s))
            rows = rows.select("idx", shape.alias("shape"), F.flatten(blocks).alias("v"))
        return rows

    def positions(self, dim: str) -> DataFrame:
        """(idx): the selected positions of a dimension."""
        f = self.axes.get(dim)
        n = self.ws._get_dimension(dim).length
        return self.ws._spark.range(n).withColumnRenamed("id", "idx") if f is None else select.selected(self.ws, dim, f)

    def get_length(self, dim: str) -> int:
        f = self.axes.get(dim)
        if f is None:
            return self.ws._get_dimension(dim).length
        known = f.positions()
        return len(known) if known is not None else self.positions(dim).count()

    def get_shape(self, name: str) -> tuple[int, ...]:
        t = self.ws._get_tensor(name)
        out = []
        for k, a in enumerate(t.axes):
            f = self.axes.get(a)
            known = f.positions() if f is not None else None
            out.append(t.shape[k] if f is None else len(known) if known is not None else select.selected(self.ws, a, f).count())
        return tuple(out)

    def to_numpy(self, name: str) -> Any:
        """The selection on the client, in ascending order: an array, or one array per row if jagged."""
        t = self.ws._get_tensor(name)
        if t.rank == 0:
            return t.spec.value
        kind = object if t.dtype == "string" else t.dtype
        if t.jagged:
            return [np.array(r.v, dtype=kind).reshape(r.shape) for r in self.read(name).orderBy("idx").collect()]
        if t.rank == 1:
            return np.array([r[0] for r in self.read(name).orderBy("idx").select(name).collect()], dtype=kind)
        keys = [f"i{k}" for k in range(t.rank)]
        return np.array([r.v for r in self.long(name).orderBy(*keys).select("v").collect()], dtype=kind).reshape(self.get_shape(name))

    def batches(self, name: str, rows: int = 1000) -> Iterator[tuple[np.ndarray, Any]]:
        """(positions on the first axis, values) of so many rows at a time, in ascending order; one partition at a time
        comes to the client. Values are arrays, or a list of arrays if the tensor is jagged."""
        t = self.ws._get_tensor(name)
        if t.rank == 0:
            raise ValueError("a scalar has no rows")
        kind, inner = object if t.dtype == "string" else t.dtype, self.get_shape(name)[1:] if t.rank > 1 and not t.jagged else ()
        table = self.read(name) if t.rank == 1 or t.jagged else self.rows(name)
        held: list[Any] = []

        def packed() -> tuple[np.ndarray, Any]:
            at = np.array([r["idx"] for r in held], np.int64)
            if t.jagged:
                return at, [np.array(r["v"], dtype=kind).reshape(r["shape"]) for r in held]
            return at, np.array([r[name if t.rank == 1 else "v"] for r in held], dtype=kind).reshape(len(held), *inner)

        for row in table.orderBy("idx").toLocalIterator():
            held.append(row)
            if len(held) == rows:
                yield packed()
                held = []
        if held:
            yield packed()

    def groupby(self, labels: Any = None, projection: Callable | None = None):  # noqa: ANN201
        from .groupby import GroupViewBy

        return GroupViewBy(self, labels, projection)

    def bundle(self, **how: Any):  # noqa: ANN201
        from .bundle import bundle

        return bundle(self, **how)

    # -- writing

    def write(self, name: str, values: Any) -> None:
        """Overwrite the selection: a constant, or values in ascending order of position, cast to the
        tensor's type. Blocks of files that hold none of the selection stay as they are."""
        from ..plans.overwrite import overwrite

        overwrite(self, self.ws._get_tensor(name), values)
