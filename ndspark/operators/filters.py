"""Filters: sets of positions along one dimension, as boolean expressions over its rows.

A filter compiles to a predicate on `idx` and the columns of rank-1 tensors of its dimension, so that
Catalyst sees plain comparisons (and pushes them to the scan). Only long index arrays become
joins. A lone index array keeps its duplicates; within a compound it is a set.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING, Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..workspace import Dimension, TensorRef

OPERATORS: dict[str, Callable[[Any, Any], Any]] = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
#: Index arrays up to this length become IN lists, longer ones joins.
IN_LIST = 1000

Axis = str | tuple[str, int]  # a named dimension, or (tensor, axis) for an anonymous one


class Filter:
    """axis: what it selects on; n: the length of that axis; tensors: names that its predicate reads."""

    axis: Axis
    n: int
    tensors: frozenset[str] = frozenset()

    def predicate(self, idx: Column, column: Callable[[str], Column], strict: bool = False) -> Column:
        """strict: never null. A plain comparison, which scans can use, is enough where null and false are
        alike: at the top and below & and |, but not below ~, ^ or -."""
        raise NotImplementedError

    def positions(self) -> np.ndarray | None:
        """The positions in ascending order, duplicates kept, where they are known without data."""
        return None

    def tables(self) -> dict[str, np.ndarray | DataFrame]:
        """Positions that aren't a predicate, by the name of the flag column that stands for them."""
        return {}

    def _with(self, other: Any, op: str) -> CompoundFilter:
        from .view import View

        if isinstance(other, View):
            other = other.single_filter()
        if not isinstance(other, Filter):
            return NotImplemented
        return CompoundFilter(op, self, other)

    def __and__(self, other: Any) -> CompoundFilter:
        return self._with(other, "&")

    def __or__(self, other: Any) -> CompoundFilter:
        return self._with(other, "|")

    def __xor__(self, other: Any) -> CompoundFilter:
        return self._with(other, "^")

    def __sub__(self, other: Any) -> CompoundFilter:
        return self._with(other, "-")

    def __invert__(self) -> CompoundFilter:
        return CompoundFilter("~", self)


def sound(column: Column) -> Column:
    """Two-valued logic: null compares false, so that ~ is the complement."""
    return F.coalesce(column, F.lit(False))


class ConstFilter(Filter):
    """A rank-1 tensor against a constant, which is cast to the tensor's type first."""

    def __init__(self, op: str, tensor: TensorRef, value: Any):
        if tensor.rank != 1:
            raise ValueError("only rank-1 tensors can be compared")
        self.op, self.tensor, self.value = op, tensor, tensor.spec.kind.literal(value)
        self.axis, self.n, self.tensors = tensor.axes[0], tensor.shape[0], frozenset([tensor.name])

    def predicate(self, idx: Column, column: Callable[[str], Column], strict: bool = False) -> Column:
        out = OPERATORS[self.op](column(self.tensor.name), self.tensor.spec.kind.lit(self.value))
        return sound(out) if strict else out


class TensorFilter(Filter):
    """Two rank-1 tensors on one dimension, compared row by row."""

    def __init__(self, op: str, left: TensorRef, right: TensorRef):
        if left.rank != 1 or right.rank != 1 or left.axes != right.axes or left.shape != right.shape:
            raise SyntaxError("both tensors need rank 1, the same dimension and the same length")
        self.op, self.left, self.right = op, left, right
        self.axis, self.n, self.tensors = left.axes[0], left.shape[0], frozenset([left.name, right.name])

    def predicate(self, idx: Column, column: Callable[[str], Column], strict: bool = False) -> Column:
        out = OPERATORS[self.op](column(self.left.name), column(self.right.name))
        return sound(out) if strict else out


class SliceFilter(Filter):
    def __init__(self, axis: Axis, n: int, which: slice):
        self.axis, self.n, self.range = axis, n, range(*which.indices(n))

    def predicate(self, idx: Column, column: Callable[[str], Column], strict: bool = False) -> Column:
        r = self.range if self.range.step > 0 else self.range[::-1]
        if not len(r):
            return F.lit(False)
        inside = (idx >= r.start) & (idx <= r[-1])
        return inside if r.step == 1 else inside & ((idx - r.start) % r.step == 0)

    def positions(self) -> np.ndarray:
        return np.sort(np.array(self.range, np.int64))


class IndicesFilter(Filter):
    """Positions; negative ones count from the end, those outside raise IndexError."""

    def __init__(self, axis: Axis, n: int, indices: Sequence[int] | np.ndarray | int):
        at = np.atleast_1d(np.asarray(indices))
        if at.size and not np.issubdtype(at.dtype, np.integer):
            raise TypeError("positions are whole numbers")
        at = at.astype(np.int64).ravel()
        if ((at >= n) | (at < -n)).any():
            raise IndexError(f"position outside an axis of length {n}")
        self.axis, self.n, self.at = axis, n, np.sort(np.where(at < 0, at + n, at))
        self.flag = f"__in_{id(self):x}"

    def predicate(self, idx: Column, column: Callable[[str], Column], strict: bool = False) -> Column:
        if len(self.at) > IN_LIST:
            return sound(column(self.flag))
        return idx.isin(np.unique(self.at).tolist()) if len(self.at) else F.lit(False)

    def positions(self) -> np.ndarray:
        return self.at

    def tables(self) -> dict[str, np.ndarray | DataFrame]:
        return {self.flag: np.unique(self.at)} if len(self.at) > IN_LIST else {}


class BoolFilter(IndicesFilter):
    """A mask as long as the axis."""

    def __init__(self, axis: Axis, n: int, mask: Sequence[bool] | np.ndarray):
        mask = np.asarray(mask)
        if mask.dtype != bool or mask.shape != (n,):
            raise IndexError(f"a mask for this axis has {n} booleans")
        super().__init__(axis, n, np.flatnonzero(mask))


class RowsFilter(Filter):
    """Positions from a DataFrame, in its first column, however many; a set. They never reach the client."""

    def __init__(self, axis: Axis, n: int, rows: DataFrame):
        self.axis, self.n, self.rows = axis, n, rows.select(F.col(rows.columns[0]).cast("long"))
        self.flag = f"__in_{id(self):x}"

    def predicate(self, idx: Column, column: Callable[[str], Column], strict: bool = False) -> Column:
        return sound(column(self.flag))

    def tables(self) -> dict[str, np.ndarray | DataFrame]:
        return {self.flag: self.rows}


class DimensionSliceFilter(SliceFilter):
    def __init__(self, dim: Dimension, which: slice):
        super().__init__(dim.name, dim.length, which)


class DimensionIndicesFilter(IndicesFilter):
    def __init__(self, dim: Dimension, indices: Any):
        super().__init__(dim.name, dim.length, indices)


class DimensionBoolFilter(BoolFilter):
    def __init__(self, dim: Dimension, mask: Any):
        super().__init__(dim.name, dim.length, mask)


class TensorSliceFilter(SliceFilter):
    def __init__(self, tensor: TensorRef, axis: int, which: slice):
        super().__init__(tensor.axes[axis], tensor.shape[axis], which)


class TensorIndicesFilter(IndicesFilter):
    def __init__(self, tensor: TensorRef, axis: int, indices: Any):
        super().__init__(tensor.axes[axis], tensor.shape[axis], indices)


class TensorBoolFilter(BoolFilter):
    def __init__(self, tensor: TensorRef, axis: int, mask: Any):
        super().__init__(tensor.axes[axis], tensor.shape[axis], mask)


class CompoundFilter(Filter):
    """Set algebra of filters on one dimension: & | ^ - and ~."""

    def __init__(self, op: str, left: Filter, right: Filter | None = None):
        if right is not None and left.axis != right.axis:
            raise SyntaxError(f"filters on {left.axis!r} and {right.axis!r} can't be combined")
        self.op, self.left, self.right = op, left, right
        self.axis, self.n = left.axis, left.n
        self.tensors = left.tensors | (right.tensors if right else frozenset())

    def predicate(self, idx: Column, column: Callable[[str], Column], strict: bool = False) -> Column:
        p = self.left.predicate(idx, column, strict or self.op in "~^")
        if self.right is None:
            return ~p
        q = self.right.predicate(idx, column, strict or self.op in "^-")
        return {"&": lambda: p & q, "|": lambda: p | q, "^": lambda: p != q, "-": lambda: p & ~q}[self.op]()

    def tables(self) -> dict[str, np.ndarray | DataFrame]:
        return self.left.tables() | (self.right.tables() if self.right else {})


def axis_filter(item: Any, sliced: Callable[[slice], Filter], indexed: Callable[[Any], Filter], masked: Callable[[Any], Filter]) -> Filter:
    """The filter that an index expression on one axis means: a slice, a mask, or positions."""
    if isinstance(item, slice):
        return sliced(item)
    if isinstance(item, DataFrame):
        whole = sliced(slice(None))
        return RowsFilter(whole.axis, whole.n, item)
    if isinstance(item, (int, np.integer)) and not isinstance(item, (bool, np.bool_)):
        return indexed(item)
    if isinstance(item, (list, tuple, range, np.ndarray)):
        at = np.asarray(item)
        return masked(at) if at.dtype == bool else indexed(at if at.size else at.astype(np.int64))
    raise KeyError(f"{item!r} selects nothing on an axis")
