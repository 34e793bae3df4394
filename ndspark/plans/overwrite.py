"""Writes through views: copy-on-write of the blocks that hold selected positions."""

from __future__ import annotations

import math
from dataclasses import replace
from typing import TYPE_CHECKING, Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Segment, TensorSpec
from ..values import TensorValue, frame
from . import layout, select
from .staging import staged

if TYPE_CHECKING:
    from ..operators.view import View
    from ..workspace import TensorRef


def overwrite(view: View, t: TensorRef, values: Any) -> None:
    ws = view.ws
    if isinstance(values, DataFrame):
        new = values
    elif t.rank == 0:
        spec = replace(t.spec, value=t.spec.kind.literal(np.asarray(values).item()))
        return _put(ws, t.name, spec)
    else:
        constant = not t.jagged and np.ndim(values) == 0
        shape = view.get_shape(t.name)
        if constant:
            new = _constant(view, t, values)
        elif t.jagged:
            return _jagged(view, t, TensorValue(values, True))
        else:
            value = values if isinstance(values, TensorValue) else TensorValue(values)
            if value.shape != shape:
                raise ValueError(f"the selection of {t.name} has shape {shape}, the values {value.shape}")
            new = _ranked(view, t, value)
    keys = ["idx"] if t.rank == 1 else [f"i{k}" for k in range(t.rank)]
    new = new.select(*keys, F.col("v").alias("__new"))
    segments = []
    for s in t.spec.segments:
        part = replace(t.spec, segments=(s,))
        touched = new.where(_inside(ws, s, keys))
        own = ws._catalog.frame(s.path).agg(F.min("idx"), F.max("idx")).first()
        touched = touched.where(F.col(keys[0]).between(own[0], own[1])) if own[0] is not None else touched.limit(0)
        if touched.isEmpty():
            segments.append(s)
            continue
        old = layout.columns(ws._catalog, {"v": part}) if t.rank == 1 else layout.long_form(ws._catalog, part)
        merged = old.join(touched, keys, "left").withColumn("v", F.coalesce(t.spec.kind.cast(F.col("__new")), F.col("v"))).drop("__new")
        rows = merged if t.rank == 1 else layout.rows_of(merged, t.rank)
        segments.append(Segment(ws._catalog.write(rows.withColumnRenamed("v", t.name)), t.name, s.offsets, s.sizes))
    _put(ws, t.name, replace(t.spec, segments=tuple(segments)))


def _inside(ws, s: Segment, keys: list[str]):  # noqa: ANN001, ANN202
    out = F.lit(True)
    for k, offset, size in zip(keys[1:], s.offsets, s.sizes, strict=False):
        out = out & F.col(k).between(offset, offset + size - 1)
    return out


def _put(ws, name: str, spec: TensorSpec) -> None:  # noqa: ANN001
    ws._catalog.change(lambda tree: ws._catalog.node(ws._path, tree)["tensors"].update({name: spec.to_json()}))


def _constant(view: View, t: TensorRef, value: Any) -> DataFrame:
    rows = view.columns(t.name).select("idx") if t.rank == 1 else view.long(t.name).drop("v")
    return rows.distinct().withColumn("v", F.lit(t.spec.kind.literal(value)))


def _ranked(view: View, t: TensorRef, value: TensorValue) -> DataFrame:
    """Values by position: the n-th selected position of each axis gets the n-th slice. Of positions given
    twice the last holds."""
    flat = replace(t.spec, dims=(None,))
    stacked = frame(view.ws._spark, flat, TensorValue(value.array.reshape(-1)), 0).withColumnRenamed("idx", "__at")
    keys = ["idx"] if t.rank == 1 else [f"i{k}" for k in range(t.rank)]
    at, inner = F.col("__at"), math.prod(value.shape)
    for k, key in enumerate(keys):
        inner //= max(1, value.shape[k])
        stacked = stacked.withColumn(f"__r{k}", (F.floor(at / max(1, inner)) % max(1, value.shape[k])).cast("long"))
    for k, (key, axis) in enumerate(zip(keys, t.axes, strict=True)):
        f = view.axes.get(axis)
        if f is None:
            stacked = stacked.withColumn(key, F.col(f"__r{k}"))
            continue
        known = f.positions()
        if known is not None:
            table = view.ws._spark.createDataFrame([(n, int(p)) for n, p in enumerate(known)], f"__r{k} long, {key} long")
        else:
            order = staged(select.selected(view.ws, axis, f).orderBy("idx")).withColumnRenamed("idx", "__to")
            table = layout.numbered(order, 0).select(F.col("idx").alias(f"__r{k}"), F.col("__to").alias(key))
        stacked = stacked.join(table, f"__r{k}")
    return stacked.groupBy(*keys).agg(F.max_by("v", "__at").alias("v"))


def _jagged(view: View, t: TensorRef, value: TensorValue) -> None:
    """Rows of the selection, in order, replaced by whole rows."""
    ws = view.ws
    if any(view.filter_of(t, k) is not None for k in range(1, t.rank)):
        raise NotImplementedError("jagged tensors are overwritten by whole rows")
    f = view.filter_of(t, 0)
    known = np.arange(t.shape[0]) if f is None else f.positions()
    if known is None:
        known = np.array([r.idx for r in select.selected(ws, t.axes[0], f).orderBy("idx").collect()])
    if len(known) != len(value):
        raise ValueError(f"the selection of {t.name} has {len(known)} rows, the values {len(value)}")
    new = frame(ws._spark, t.spec, value, 0).withColumnsRenamed({"idx": "__at", "shape": "__shape", "v": "__new"})
    new = new.join(ws._spark.createDataFrame([(n, int(p)) for n, p in enumerate(known)], "__at long, idx long"), "__at")
    old = layout.union([ws._catalog.frame(s.path).select("idx", "shape", F.col(s.column).alias("v")) for s in t.spec.segments])
    merged = old.join(new, "idx", "left").select("idx", F.coalesce("__shape", "shape").alias("shape"), F.coalesce("__new", "v").alias(t.name))
    path = ws._catalog.write(merged)
    shape = (t.shape[0], *(max(a, b) for a, b in zip(t.shape[1:], value.shape[1:], strict=True)))
    _put(ws, t.name, replace(t.spec, segments=(Segment(path, t.name, (0,) * (t.rank - 1), shape[1:]),), shape=shape))
