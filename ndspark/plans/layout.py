"""Physical layout: row form, long form, and back.

Rank 1: (idx, value), tensors written together share files. Rank >= 2: (idx, array of the row's
values, last axis fastest) per block of trailing axes. Jagged: (idx, shape, array).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Segment, TensorSpec
from ..sources.catalog import Catalog


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def columns(catalog: Catalog, tensors: dict[str, TensorSpec]) -> DataFrame:
    """idx and rank-1 tensors as columns: one scan for those that share files, joins on idx for the rest."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, spec in tensors.items():
        groups.setdefault(tuple(s.path for s in spec.segments), []).append(name)
    frames = []
    for paths, names in groups.items():
        if not paths:
            fields = ", ".join(f"`{n}` {tensors[n].kind.spark.simpleString()}" for n in names)
            frames.append(catalog.spark.createDataFrame([], f"idx long, {fields}"))
        else:
            frames.append(union([catalog.frame(p).select("idx", *[F.col(tensors[n].segments[k].column).alias(n) for n in names]) for k, p in enumerate(paths)]))
    return reduce(lambda a, b: a.join(b, "idx"), frames)


def coordinates(segment: Segment, at: Column) -> list[Column]:
    """Positions on the trailing axes of the at-th value of a row."""
    out, stride = [], 1
    for size, offset in zip(reversed(segment.sizes), reversed(segment.offsets), strict=True):
        out.insert(0, (F.floor(at / stride) % max(1, size) + offset).cast("long"))
        stride *= max(1, size)
    return out


def row_form(catalog: Catalog, spec: TensorSpec) -> DataFrame | None:
    """(idx, v): whole rows as arrays, if no block ends inside a row."""
    whole = all(s.sizes == spec.shape[1:] for s in spec.segments)
    return union([catalog.frame(s.path).select("idx", F.col(s.column).alias("v")) for s in spec.segments]) if whole and spec.segments else None


def long_form(catalog: Catalog, spec: TensorSpec, rows: dict[str, DataFrame] | None = None, more: list[str] | None = None) -> DataFrame:
    """(i0, i1, ..., v) and more columns of rows: a row per value. rows replaces the frames of segments, by path."""
    more = more or []
    names = [f"i{k}" for k in range(spec.rank)]
    frames = []
    for s in spec.segments:
        flat = (rows or {}).get(s.path, None)
        flat = (catalog.frame(s.path) if flat is None else flat).select("idx", *more, F.posexplode(s.column).alias("pos", "v"))
        frames.append(flat.select(F.col("idx").alias("i0"), *[c.alias(n) for c, n in zip(coordinates(s, F.col("pos")), names[1:], strict=True)], "v", *more))
    if not frames:
        return catalog.spark.createDataFrame([], ", ".join(f"{n} long" for n in names) + f", v {spec.kind.spark.simpleString()}").select("*", *[F.lit(None).alias(m) for m in more])
    return union(frames)


def rows_of(long: DataFrame, rank: int) -> DataFrame:
    """(idx, v) from the long form: values in the order of their trailing positions."""
    trailing = [f"i{k}" for k in range(1, rank)]
    ordered = F.array_sort(F.collect_list(F.struct(*trailing, "v")))
    return long.groupBy(F.col("i0").alias("idx")).agg(F.transform(ordered, lambda x: x["v"]).alias("v"))


def numbered(rows: DataFrame, base: int) -> DataFrame:
    """rows with idx = base, base + 1, ... in the order of partitions and rows within.

    No shuffle: the start of each partition comes from one count per partition."""
    placed = rows.withColumn("__row", F.monotonically_increasing_id())
    pid, inside = F.shiftright("__row", 33), F.col("__row").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.p, r.n) for r in placed.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, at = [], base
    for p, n in counts:
        starts.append((p, at))
        at += n
    table = rows.sparkSession.createDataFrame(starts, "__p long, __start long")  # a row per partition
    joined = placed.withColumn("__p", pid).join(F.broadcast(table), "__p")
    return joined.select((F.col("__start") + inside).alias("idx"), *rows.columns)
