"""Importers of annotated matrices and spatial bundles, from what Spark reads or frames in memory.

File formats that need libraries beyond Spark (HDF5) are read by the caller; the importers take frames.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import camel_case, padded, points, tensor_name
from ..plans import layout
from ..plans.staging import staged
from ..types import dtype_of

if TYPE_CHECKING:
    from ..workspace import WorkspaceManager

VERTICES = 13  # a polygon's, fixed by the spatial format


def put(ws: WorkspaceManager, name: str, rows: DataFrame, dims: tuple, dtype: str | None = None) -> None:
    """A tensor from (idx, v)."""
    from ..workspace import Tensor

    kind = rows.schema["v"].dataType
    setattr(ws, name, Tensor(dtype or dtype_of(getattr(kind, "elementType", kind)), dims, inits=rows))


def attributes(ws: WorkspaceManager, rows: DataFrame, dim: str, taken: set[str] | None = None) -> dict[str, str]:
    """Each column of rows (idx, ...) that a tensor can hold becomes one on dim; returns names by column."""
    taken, out = set(taken or ()), {}
    for f in rows.schema:
        if f.name != "idx" and dtype_of(f.dataType):
            out[f.name] = tensor_name(camel_case(f.name), taken)
            taken.add(out[f.name])
            put(ws, out[f.name], rows.select("idx", F.col(f"`{f.name}`").alias("v")), (dim,))
    return out


def scalars(ws: WorkspaceManager, values: dict[str, Any]) -> None:
    from ..workspace import Tensor

    for name, v in values.items():
        kind = "bool" if isinstance(v, bool) else "int64" if isinstance(v, int) else "float64" if isinstance(v, float) else "string"
        setattr(ws, tensor_name(camel_case(name), set(ws._node()["tensors"])), Tensor(kind, (), inits=v if kind != "string" else str(v)))


def dense(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(idx, v) of full rows from coordinates (row, col, v)."""
    spark = cells.sparkSession
    every = spark.range(n_rows).withColumnRenamed("id", "row")
    maps = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("long"), F.col("v")))).alias("m"))
    kind = cells.schema["v"].dataType
    zero = F.lit(0).cast(kind)
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_cols - 1).cast("long")), lambda c: F.coalesce(F.try_element_at("m", c), zero))
    return every.join(maps, "row", "left").select(F.col("row").alias("idx"), F.when(F.col("m").isNull(), F.array_repeat(zero, n_cols)).otherwise(full).alias("v"))


def import_matrix(ws: WorkspaceManager, x: DataFrame, obs: DataFrame, var: DataFrame, *, layers: dict[str, DataFrame] | None = None, obsm: dict[str, DataFrame] | None = None, varm: dict[str, DataFrame] | None = None, obsp: dict[str, DataFrame] | None = None, uns: dict[str, Any] | None = None, name: str = "Expression", rows: str = "cells", cols: str = "genes") -> None:
    """An annotated matrix: x and layers as (row, col, v), obs and var with idx, obsm and varm as (idx, v)
    arrays, obsp as (row, col, v), uns as scalars. One commit."""
    from ..transaction import Transaction
    from ..workspace import Dimension

    n, m = obs.count(), var.count()
    with Transaction(ws):
        setattr(ws, rows, Dimension(n))
        setattr(ws, cols, Dimension(m))
        taken = set(attributes(ws, obs, rows).values())
        attributes(ws, var, cols, taken)
        for layer, cells in {name: x, **(layers or {})}.items():
            put(ws, tensor_name(camel_case(layer)), dense(cells, n, m), (rows, cols))
        for dim, group in ((rows, obsm), (cols, varm)):
            for key, frame in (group or {}).items():
                put(ws, tensor_name(camel_case(key), set(ws._node()["tensors"])), frame, (dim, None))
        for key, cells in (obsp or {}).items():
            put(ws, tensor_name(camel_case(key), set(ws._node()["tensors"])), dense(cells, n, n), (rows, rows))
        scalars(ws, uns or {})


def import_adata(ws: WorkspaceManager, adata: Any, layers: bool = True, obsm: bool = True, uns: bool = True, **names: str) -> None:
    """An annotated matrix in memory: X and layers dense or with tocoo(), obs and var as pandas frames, obsm and
    obsp by key, uns scalars. Its index becomes the tensor ObsNames or VarNames."""
    import numpy as np

    spark = ws._spark

    def cells(x: Any) -> DataFrame:
        if hasattr(x, "tocoo"):
            c = x.tocoo()
            rows, cols, v = c.row, c.col, c.data
        else:
            x = np.asarray(x)
            rows, cols = np.nonzero(x)
            v = x[rows, cols]
        kind = "long" if np.issubdtype(np.asarray(v).dtype, np.integer) else "double"
        return spark.createDataFrame([*zip(map(int, rows), map(int, cols), np.asarray(v).tolist(), strict=True)], f"row long, col long, v {kind}")

    def side(table: Any, index: str) -> DataFrame:
        flat = table.rename_axis(index).reset_index()
        flat = flat.astype({c: str for c in flat.columns if str(flat[c].dtype) in ("category", "object")})
        return spark.createDataFrame(flat.assign(idx=range(len(flat))))

    arrays = {k: spark.createDataFrame([(n, [float(x) for x in row]) for n, row in enumerate(np.asarray(v))], "idx long, v array<double>") for k, v in (dict(adata.obsm) if obsm else {}).items()}
    plain = {k: v for k, v in (dict(adata.uns) if uns else {}).items() if isinstance(v, (str, int, float, bool))}
    import_matrix(ws, cells(adata.X), side(adata.obs, "obs_names"), side(adata.var, "var_names"), layers={k: cells(v) for k, v in (dict(adata.layers) if layers else {}).items()}, obsm=arrays, obsp={k: cells(v) for k, v in dict(getattr(adata, "obsp", {})).items()}, uns=plain, **names)


def import_layers(ws: WorkspaceManager, layers: dict[str, DataFrame], obs: DataFrame, var: DataFrame, attrs: dict[str, Any] | None = None, clusters: DataFrame | None = None, means: DataFrame | None = None) -> None:
    """A gene-by-cell file: layers (row = gene, col = cell, v) are transposed; without a main layer the
    expression is the sum of the spliced, unspliced and ambiguous ones. clusters (idx, ...) and
    means (row = gene, col = cluster, v) come from an aggregate file."""
    from ..transaction import Transaction
    from ..workspace import Dimension

    turned = {k: d.select(F.col("col").alias("row"), F.col("row").alias("col"), "v") for k, d in layers.items()}
    main = turned.pop("", None)
    if main is None:
        parts = [turned[k] for k in ("spliced", "unspliced", "ambiguous") if k in turned]
        if not parts:
            raise ValueError("no layer to take the expression from")
        main = layout.union(parts).groupBy("row", "col").agg(F.pmod(F.sum("v"), F.lit(65536)).cast("int").alias("v"))
    with Transaction(ws):
        import_matrix(ws, main, obs, var, layers=turned, uns=attrs)
        if clusters is not None:
            ws.clusters = Dimension(clusters.count())
            attributes(ws, clusters, "clusters", set(ws._node()["tensors"]))
            if means is not None:
                put(ws, "MeanExpression", dense(means.select(F.col("col").alias("row"), F.col("row").alias("col"), "v"), clusters.count(), var.count()), ("clusters", "genes"))


def polygons(vertices: DataFrame, key: str, x: str, y: str, size: int = VERTICES) -> DataFrame:
    """(key, v): up to `size` vertices of each polygon as x, y, x, y ..., zeros beyond. The order is that of the file."""
    placed = vertices.withColumn("__at", F.monotonically_increasing_id())
    ordered = F.array_sort(F.collect_list(F.struct("__at", points(F.col(x).cast("float"), F.col(y).cast("float")).alias("p"))))
    return placed.groupBy(key).agg(padded(F.flatten(F.transform(ordered, lambda v: v["p"])), 2 * size, 0.0).alias("v"))


def import_spatial(ws: WorkspaceManager, path: str, matrix: DataFrame | None = None, genes: DataFrame | None = None, spark: SparkSession | None = None) -> None:
    """A folder of spatial data: experiment.xenium (JSON scalars), cells.parquet, cell_boundaries.parquet and
    nucleus_boundaries.parquet, transcripts.parquet, analysis CSVs with a Barcode column; matrix as (row = cell,
    col = gene, v) and genes as (idx, ...) from the caller, as they are HDF5 in the folder."""
    from ..transaction import Transaction
    from ..workspace import Dimension
    from .catalog import Files

    spark = spark or ws._spark
    files = Files(spark, path)
    names = set(files.names(""))
    with Transaction(ws):
        if "experiment.xenium" in names:
            info = spark.read.option("multiLine", True).json(f"{path}/experiment.xenium").first().asDict()
            scalars(ws, {k: v for k, v in info.items() if isinstance(v, (str, int, float, bool))})
        cells = spark.read.parquet(f"{path}/cells.parquet")
        cells = cells.withColumn("cell_id", F.decode("cell_id", "UTF-8") if cells.schema["cell_id"].dataType.simpleString() == "binary" else F.col("cell_id"))
        cells = staged(layout.numbered(staged(cells), 0))
        ws.cells = Dimension(cells.count())
        attributes(ws, cells, "cells", set(ws._node()["tensors"]))
        key = cells.select("idx", "cell_id")
        zeros = F.array_repeat(F.lit(0.0).cast("float"), 2 * VERTICES)
        for name, tensor in (("cell_boundaries.parquet", "CellBoundaries"), ("nucleus_boundaries.parquet", "NucleusBoundaries")):
            if name in names:
                found = spark.read.parquet(f"{path}/{name}")
                at = polygons(found, "cell_id", *[c for c in found.columns if c != "cell_id"][:2])
                put(ws, tensor, key.join(at, "cell_id", "left").select("idx", F.transform(F.coalesce("v", zeros), lambda v: v.cast("float")).alias("v")), ("cells", 2 * VERTICES))
        if "transcripts.parquet" in names:
            rows = staged(layout.numbered(staged(spark.read.parquet(f"{path}/transcripts.parquet")), 0))
            ws.transcripts = Dimension(rows.count())
            attributes(ws, rows, "transcripts", set(ws._node()["tensors"]))
        for name in sorted(n for n in names if n.endswith(".csv")):
            table = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{name}")
            if "Barcode" in table.columns:  # one join by barcode, whatever the columns
                mine = key.join(table.withColumnRenamed("Barcode", "cell_id"), "cell_id", "left").drop("cell_id")
                rest = [c for c in mine.columns if c != "idx"]
                filled = mine.select("idx", *[F.coalesce(c, F.lit(0).cast(mine.schema[c].dataType)).alias(c) for c in rest])
                if len(rest) == 2 and all(mine.schema[c].dataType.simpleString() == "double" for c in rest):
                    put(ws, tensor_name(camel_case(name[:-4]), set(ws._node()["tensors"])), filled.select("idx", F.array(*rest).alias("v")), ("cells", 2))
                else:
                    attributes(ws, filled, "cells", set(ws._node()["tensors"]))
        if matrix is not None and genes is not None:
            ws.genes = Dimension(genes.count())
            attributes(ws, genes, "genes", set(ws._node()["tensors"]))
            put(ws, "Expression", dense(matrix, cells.count(), genes.count()), ("cells", "genes"))
