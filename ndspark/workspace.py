"""Workspaces, dimensions and tensors as users meet them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filters as fl
from .operators.view import View
from .plans import layout
from .schema import Dim, DimensionSpec, Segment, TensorSpec, check_name, declared
from .sources.catalog import Catalog, empty
from .types import dtype_of
from .values import TensorValue, frame


class Workspace:
    """Marker: `ws.sub = Workspace()` creates a nested workspace."""


class Dimension:
    """`ws.cells = Dimension(None)` declares a growing dimension, `Dimension(100)` a fixed one; `ws.cells` is live."""

    def __init__(self, shape: int | None = None, *, ws: WorkspaceManager | None = None, name: str | None = None, length: int = 0):
        self.shape, self.ws, self.name, self.length = shape, ws, name, length
        DimensionSpec(shape, length)

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, item: Any) -> fl.Filter:
        return fl.axis_filter(item, lambda s: fl.DimensionSliceFilter(self, s), lambda i: fl.DimensionIndicesFilter(self, i), lambda m: fl.DimensionBoolFilter(self, m))

    def groupby(self, labels: Any = None, projection: Callable | None = None):  # noqa: ANN201
        from .operators.groupby import GroupDimensionBy

        return GroupDimensionBy(self, labels, projection)

    def append(self, values: dict[str, Any] | DataFrame, order_by: list[str] | None = None) -> None:
        """Rows for tensors on this dimension: arrays by tensor name, or a DataFrame with a column per rank-1
        (or row-form) tensor, put in the order of order_by. All in one commit."""
        self.ws._append(self.name, values, order_by)

    def __repr__(self) -> str:
        return f"<Dimension {self.name} shape={self.shape} length={self.length}>"


class Tensor:
    """`ws.Age = Tensor("uint16", ("cells",), inits=...)` declares a tensor, and fills it if inits is given."""

    def __init__(self, dtype: str, dims: tuple[Dim, ...], *, chunks: tuple[int, ...] | None = None, jagged: bool = False, inits: Any = None):
        self.spec, self.inits = declared(dtype, tuple(dims), chunks, jagged), inits


class TensorRef:
    """A live tensor; comparing one gives a filter, indexing one a view."""

    __hash__ = None

    def __init__(self, ws: WorkspaceManager, name: str, spec: TensorSpec):
        self.ws, self.name, self.spec = ws, name, spec
        self.dtype, self.dims, self.shape, self.rank, self.jagged = spec.dtype, spec.dims, spec.shape, spec.rank, spec.jagged

    @property
    def axes(self) -> tuple[fl.Axis, ...]:
        return tuple(d if isinstance(d, str) else (self.name, k) for k, d in enumerate(self.dims))

    def __len__(self) -> int:
        return self.shape[0] if self.rank else 0

    def _compare(self, op: str, other: Any) -> fl.Filter:
        return fl.TensorFilter(op, self, other) if isinstance(other, TensorRef) else fl.ConstFilter(op, self, other)

    def __eq__(self, other: Any) -> fl.Filter:
        return self._compare("==", other)

    def __ne__(self, other: Any) -> fl.Filter:
        return self._compare("!=", other)

    def __gt__(self, other: Any) -> fl.Filter:
        return self._compare(">", other)

    def __ge__(self, other: Any) -> fl.Filter:
        return self._compare(">=", other)

    def __lt__(self, other: Any) -> fl.Filter:
        return self._compare("<", other)

    def __le__(self, other: Any) -> fl.Filter:
        return self._compare("<=", other)

    def view(self, item: Any) -> View:
        """The view that t[item] means: per axis a slice, positions, a mask or a filter; ... fills up."""
        items = item if isinstance(item, tuple) else (item,)
        if not self.rank and items == (slice(None),):  # all of a scalar
            items = ()
        if sum(x is Ellipsis for x in items) > 1 or len(items) - (Ellipsis in [x for x in items if x is Ellipsis]) > self.rank:
            raise IndexError(f"{self.name} has {self.rank} axes")
        at = next((k for k, x in enumerate(items) if x is Ellipsis), None)
        if at is not None:
            items = (*items[:at], *[slice(None)] * (self.rank - len(items) + 1), *items[at + 1 :])
        found = []
        for k, x in enumerate((*items, *[slice(None)] * (self.rank - len(items)))):
            if isinstance(x, View):
                x = x.single_filter()
            if isinstance(x, fl.Filter):
                if x.axis != self.axes[k]:
                    raise IndexError(f"axis {k} of {self.name} is {self.axes[k]!r}; the filter is on {x.axis!r}")
                found.append(x)
            elif not (isinstance(x, slice) and x == slice(None)):
                found.append(fl.axis_filter(x, lambda s, k=k: fl.TensorSliceFilter(self, k, s), lambda i, k=k: fl.TensorIndicesFilter(self, k, i), lambda m, k=k: fl.TensorBoolFilter(self, k, m)))
        return View(self.ws, found)

    def __getitem__(self, item: Any) -> DataFrame:
        return self.view(item).read(self.name)

    def __setitem__(self, item: Any, values: Any) -> None:
        self.view(item).write(self.name, values)

    def append(self, values: Any, axis: int = 0) -> None:
        d = self.dims[axis]
        self.ws._append_axis({self.name: TensorValue(values, self.jagged)}, d if isinstance(d, str) else (self.name, axis))

    def scalar(self) -> Any:
        return self.spec.value

    def sparse(self, rows: Any = None, cols: Any = None) -> DataFrame:
        from .operators.sparse import coo

        return coo(self, rows, cols)

    def quick_look(self, n: int = 5, width: int = 60) -> str:
        if self.rank == 0:
            return str(self.spec.value)[:width]
        if self.rank > 1 or not self.spec.segments:
            return " × ".join(map(str, self.shape))
        first = [r[0] for r in View(self.ws, [fl.TensorSliceFilter(self, 0, slice(n))]).read(self.name).orderBy("idx").select(self.name).collect()]
        return (", ".join(map(repr, first)) + (", ..." if self.shape[0] > n else ""))[:width]

    def __repr__(self) -> str:
        return f"<Tensor {self.name} {self.dtype}{self.dims} shape={self.shape}{' jagged' if self.jagged else ''}>"


class WorkspaceManager:
    """A live workspace: attributes and items are its tensors, dimensions and workspaces."""

    def __init__(self, catalog: Catalog, path: tuple[str, ...] = ()):
        self.__dict__.update(_catalog=catalog, _path=path)

    @property
    def _spark(self) -> SparkSession:
        return self._catalog.spark

    def _node(self) -> dict[str, Any]:
        return self._catalog.node(self._path)

    # -- look up

    def _get(self, name: str) -> Any:
        head, _, rest = name.partition(".")
        node = self._node()
        if head in node["tensors"]:
            found: Any = TensorRef(self, head, TensorSpec.from_json(node["tensors"][head]))
        elif head in node["dims"]:
            d = node["dims"][head]
            found = Dimension(d["shape"], ws=self, name=head, length=d["length"])
        elif head in node["workspaces"]:
            found = WorkspaceManager(self._catalog, (*self._path, head))
        else:
            raise AttributeError(f"{head!r} isn't in workspace {'.'.join(self._path) or '(root)'!r}")
        return found._get(rest) if rest and isinstance(found, WorkspaceManager) else found if not rest else self._missing(name)

    @staticmethod
    def _missing(name: str) -> Any:
        raise AttributeError(f"no {name!r}")

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._get(name)

    def _typed(self, name: str, kind: type) -> Any:
        found = self._get(name)
        if not isinstance(found, kind):
            raise AssertionError(f"{name!r} is no {kind.__name__}")
        return found

    def _get_workspace(self, name: str) -> WorkspaceManager:
        return self._typed(name, WorkspaceManager)

    def _get_dimension(self, name: str) -> Dimension:
        return self._typed(name, Dimension)

    def _get_tensor(self, name: str) -> TensorRef:
        return self._typed(name, TensorRef)

    def _workspaces(self) -> list[WorkspaceManager]:
        return [self._get(n) for n in sorted(self._node()["workspaces"])]

    def _dimensions(self) -> list[Dimension]:
        return [self._get(n) for n in sorted(self._node()["dims"])]

    def _tensors(self) -> list[TensorRef]:
        return [self._get(n) for n in sorted(self._node()["tensors"])]

    def __contains__(self, name: str) -> bool:
        try:
            return self._get(name) is not None
        except AttributeError:
            return False

    def __iter__(self) -> Iterator[str]:
        node = self._node()
        return iter([*sorted(node["workspaces"]), *sorted(node["dims"]), *sorted(node["tensors"])])

    def __dir__(self) -> list[str]:
        return [*super().__dir__(), *self]

    def __getitem__(self, item: Any) -> Any:
        """A name gives the entity; filters (or views with one), alone or as a tuple, and : give a view."""
        if isinstance(item, str):
            return self._get(item)
        items = item if isinstance(item, tuple) else (item,)
        found = []
        for x in items:
            if isinstance(x, slice) and x == slice(None) or x is Ellipsis:
                continue
            if isinstance(x, View):
                found += x.filters
            elif isinstance(x, fl.Filter):
                found.append(x)
            else:
                raise KeyError(f"{x!r} is no name or filter")
        return View(self, found)

    # -- declare and drop

    def __setattr__(self, name: str, value: Any) -> None:
        if isinstance(value, WorkspaceManager):
            raise ValueError("a live workspace can't be assigned; move it with _move_to")
        if isinstance(value, Workspace):
            self._create_workspace(name)
        elif isinstance(value, Dimension):
            self._create_dimension(name, value.shape)
        elif isinstance(value, Tensor):
            self._create_tensor(name, value)
        elif name in self._node()["tensors"]:
            View(self, []).write(name, value)
        else:
            raise TypeError(f"{value!r} can't be put into a workspace")

    __setitem__ = __setattr__

    def _free(self, name: str, own: str) -> None:
        node = self._node()
        for kind in ("tensors", "dims", "workspaces"):
            if name in node[kind] and kind != own:
                raise AttributeError(f"{name!r} is one of the {kind} already")

    def _create_workspace(self, name: str) -> None:
        check_name(name, "workspace")
        self._free(name, "")
        self._catalog.change(lambda tree: self._catalog.node(self._path, tree)["workspaces"].setdefault(name, empty()))

    def _create_dimension(self, name: str, shape: int | None) -> None:
        """Declare, fix or free a dimension; its length stays. Fixing needs all tensors on it to have that size."""
        check_name(name, "dimension")
        self._free(name, "dims")
        node = self._node()
        length = node["dims"].get(name, {}).get("length", 0)
        if shape is not None and length not in (0, shape):
            raise ValueError(f"{name} has length {length}; it can't be fixed at {shape}")
        spec = DimensionSpec(shape, length)
        self._catalog.change(lambda tree: self._catalog.node(self._path, tree)["dims"].update({name: asdict(spec)}))

    def _create_tensor(self, name: str, tensor: Tensor) -> None:
        check_name(name, "tensor")
        self._free(name, "tensors")
        for d in tensor.spec.dims:
            if isinstance(d, str) and d not in self._node()["dims"]:
                raise KeyError(f"dimension {d!r} isn't in the workspace")

        def put(tree: dict[str, Any]) -> None:
            node = self._catalog.node(self._path, tree)
            node["tensors"].pop(name, None)
            spec = tensor.spec
            if tensor.inits is not None:
                if isinstance(tensor.inits, DataFrame):
                    spec = self._from_rows(node, name, spec, tensor.inits)
                else:
                    spec = self._first(node, name, spec, tensor.inits if isinstance(tensor.inits, TensorValue) else TensorValue(tensor.inits, spec.jagged))
            node["tensors"][name] = spec.to_json()

        self._catalog.change(put)

    def _sized(self, node: dict[str, Any], name: str, spec: TensorSpec, shape: tuple[int, ...]) -> None:
        """Check a first shape against dims and set the lengths of dimensions that had none."""
        if len(shape) != spec.rank:
            raise ValueError(f"{name} has rank {spec.rank}; the values have {len(shape)}")
        for k, d in enumerate(spec.dims):
            if spec.jagged and k and not isinstance(d, (str, int)):
                continue
            if isinstance(d, int) and shape[k] != d:
                raise ValueError(f"axis {k} of {name} has {d} positions, not {shape[k]}")
            if isinstance(d, str):
                dim = node["dims"][d]
                if dim["shape"] is not None and shape[k] != dim["shape"] or dim["length"] not in (0, shape[k]):
                    raise ValueError(f"dimension {d} has {dim['length'] or dim['shape']} positions; axis {k} of {name} would have {shape[k]}")
                dim["length"] = shape[k]

    def _first(self, node: dict[str, Any], name: str, spec: TensorSpec, value: TensorValue) -> TensorSpec:
        if spec.rank == 0:
            if value.rank:
                raise ValueError(f"{name} is a scalar")
            return replace(spec, value=spec.kind.literal(value.array.item()))
        self._sized(node, name, spec, value.shape)
        path = self._catalog.write(frame(self._spark, spec, value, 0).withColumnRenamed("v", name))
        return spec.with_segment(Segment(path, name, (0,) * (spec.rank - 1), tuple(value.shape[1:])), value.shape)

    def _from_rows(self, node: dict[str, Any], name: str, spec: TensorSpec, rows: DataFrame) -> TensorSpec:
        """From (idx, v), or (idx, shape, v) if jagged, idx being 0 ... n-1; arrays of one length for rank 2."""
        if spec.rank == 0 or spec.rank > 2 and not spec.jagged:
            raise ValueError("rows of a DataFrame fill vectors, matrices and jagged tensors")
        whole = [F.count("*"), F.count_distinct("idx"), F.min("idx"), F.max("idx")]
        if spec.jagged:
            n, distinct, low, high, *inner = rows.agg(*whole, *[F.max(F.get("shape", F.lit(k))) for k in range(spec.rank - 1)]).first()
        elif spec.rank == 2:
            n, distinct, low, high, least, *inner = rows.agg(*whole, F.min(F.size("v")), F.max(F.size("v"))).first()
            if inner != [least]:
                raise ValueError("the arrays differ in length; a jagged tensor can hold them")
        else:
            (n, distinct, low, high), inner = rows.agg(*whole).first(), []
        if n != distinct or n and (low, high) != (0, n - 1):
            raise ValueError("idx must be 0 ... n-1")
        shape = (n, *(x or 0 for x in inner))
        self._sized(node, name, spec, shape)
        v = spec.kind.cast(F.col("v")) if spec.rank == 1 else F.transform("v", spec.kind.cast)
        path = self._catalog.write(rows.select(F.col("idx").cast("long").alias("idx"), *(["shape"] if spec.jagged else []), v.alias(name)))
        return spec.with_segment(Segment(path, name, (0,) * (spec.rank - 1), shape[1:]), shape)

    def __delattr__(self, name: str) -> None:
        """Drop an entity with all that is in it; unknown names are ignored, dimensions in use refused."""
        node = self._node()
        if name in node["dims"] and (used := [t for t, s in node["tensors"].items() if name in s["dims"]]):
            raise ValueError(f"dimension {name} is used by {', '.join(sorted(used))}")
        if any(name in node[k] for k in ("tensors", "dims", "workspaces")):
            self._catalog.change(lambda tree: [self._catalog.node(self._path, tree)[k].pop(name, None) for k in ("tensors", "dims", "workspaces")])

    __delitem__ = __delattr__

    def _move_to(self, target: str | tuple[str, ...]) -> WorkspaceManager:
        """Move this workspace, with its contents, to an absolute path that is free."""
        path = tuple(target.split(".")) if isinstance(target, str) else tuple(target)
        if not self._path or path[: len(self._path)] == self._path:
            raise ValueError("a workspace can't be moved into itself")

        def move(tree: dict[str, Any]) -> None:
            parent = self._catalog.node(path[:-1], tree)
            if any(path[-1] in parent[k] for k in ("tensors", "dims", "workspaces")):
                raise ValueError(f"{'.'.join(path)!r} exists")
            check_name(path[-1], "workspace")
            parent["workspaces"][path[-1]] = self._catalog.node(self._path[:-1], tree)["workspaces"].pop(self._path[-1])

        self._catalog.change(move)
        return WorkspaceManager(self._catalog, path)

    # -- append

    def _append(self, dim: str, values: dict[str, Any] | DataFrame, order_by: list[str] | None) -> None:
        if isinstance(values, DataFrame):
            self._append_rows(dim, values, order_by)
        else:
            self._append_axis({n: v if isinstance(v, TensorValue) else TensorValue(v, self._get_tensor(n).jagged) for n, v in values.items()}, dim)

    def _grow(self, node: dict[str, Any], dim: fl.Axis, names: dict[str, int], n: int) -> None:
        """Check that after n more positions all tensors on dim agree, and set the dimension's length."""
        if isinstance(dim, tuple):
            return
        spec = node["dims"][dim]
        if spec["shape"] is not None:
            raise AssertionError(f"dimension {dim} is fixed at {spec['shape']}")
        ends = {node["tensors"][t]["shape"][k] + n for t, k in names.items()}
        if len(ends) > 1:
            raise ValueError(f"tensors on {dim} would have different lengths: {sorted(ends)}")
        end = ends.pop() if ends else spec["length"] + n
        for t, s in node["tensors"].items():
            if t not in names and dim in s["dims"] and s["shape"][s["dims"].index(dim)] not in (0, end):
                raise ValueError(f"{t} on dimension {dim} would stay at {s['shape'][s['dims'].index(dim)]} of {end}")
        spec["length"] = end

    def _append_axis(self, values: dict[str, TensorValue], dim: fl.Axis) -> None:
        def put(tree: dict[str, Any]) -> None:
            node = self._catalog.node(self._path, tree)
            axes, sizes = {}, set()
            for name, value in values.items():
                if name not in node["tensors"]:
                    raise AttributeError(f"no tensor {name!r}")
                spec = TensorSpec.from_json(node["tensors"][name])
                if isinstance(dim, str) and dim not in spec.dims:
                    raise ValueError(f"{name} isn't on dimension {dim}")
                k = axes[name] = spec.dims.index(dim) if isinstance(dim, str) else dim[1]
                if isinstance(dim, tuple) and spec.dims[k] is not None:
                    raise AssertionError(f"axis {k} of {name} is fixed")
                if value.rank != spec.rank:
                    raise ValueError(f"{name} has rank {spec.rank}; the values have {value.rank}")
                for j, (d, size) in enumerate(zip(spec.dims, value.shape, strict=True)):
                    want = spec.shape[j] or (node["dims"][d]["length"] or node["dims"][d]["shape"] if isinstance(d, str) else d)
                    if j != k and not (spec.jagged and j and d is None) and want not in (None, 0) and size != want:
                        raise ValueError(f"axis {j} of {name} has {want} positions; the values have {size}")
                sizes.add(value.shape[k])
            if len(sizes) > 1:
                raise ValueError(f"the values have different lengths: {sorted(sizes)}")
            self._grow(node, dim, axes, sizes.pop() if sizes else 0)
            flat: dict[int, list[tuple[str, TensorSpec, DataFrame]]] = {}
            for name, value in values.items():
                spec, k = TensorSpec.from_json(node["tensors"][name]), axes[name]
                if k and spec.jagged:
                    raise NotImplementedError("jagged tensors grow along their first axis")
                rows = frame(self._spark, spec, value, spec.shape[0] if k == 0 else 0).withColumnRenamed("v", name)
                if spec.rank == 1:
                    flat.setdefault(spec.shape[0], []).append((name, spec, rows))
                    continue
                shape = tuple(s + value.shape[j] if j == k else max(s, value.shape[j]) for j, s in enumerate(spec.shape))
                offsets = tuple(spec.shape[j] if j == k else 0 for j in range(1, spec.rank))
                for j, d in enumerate(spec.dims):
                    if isinstance(d, str) and j != k and node["dims"][d]["length"] == 0:
                        node["dims"][d]["length"] = value.shape[j]
                node["tensors"][name] = spec.with_segment(Segment(self._catalog.write(rows), name, offsets, tuple(value.shape[1:])), shape).to_json()
            for group in flat.values():  # rank-1 tensors that end together share their files
                rows = group[0][2]
                for _, _, more in group[1:]:
                    rows = rows.join(more, "idx")
                path = self._catalog.write(rows)
                for name, spec, _ in group:
                    node["tensors"][name] = spec.with_segment(Segment(path, name), (spec.shape[0] + len(values[name]),)).to_json()

        self._catalog.change(put)

    def _append_rows(self, dim: str, rows: DataFrame, order_by: list[str] | None) -> None:
        """Distributed append: nothing but counts reaches the driver."""
        from .plans.staging import staged

        names = [c for c in rows.columns if c in self._node()["tensors"]]
        ready = staged(rows.orderBy(*order_by) if order_by else rows)
        n = ready.count()

        def put(tree: dict[str, Any]) -> None:
            node = self._catalog.node(self._path, tree)
            specs = {t: TensorSpec.from_json(node["tensors"][t]) for t in names}
            for t, s in specs.items():
                if s.rank not in (1, 2) or s.jagged or s.dims[0] != dim:
                    raise ValueError(f"{t} can't be appended from a DataFrame along {dim}")
            self._grow(node, dim, dict.fromkeys(names, 0), n)
            start = node["dims"][dim]["length"] - n
            cast = [(s.kind.cast(F.col(t)) if s.rank == 1 else F.transform(t, s.kind.cast)).alias(t) for t, s in specs.items()]
            path = self._catalog.write(layout.numbered(ready, start).select("idx", *cast))
            for t, s in specs.items():
                inner = s.shape[1:]
                if s.rank == 2 and n:
                    low, high = ready.agg(F.min(F.size(t)), F.max(F.size(t))).first()
                    if low != high or s.shape[0] and (low,) != inner:
                        raise ValueError(f"rows of {t} differ in length")
                    inner = (low,)
                node["tensors"][t] = s.with_segment(Segment(path, t, (0,) * len(inner), inner), (s.shape[0] + n, *inner)).to_json()

        self._catalog.change(put)

    # -- summaries and exchange

    def _summary(self) -> list[tuple[str, str, str, str]]:
        """(name, kind, size, first values) of all entities."""
        return [(w._path[-1], "workspace", "", "") for w in self._workspaces()] + [(d.name, "dimension", str(d.shape), str(d.length)) for d in self._dimensions()] + [(t.name, f"{t.dtype}{t.dims}", " × ".join(map(str, t.shape)), t.quick_look()) for t in self._tensors()]

    def __repr__(self) -> str:
        return "\n".join([f"<Workspace {'.'.join(self._path) or '(root)'}>", *("  " + "  ".join(row) for row in self._summary())])

    def _repr_html_(self) -> str:
        import html

        cells = "".join("<tr>" + "".join(f"<td>{html.escape(x)}</td>" for x in row) + "</tr>" for row in self._summary())
        return f"<h4>{html.escape('.'.join(self._path) or '(root)')}</h4><table>{cells}</table>"

    def _export(self, path: str, recursive: bool = True) -> None:
        from .sources.snapshot import export

        export(self, path, recursive)

    def _import(self, path: str) -> None:
        from .sources.snapshot import restore

        restore(self, path)


def connect(root: str, spark: SparkSession | None = None) -> WorkspaceManager:
    """The root workspace of a folder in any store that Spark reaches."""
    return WorkspaceManager(Catalog(spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), root))


def create_workspace(root: WorkspaceManager, path: str) -> WorkspaceManager:
    """The workspace of a dotted path, with all above it; IOError if a part is something else."""
    at = root
    for name in path.split("."):
        node = at._node()
        if name in node["tensors"] or name in node["dims"]:
            raise OSError(f"{name!r} is no workspace")
        if name not in node["workspaces"]:
            at._create_workspace(name)
        at = at._get(name)
    return at


def wrap(df: DataFrame, dim: str, key: str, names: dict[str, str] | None = None, fixed: dict[str, tuple[str | None, int]] | None = None, length: int | None = None, into: WorkspaceManager | None = None) -> WorkspaceManager:
    """A DataFrame as the dimension `dim` of a workspace, its columns as tensors, nothing copied.

    key holds positions 0 ... n-1. names gives tensor names for columns (default: CamelCase of all columns
    that tensors can hold). fixed gives, for array columns, the second dimension and its size. length
    saves the count of rows if it is known."""
    from .functions.scalars import camel_snake_pairs

    ws = into or WorkspaceManager(Catalog(df.sparkSession))
    fixed = fixed or {}
    held = [f.name for f in df.schema if dtype_of(f.dataType) or f.name in fixed]
    names = {v: k for k, v in names.items()} if names else camel_snake_pairs(held)
    n = df.count() if length is None else length
    path = f"@{dim}{len(ws._catalog.frames)}"
    ws._catalog.frames[path] = df.select(F.col(key).cast("long").alias("idx"), *[F.col(c).alias(t) for c, t in names.items()])

    def put(tree: dict[str, Any]) -> None:
        node = ws._catalog.node(ws._path, tree)
        node["dims"][check_name(dim, "dimension")] = asdict(DimensionSpec(None, n))
        for column, t in names.items():
            kind = df.schema[column].dataType
            if column in fixed:
                second, size = fixed[column]
                if second:
                    node["dims"][second] = asdict(DimensionSpec(size, size))
                spec = TensorSpec(dtype_of(kind.elementType), (dim, second or size), (n, size), segments=(Segment(path, t, (0,), (size,)),))
            else:
                if dtype_of(kind) is None:
                    raise TypeError(f"tensors can't hold {column}: {kind.simpleString()}")
                spec = TensorSpec(dtype_of(kind), (dim,), (n,), segments=(Segment(path, t),))
            node["tensors"][check_name(t, "tensor")] = spec.to_json()

    ws._catalog.change(put)
    return ws

