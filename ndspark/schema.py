"""Dimensions and tensors as declared, and the rules for their names and shapes."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from typing import Any

from .types import DType, dtype

Dim = str | int | None


def check_name(name: str, kind: str) -> str:
    """Dimensions and workspaces begin in lower case, tensors in upper case; no name holds a dot."""
    if not name or "." in name or not name.replace("_", "a").isalnum():
        raise AttributeError(f"{name!r} can't name a {kind}")
    if kind == "tensor" and not name[0].isupper():
        raise AttributeError(f"tensor {name!r} must begin in upper case")
    if kind != "tensor" and not name[0].islower():
        raise AttributeError(f"{kind} {name!r} must begin in lower case")
    return name


@dataclass(frozen=True)
class Segment:
    """Where a block of a tensor lies: a column of Parquet files, and the offsets and sizes of its trailing axes."""

    path: str
    column: str
    offsets: tuple[int, ...] = ()
    sizes: tuple[int, ...] = ()


@dataclass(frozen=True)
class DimensionSpec:
    """shape None: it can grow; length: rows so far (0 until there are data, even for a fixed shape)."""

    shape: int | None = None
    length: int = 0

    def __post_init__(self) -> None:
        if self.shape is not None and (not isinstance(self.shape, int) or isinstance(self.shape, bool) or self.shape < 0):
            raise ValueError("a dimension's shape is None or a whole number")


@dataclass(frozen=True)
class TensorSpec:
    """dims: names, fixed sizes or None (variable), one per axis. shape: the current sizes; for jagged
    tensors the largest of each trailing axis. value: of a rank-0 tensor."""

    dtype: str
    dims: tuple[Dim, ...]
    shape: tuple[int, ...]
    jagged: bool = False
    chunks: tuple[int, ...] | None = None
    segments: tuple[Segment, ...] = field(default=())
    value: Any = None

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def kind(self) -> DType:
        return dtype(self.dtype)

    def with_segment(self, segment: Segment, shape: tuple[int, ...]) -> TensorSpec:
        return replace(self, segments=(*self.segments, segment), shape=shape)

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, d: dict) -> TensorSpec:
        segments = tuple(Segment(s["path"], s["column"], tuple(s["offsets"]), tuple(s["sizes"])) for s in d["segments"])
        return cls(d["dtype"], tuple(d["dims"]), tuple(d["shape"]), d["jagged"], tuple(d["chunks"]) if d["chunks"] else None, segments, d["value"])


def declared(kind: str, dims: tuple[Dim, ...], chunks: tuple[int, ...] | None = None, jagged: bool = False) -> TensorSpec:
    """A tensor without data: all sizes 0 but those of fixed anonymous axes past the first."""
    dtype(kind)
    for d in dims:
        if not (d is None or isinstance(d, str) or isinstance(d, int) and not isinstance(d, bool) and d >= 0):
            raise ValueError(f"{d!r} is no dimension: a name, a size or None")
        if isinstance(d, str):
            check_name(d, "dimension")
    if jagged and len(dims) < 2:
        raise ValueError("a jagged tensor has two axes at least")
    if chunks is not None and (len(chunks) != len(dims) or any(c < 1 for c in chunks)):
        raise ValueError("chunks needs a positive size for each axis")
    return TensorSpec(kind, tuple(dims), (0,) * len(dims), jagged, tuple(chunks) if chunks else None)
